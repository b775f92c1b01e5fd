"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if it lies in a string of ``length`` bytes that starts at another place too (in any document, the same
one included).  Sorting the suffixes of a whole corpus would shuffle many times its size, so only suffixes that can
be repeated are sorted, and none of those is missed:

1. Winnowing gives each window of ``length`` bytes the same anchor wherever it occurs (the least hash among its
   ``gram``-byte substrings, leftmost on ties).  Windows that share an anchor form a segment of less than twice
   ``length`` bytes.  Only segments whose anchor hash occurs twice can hold a repeated window.
2. Equal segments (by a 128-bit digest) are one class.  Two segments of each class are fetched (one, if there is only
   one), from different places; that both are equal is checked on their bytes.
3. All windows of an anchor's segments are sorted as suffixes: by the first 16 bytes, then by mergesort, comparing two
   suffixes through the longest common extension that a binary search over prefix polynomial hashes finds.  Equal
   neighbours are confirmed byte by byte.  An anchor with more than ``group_rows`` segments, which would not fit a
   task, is split by shorter and shorter blocks of windows (the bytes common to a block's windows are part of its key)
   down to single windows, which are grouped by their bytes.

Edge cases: null texts count as empty and, like texts shorter than ``length``, lose nothing; repeated rows count as
separate places, also with null ids; ids of any type are handed through; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_dir, stage, text_or_empty
from .hashing import PolynomialHash, mix

LENGTH, GRAM = 400, 200
BLOCK = 1 << 20
BUCKET_BYTES = 128 << 20


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor, first window, last window) of each segment; long data is cut into blocks of windows."""
    parts = []
    for at in range(0, max(len(data) - length + 1, 0), BLOCK):
        block = data[at : at + BLOCK + length - 1]
        h = mix(PolynomialHash(block).of(np.arange(len(block) - gram + 1), gram))
        low = np.uint64((1 << 24) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, windows = length - gram + 1, len(block) - length + 1
        padded = np.full(-(-len(key) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        rows = padded.reshape(-1, width)
        left = np.minimum.accumulate(rows, axis=1).ravel()
        right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(right[:windows], left[width - 1 : width - 1 + windows]) & low).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], windows) - 1
        parts.append((h[anchor[first]].view(np.int64), anchor[first] + at, first + at, last + at))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class SuffixSort:
    """Sorts suffixes of ``data``, cut to ``length`` bytes, by hash comparisons."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.hashes = data, length, PolynomialHash(data)

    def common(self, i: np.ndarray, j: np.ndarray, known: int) -> np.ndarray:
        """Longest common extension of the suffixes at i and j, of which ``known`` bytes are known to agree."""
        low, high = np.full(len(i), known), np.full(len(i), self.length)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hashes.of(i, mid) == self.hashes.of(j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray, known: int) -> np.ndarray:
        """-1, 0 or 1: how the suffix at i compares to the one at j."""
        n = np.full(len(i), self.length)
        unlike = np.flatnonzero(self.hashes.of(i, self.length) != self.hashes.of(j, self.length))
        n[unlike] = self.common(i[unlike], j[unlike], known)
        at = np.minimum(n, self.length - 1)
        order = np.sign(self.data[i + at].astype(np.int16) - self.data[j + at].astype(np.int16))
        return np.where(n == self.length, 0, order)

    def sort(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts in order, run): equal run numbers mark suffixes that agree in their first 16 bytes."""
        known = min(16, self.length)
        head = sliding_window_view(self.data, known)[starts]
        if known == 16:
            halves = np.ascontiguousarray(head).view(">u8").astype(np.uint64)
            order = np.lexsort((halves[:, 1], halves[:, 0]))
            sorted_heads = halves[order]
        else:
            order = np.lexsort(head.T[::-1])
            sorted_heads = head[order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_heads[1:] != sorted_heads[:-1]).any(axis=1)
        starts, run = starts[order], np.cumsum(new) - 1
        size = np.bincount(run)
        kept = size[run] > 1
        starts, run = starts[kept], run[kept]
        if not len(starts):
            return starts, run
        _, begin, index, count = np.unique(run, return_index=True, return_inverse=True, return_counts=True)
        begin, count = begin[index], count[index]
        place = np.arange(len(starts)) - begin
        width = 1
        while width < count.max():
            place, starts = self._merge(starts, begin, count, place, width, known)
            width *= 2
        return starts, run

    def _merge(self, starts, begin, count, place, width, known):
        """One level of mergesort in all runs at once: each element's rank among its sibling block is searched for."""
        block = place // width
        sibling = (block ^ 1) * width
        low = np.minimum(sibling, count)
        high = np.minimum(sibling + width, count)
        base = low.copy()
        is_left = block % 2 == 0
        active = np.flatnonzero(low < high)
        while len(active):
            mid = (low[active] + high[active]) // 2
            order = self.before(starts[begin[active] + mid], starts[active], known)
            goes = (order < 0) | ((order == 0) & ~is_left[active])
            low[active] = np.where(goes, mid + 1, low[active])
            high[active] = np.where(goes, high[active], mid)
            active = active[low[active] < high[active]]
        new = (block & ~1) * width + (place - block * width) + (low - base)
        out = np.empty_like(starts)
        out[begin + new] = starts
        return np.arange(len(starts)) - begin, out

    def repeated(self, starts: np.ndarray) -> np.ndarray:
        """Which of the ``starts`` have an equal other, confirmed on the bytes."""
        order, run = self.sort(starts)
        hit = np.zeros(len(self.data), bool)
        if len(order):
            pair = np.flatnonzero(run[1:] == run[:-1])
            i, j = order[pair], order[pair + 1]
            equal = self.common(i, j, min(16, self.length)) == self.length
            i, j, runs = i[equal], j[equal], run[pair[equal]]
            rows = sliding_window_view(self.data, self.length)
            for at in range(0, len(i), 16384):
                s = slice(at, at + 16384)
                same = (rows[i[s]] == rows[j[s]]).all(axis=1)
                hit[i[s][same]] = hit[j[s][same]] = True
                for r in np.unique(runs[s][~same]):  # a hash collision: settle this run by its bytes
                    seen: dict[bytes, int] = {}
                    for k in order[run == r]:
                        other = seen.setdefault(rows[k].tobytes(), k)
                        if other != k:
                            hit[[k, other]] = True
        return hit[starts]


def repeated_windows(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each body, which of its windows occurs twice among all windows of all bodies."""
    sizes = np.array([len(b) for b in bodies])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    counts = sizes - length + 1
    starts = np.concatenate([np.arange(o, o + c) for o, c in zip(offsets, counts, strict=False)])
    found = SuffixSort(np.frombuffer(b"".join(bodies), np.uint8), length).repeated(starts)
    return np.split(found, np.cumsum(counts)[:-1])


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _bucketed(docs: DataFrame, id_col: str, text_col: str):
    """The texts, with a number for each row, as a table in the shared folder, bucketed by that number: later joins on
    it move no text.  Buckets follow the data's size, so none outgrows a task."""
    spark = docs.sparkSession
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("body"))
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    name = f"suffix_dedup_{uuid.uuid4().hex}"
    keyed.repartition(parts, "row").write.bucketBy(parts, "row").option("path", os.path.join(shared_dir(spark), name)).saveAsTable(name)
    return spark.table(name), name


def _split(rows: DataFrame, length: int, block: int) -> DataFrame:
    """Each row's windows in blocks aligned on the distance from the anchor; a block's key holds the bytes that
    all its windows share."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                windows, at = len(r.body) - length + 1, 0
                while at < windows:  # the distance to the anchor falls by one from window to window
                    distance = r.near - at
                    bottom = distance // block * block
                    n = min(windows - at, distance - bottom + 1)
                    core = r.body[r.near - bottom : max(r.near - bottom - block + 1 + length, 0)]
                    out.append((r.key, r.digest, r.copy, r.first + at, distance, r.body[at : at + n - 1 + length], core))
                    at += n
            yield pd.DataFrame(out, columns=["key", "digest", "copy", "first", "near", "body", "core"])

    return rows.mapInPandas(cut, "key long, digest binary, copy int, first int, near int, body binary, core binary")


def _sort_groups(rows: DataFrame, length: int, group_rows: int) -> DataFrame:
    """``key, digest, lo, hi``: ranges of repeated windows of each class's segment.

    ``rows``: key, digest, copy (0, and 1 for the second place of a class), grp, first (number of the body's first window
    in the segment), near (its distance to the anchor), body.
    """
    found = None
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for block in (50, 10, 1):
        large = stage(rows.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("grp"), "sfx-large")
        # Each bucket holds whole groups, about 2000 rows of less than 2 * length bytes.
        buckets = max(1, -(-rows.count() // 2000))

        def settle(group: pd.DataFrame) -> pd.DataFrame:
            out, seen = [], {}
            for r, flags in zip(group.itertuples(), repeated_windows(group["body"].tolist(), length), strict=True):
                if seen.setdefault((r.key, r.digest, r.first), r.body) != r.body:
                    raise ValueError("two segments of one 128-bit digest differ")
                if r.copy == 0:
                    out += [(r.key, r.digest, r.first + a, r.first + b) for a, b in _ranges(flags)]
            return pd.DataFrame(out, columns=["key", "digest", "lo", "hi"])

        work = rows.join(large, "grp", "left_anti").select("key", "digest", "copy", "first", "body", F.pmod(F.xxhash64("grp"), F.lit(buckets)).alias("bucket"))
        part = work.repartition(max(tasks, buckets // 4), "bucket").groupBy("bucket").applyInPandas(settle, "key long, digest binary, lo int, hi int")
        part = stage(part, "sfx-found")
        found = part if found is None else found.unionByName(part)
        if large.isEmpty():
            return found
        cut = _split(rows.join(large, "grp", "left_semi").select("key", "digest", "copy", "first", "near", "body"), length, block)
        if block == 1:  # single windows: being one of two or more equal ones is the answer
            single = stage(cut.select("key", "digest", "copy", "first", "body"), "sfx-single")
            twice = stage(single.groupBy("body").agg(F.count("*").alias("n")).where("n > 1").select("body"), "sfx-twice")
            hit = single.where("copy = 0").join(twice, "body")
            return found.unionByName(hit.select("key", "digest", F.col("first").alias("lo"), (F.col("first") + 1).alias("hi")))
        far = F.floor(F.col("near") / block)
        group = F.md5(F.concat_ws("|", F.col("key").cast("string"), far.cast("string"), F.hex("core")))
        rows = stage(cut.select("key", "digest", "copy", "first", "near", "body", group.alias("grp")), "sfx-blocks")
    raise AssertionError


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, group_rows: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every row; spans are (start, end) in bytes."""
    spark = docs.sparkSession
    texts, name = _bucketed(docs, id_col, text_col)
    try:
        return _without_repeats(texts, length, gram or length // 2, group_rows)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, os.path.join(shared_dir(spark), name))


def _anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``row, key, digest, near, start, windows``: all segments of the texts."""

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, digests = [], []
            for row, body in zip(batch["row"], batch["body"], strict=True):
                key, anchor, first, last = segments(np.frombuffer(body, np.uint8), length, gram)
                view = memoryview(body)
                digests += [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
                parts.append((np.full(len(key), row, np.int64), key, anchor - first, first, last - first + 1))
            row, key, near, start, windows = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 5
            yield pd.DataFrame({"row": row, "key": key, "digest": digests, "near": near, "start": start, "windows": windows})

    return texts.select("row", "body").mapInPandas(anchors, "row long, key long, digest binary, near int, start long, windows int")


def _without_repeats(texts: DataFrame, length: int, gram: int, group_rows: int) -> DataFrame:
    # What is joined is written first, so that a join is free to split an anchor or class with very many rows.
    anchored = stage(_anchored(texts, length, gram), "sfx-anchored")
    twice = stage(anchored.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "sfx-keys")
    held = stage(anchored.join(twice, "key"), "sfx-held")
    place = F.struct("row", "start")
    classes = held.groupBy("key", "digest").agg(F.min("near").alias("near"), F.min("windows").alias("windows"), F.min(place).alias("a"), F.max(place).alias("b"))
    places = F.array_distinct(F.array(F.struct(F.lit(0).alias("copy"), "a.*"), F.struct(F.when(F.col("a") == F.col("b"), 0).otherwise(1).alias("copy"), "b.*")))
    wanted = classes.select("key", "digest", "near", "windows", F.explode(places).alias("p")).select("key", "digest", "near", "windows", "p.*")
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "digest", "copy", "start", "windows", "near")).alias("asked"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for body, asked_ in batch.itertuples(index=False):
                rows += [(q["key"], bytes(q["digest"]), q["copy"], str(q["key"]), 0, q["near"], body[q["start"] : q["start"] + q["windows"] - 1 + length]) for q in asked_]
            yield pd.DataFrame(rows, columns=["key", "digest", "copy", "grp", "first", "near", "body"])

    bodies = stage(
        texts.join(asked, "row").select("body", "asked")
        .mapInPandas(_batched(fetch), "key long, digest binary, copy int, grp string, first int, near int, body binary"),
        "sfx-bodies",
    )
    decided = stage(_sort_groups(bodies, length, group_rows), "sfx-decided")
    cut = F.struct((F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi") - 1 + length).alias("b"))
    removed = held.join(decided, ["key", "digest"]).groupBy("row").agg(F.collect_list(cut).alias("cuts"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, body, cuts in batch.itertuples(index=False):
                spans: list[list[int]] = []
                for a, b in sorted((c["a"], c["b"]) for c in (cuts if cuts is not None else ())):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(body[at:a])
                    at = b
                digest.update(body[at:])
                rows.append((doc, len(body), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), ",".join(f"{a}:{b}" for a, b in spans)))
            frame = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
            yield frame.assign(doc_id=batch["doc_id"].to_numpy())

    done = texts.join(removed, "row", "left").select("doc_id", "body", "cuts")
    kind = texts.schema["doc_id"].dataType.simpleString()
    out = done.mapInPandas(_batched(finish), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")
    return stage(out, "sfx-out")


def _batched(fn, rows: int = 20_000):
    """Joins the small frames that ``fn`` yields, so that each Arrow batch is worth sending."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for frame in fn(batches):
            held.append(frame)
            n += len(frame)
            if n >= rows:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return run


def oracle(length: int = LENGTH) -> str:
    """The same in DuckDB SQL, over hexadecimal bytes: every window of every text is grouped with its equals."""
    return rf"""
WITH bodies AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS MATERIALIZED (SELECT doc_id, p, md5(substr(x, CAST(2 * p + 1 AS BIGINT), {2 * length})) AS m FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - {length} + 1)) AS p FROM bodies WHERE len(x) // 2 >= {length})),
twice AS (SELECT m FROM windows GROUP BY 1 HAVING count(*) > 1),
hits AS (SELECT doc_id, p FROM windows SEMI JOIN twice USING (m)),
begun AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {length} OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS fresh FROM hits),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM begun),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + {length} AS b FROM numbered GROUP BY 1, 2),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS after FROM runs),
cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS spans, string_agg(substr(x, CAST(2 * after + 1 AS BIGINT), CAST(2 * (a - after) AS BIGINT)), '' ORDER BY a) AS head,
    any_value(substr(x, CAST(2 * last_b + 1 AS BIGINT))) AS tail FROM gaps JOIN bodies USING (doc_id) JOIN (SELECT doc_id, max(b) AS last_b FROM runs GROUP BY 1) USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN n IS NULL THEN x ELSE head || tail END)) AS kept_sha256, coalesce(spans, '') AS spans FROM bodies LEFT JOIN cut USING (doc_id)"""
