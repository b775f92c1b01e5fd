"""Packing token pieces into sequences by vector best fit.

Texts are encoded, closed by a separator id and, where longer than a sequence, cut into whole sequences (the
first piece takes the remainder).  Pieces of one length are interchangeable, so the plan is made on the histogram
of lengths: at most ``tokens`` rows on the driver, whatever the size of the table.  From the longest length down,
pieces go to the open bins whose residual capacity (tokens, documents, attention cost = sum of squared lengths)
fits them best under every constraint, by the weighted norm of what is left or the weighted dot product of need
and residual; bins in the same state are handled together, as ranges of numbers.  Each piece then finds its place
by its rank among the pieces of its length.

Edge cases: null texts count as empty, an empty text is one piece of the separator alone; repeated rows are separate
documents with their own places; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty

# Fixed value: the pre-tokenization pattern that a "ByteLevel" tokenizer file stands for.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[Sequence[str]], list[list[int]]]:
    """The tokenizer file's ``encode_batch(..., add_special_tokens=False)``.

    A plain byte-level BPE file, whose ids are its merge ranks, is run by a faster implementation of the same
    merges; texts that hold one of its special strings, and all other files, go to the tokenizers library.
    """

    @lru_cache(maxsize=1)
    def library():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def whole(texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in library().encode_batch(list(texts), add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    fast = _ranked(spec)
    if fast is None:
        return whole
    special = [t["content"] for t in spec["added_tokens"]]

    def encode(texts: Sequence[str]) -> list[list[int]]:
        return [whole([t])[0] if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]

    return encode


def _ranked(spec: dict):
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(shifted)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab = model["vocab"]
    added = {t["content"] for t in spec["added_tokens"]}
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or any(c not in byte_of for t in vocab if t not in added for c in t):
        return None
    import tiktoken

    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in added}
    return tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, tokens: int = 2048, separator: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for each document's token ids."""
    path = tokenizer or default_tokenizer()
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                for doc, ids in zip(part["doc_id"], encode(part["text"].tolist()), strict=True):
                    ids = np.array([*ids, separator], dtype="<u4")
                    first = len(ids) % tokens or tokens
                    edges = [0, *range(min(first, len(ids)), len(ids) + 1, tokens)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInPandas(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass
class _Bins:
    """Open bins in one state: what is left of each capacity, and the numbers of the bins as ranges."""

    left: tuple[int, ...]
    ranges: list[list[int]]


def plan_best_fit(
    histogram: Sequence[tuple[int, int]], capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.25, 0.25), score: str = "norm"
) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, rank_from, rank_to, sequence, offset)``: that rank's piece goes to ``sequence + rank - rank_from``.

    ``capacity`` is (tokens, documents, attention cost); every length must fit an empty bin.  ``score``: "norm"
    picks the bin with the least weighted norm of the residual after placing, "dot" the one with the largest
    weighted dot product of need and residual.
    """
    tokens, documents, attention = capacity
    need_of = lambda n: (n, 1, n * n)
    # All three residuals count in the score, also of a capacity that the token capacity implies.
    caps = tuple(capacity)
    scale = np.array([w / c for w, c in zip(weights, caps, strict=True)])
    states: dict[tuple[int, ...], _Bins] = {}
    keys, table, alive = [], np.zeros((1024, 3)), np.zeros(1024, bool)
    slot_of: dict[tuple[int, ...], int] = {}
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def add(left: tuple[int, ...], ranges: list[list[int]]) -> None:
        nonlocal table, alive
        if left in states:
            states[left].ranges += ranges
            return
        states[left] = _Bins(left, ranges)
        if left not in slot_of:
            slot_of[left] = len(keys)
            keys.append(left)
            if len(keys) > len(table):
                table, alive = np.vstack([table, np.zeros_like(table)]), np.concatenate([alive, np.zeros_like(alive)])
            table[slot_of[left]] = left
        alive[slot_of[left]] = True

    for length, count in sorted(histogram, reverse=True):
        need = need_of(length)
        if any(n > c for n, c in zip(need, capacity, strict=True)):
            raise ValueError(f"a piece of {length} tokens exceeds an empty sequence's capacity {capacity}")
        rank = 0
        while rank < count:
            rest = table[: len(keys)] - need
            fits = alive[: len(keys)] & (rest >= 0).all(axis=1)
            if fits.any():
                if score == "dot":
                    value = -((table[: len(keys)] * scale) @ (np.array(need) * scale))
                else:
                    value = ((rest * scale) ** 2).sum(axis=1)
                key = keys[int(np.argmin(np.where(fits, value, np.inf)))]
                bins = states.pop(key)
                alive[slot_of[key]] = False
            else:
                # Bins that this length alone would fill: the rest of its pieces come back to them.
                per = min(c // n for c, n in zip(caps, need, strict=True))
                fresh = -(-(count - rank) // per)
                key, bins = caps, _Bins(caps, [[opened, opened + fresh]])
                opened += fresh
            after = tuple(k - n for k, n in zip(key, need, strict=True))
            while bins.ranges and rank < count:
                a, b = bins.ranges[-1]
                k = min(b - a, count - rank)
                out.append((length, rank, rank + k, a, tokens - key[0]))
                rank += k
                add(after, [[a, a + k]])
                if a + k == b:
                    bins.ranges.pop()
                else:
                    bins.ranges[-1][0] = a + k
            if bins.ranges:
                add(key, bins.ranges)
    return out


def pack(
    docs: DataFrame,
    *,
    tokens: int = 2048,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25),
    score: str = "norm",
    part_rows: int = 512,
    **options,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece.

    ``documents`` and ``attention`` default to bounds that the token capacity implies.  Text is encoded once and
    never shuffled; ranks are taken in parts of about ``part_rows`` rows of one length, so a hot length spreads.
    """
    cut = stage(pieces(docs, tokens=tokens, **options), "pack-pieces")
    hist = [(r["length"], r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()]  # <= tokens rows
    plan = plan_best_fit(hist, (tokens, documents or tokens, attention or tokens * tokens), weights, score)
    spark = docs.sparkSession
    parts_of = spark.createDataFrame([(n, -(-c // part_rows)) for n, c in hist], "length long, parts int")
    placed = cut.join(F.broadcast(parts_of), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")))
    in_part = Window.partitionBy("length", "part").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = placed.withColumn("in_part", F.row_number().over(in_part) - 1).join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("in_part"))
    # The plan's size follows the number of lengths and bin states, not the pieces.
    where_to = spark.createDataFrame(plan, "p_length long, rank_from long, rank_to long, sequence long, offset long")
    fits = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    return ranked.join(F.broadcast(where_to), fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset"
    )
