"""Near-duplicate documents: MinHash with banding, verification and connected components.

A document is its set of distinct word shingles.  Equal sets form one class.  Each class has 200 universal-hash
minima; 40 bands of five propose candidates (a pair at the threshold 0.8 shares no band with probability 1.2e-7).
Members of a band bucket are compared with one of them, its centre (the class with most copies), not with each other:
all who met one centre form a group.  A group of bounded size is settled in one task: a signature check against the
centre (the estimate may fall short of the threshold by about five standard deviations), then the full sets; members
outside the largest component found so far are compared with the whole group, as products of 0/1 matrices.  In larger
groups the comparisons with the centre are joins, and the rest are pairs of tiles of sets.  Tasks return spanning
forests, not pairs.  So every pair that shares a bucket is in one component or has been compared on its full sets, but
for two screens by signatures: the check against the centre, and ``_worth_comparing``, which drops the lone stray of a
bucket if its estimate to the centre is below 0.36 (for 0.8).  The second loses a link at 0.8 only if signatures put it
under 0.70 (about 3.5 standard deviations of 200 minima) in every bucket that the pair shares.

Edge cases: null texts and texts without words have an empty set and link with nothing; fewer words than a shingle
make one shingle of the whole sequence; repeated rows with one id are one node with the union of the rows' links;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stage, text_or_empty
from .components import connected_components, spanning_forest

BANDS, ROWS = 40, 5
MINIMA = BANDS * ROWS
SEPARATOR = b" "  # cannot be part of a word


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) runs of anything but the six ASCII white space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        grams = {SEPARATOR.join(words)}
    else:
        grams = set(map(SEPARATOR.join, zip(*[words[i:] for i in range(width)], strict=False)))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), dtype=np.uint64, count=len(grams)))


def _hash_family(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def minima(hashes: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each hash a*x + b (mod 2^32) over a non-empty set."""
    a, b = family
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(best, (x[at : at + 512, None] * a + b).min(axis=0), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, the band's number mixed in."""
    rows = best.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = (key ^ rows[:, r]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, sig`` from ``doc_id, text``; sig holds the low byte of each minimum."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family = _hash_family()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                have = shingle_set(text, width)
                if len(have):
                    best = minima(have, family)
                    rows.append((len(have), xxhash.xxh3_128_digest(have.tobytes()), band_keys(best), best.astype(np.uint8).tobytes()))
                else:
                    rows.append((0, None, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "bands", "sig"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.mapInPandas(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, digest binary, bands array<long>, sig binary")


def _possible(n_a: str, n_b: str, percent: int):
    """Sets whose sizes differ more than this cannot reach the threshold."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: signatures first, then the full sets decide."""
    side = lambda name: sets.select(F.col("rep").alias(name), F.col("sig").alias(f"s_{name}"), F.col("grams").alias(f"g_{name}"))
    floor = percent / 100 - 0.14

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sig = lambda c: np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, MINIMA)  # noqa: B023, E731
            keep = (sig("s_a") == sig("s_b")).mean(axis=1) >= floor
            for k in np.flatnonzero(keep):
                x, y = np.frombuffer(batch["g_a"].iloc[k], np.uint64), np.frombuffer(batch["g_b"].iloc[k], np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.loc[keep, ["a", "b"]]

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return stage(both.select("a", "b", "s_a", "s_b", "g_a", "g_b").mapInPandas(check, "a long, b long"), "mh-links")


def _worth_comparing(placed: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """``c, draw``: who must be compared within the group of centre c, by signatures.

    With distances 1 - J: a member farther from its centre than the threshold allows (less its error) is a stray.  Two
    strays of a bucket may be near each other, so they stay.  A single stray may be near a member that is near the
    centre only within the sum of both distances (less the error), else it goes.
    """
    near = percent / 100 - 0.14
    reach = percent / 100 + near - 1 - 0.1
    side = lambda name, sig: drawn.select(F.col("draw").alias(name), F.col("sig").alias(sig))

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, MINIMA) for c in ("s_c", "s_d"))
                yield batch[["c", "draw"]].assign(est=(x == y).mean(axis=1))

    pairs = placed.where("c != draw").select("c", "draw").distinct().join(side("c", "s_c"), "c").join(side("draw", "s_d"), "draw")
    judged = pairs.select("c", "draw", "s_c", "s_d").mapInPandas(estimate, "c long, draw long, est double")
    rated = stage(placed.where("c != draw").join(judged, ["c", "draw"]), "mh-rated")
    strays = rated.where(F.col("est") < near).groupBy("band").agg(F.count("*").alias("strays")).where("strays > 1")
    stay = rated.where(F.col("est") >= reach).select("c", "draw").unionByName(rated.where(F.col("est") < near).join(strays, "band", "left_semi").select("c", "draw")).distinct()
    return stage(stay.unionByName(stay.select("c", F.col("c").alias("draw")).distinct()), "mh-met")


def _full_sets(base: DataFrame, groups: DataFrame, sigs: DataFrame, width: int) -> DataFrame:
    """``rep, n, sig, grams`` of the classes that share a bucket with another; only their texts are shingled again."""

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rep": batch["doc_id"], "grams": [shingle_set(t, width).tobytes() for t in batch["text"]]})

    ids = groups.select(F.col("rep").alias("doc_id")).distinct()
    # The ids grow with the corpus, so they are not broadcast.
    sets = base.join(ids.hint("merge"), "doc_id", "left_semi").mapInPandas(again, "rep long, grams binary")
    # Of rows that repeat an id, only the one whose set has the class's digest counts.
    named = sets.withColumn("n", (F.length("grams") / 8).cast("long")).join(sigs, ["rep", "n"]).dropDuplicates(["rep"])
    return stage(named.select("rep", "n", "sig", "grams"), "mh-sets")


def _tiles(rows: DataFrame, tile_rows: int, tile_grams: int) -> DataFrame:
    """``centre, step, chunk, parts, sizes, grams`` of ``centre, component, n, grams``: tiles of sets of similar size, of
    bounded rows and elements (a larger set is a tile of its own)."""
    stepped = rows.withColumn("step", F.floor(F.log("n") / float(np.log(1.1))).cast("int"))
    needed = F.greatest(F.ceil(F.count("*") / tile_rows), F.ceil(F.sum("n") / tile_grams)).cast("int")
    # Written, so that the join may split a centre with very many sets; then dealt out by chunk too.
    chunks = stage(stepped.groupBy("centre", "step").agg(needed.alias("chunks")), "mh-chunks")
    placed = stepped.join(chunks, ["centre", "step"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    placed = placed.select("centre", "step", "chunk", "component", "n", "grams").repartition("centre", "step", "chunk")

    def blob(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[:1]
        packed = {"parts": group["component"].to_numpy(np.int64).tobytes(), "sizes": group["n"].to_numpy(np.int64).tobytes(), "grams": b"".join(group["grams"])}
        return pd.DataFrame({"centre": first["centre"], "step": first["step"], "chunk": first["chunk"], **{k: [v] for k, v in packed.items()}})

    schema = "centre long, step int, chunk long, parts binary, sizes binary, grams binary"
    return placed.groupBy("centre", "step", "chunk").applyInPandas(blob, schema)


def common_counts(grams_x: np.ndarray, sizes_x: np.ndarray, grams_y: np.ndarray, sizes_y: np.ndarray, columns: int = 1 << 13) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, as products of 0/1 matrices over shared elements."""
    vocabulary = np.intersect1d(grams_x, grams_y)
    total = np.zeros((len(sizes_x), len(sizes_y)), np.float64)

    def places(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, at = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(vocabulary, grams)
        inside = at < len(vocabulary)
        inside[inside] = vocabulary[at[inside]] == grams[inside]
        return row[inside], at[inside]

    (rx, cx), (ry, cy) = places(grams_x, sizes_x), places(grams_y, sizes_y)
    for begin in range(0, len(vocabulary), columns):
        width = min(columns, len(vocabulary) - begin)
        side = []
        for row, col, n in ((rx, cx, len(sizes_x)), (ry, cy, len(sizes_y))):
            here = (col >= begin) & (col < begin + width)
            matrix = np.zeros((n, width), np.float32)
            matrix[row[here], col[here] - begin] = 1
            side.append(matrix)
        total += side[0] @ side[1].T
    return total


def group_forest(centre: int, ids: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, grams: np.ndarray, percent: int) -> np.ndarray:
    """For each set of a group the number of the least-id set of its component, over all links in the group.

    First all are compared with the centre, then those outside the largest component with all others.
    """
    # Elements of one set only are in no intersection.
    _, number, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times[number] > 1
    row = np.repeat(np.arange(len(ids)), sizes)[shared]
    length = np.bincount(row, minlength=len(ids))
    sets = np.split(grams[shared], np.cumsum(length)[:-1])
    c = int(np.flatnonzero(ids == centre)[0])

    def linked(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        pick = lambda at: np.concatenate([sets[k] for k in at])
        common = common_counts(pick(rows), length[rows], pick(others), length[others])
        return 100 * common >= percent * (sizes[rows][:, None] + sizes[others][None, :] - common)

    possible = (100 * np.minimum(sizes, sizes[c]) >= percent * np.maximum(sizes, sizes[c])) & ((sigs == sigs[c]).mean(axis=1) >= percent / 100 - 0.14)
    near = np.flatnonzero(possible)
    near = near[linked(np.array([c]), near)[0]]
    label = np.arange(len(ids))
    label[near] = c
    found = [(near, np.full(len(near), c))]
    main = np.bincount(label).argmax()
    asked = np.flatnonzero(label != main) if len(ids) > 2 else near[:0]
    for at in range(0, len(asked), 128):
        x = asked[at : at + 128]
        for begin in range(0, len(ids), 512):
            y = np.arange(begin, min(begin + 512, len(ids)))
            i, j = np.nonzero(linked(x, y) & (label[x][:, None] != label[y][None, :]))
            found.append((x[i], y[j]))
    i, j = (np.concatenate(v) for v in zip(*found, strict=True))
    return spanning_forest(len(ids), i, j, ids)


def _group_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Spanning forests (a, b) of the groups ``centre, rep``, one group of bounded size at a time."""

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["rep"].to_numpy(np.int64)
        sigs = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(len(ids), MINIMA)
        grams = np.frombuffer(b"".join(group["grams"]), np.uint64)
        root = group_forest(int(group["centre"].iloc[0]), ids, group["n"].to_numpy(np.int64), sigs, grams, percent)
        edges = pd.DataFrame({"a": ids, "b": ids[root]})
        return edges[edges["a"] != edges["b"]]

    rows = groups.select("centre", "rep").join(sets, "rep").select("centre", "rep", "n", "sig", "grams")
    return stage(rows.groupBy("centre").applyInPandas(settle, "a long, b long"), "mh-links")


def _block_links(asked: DataFrame, members: DataFrame, percent: int, tile_rows: int, tile_grams: int) -> DataFrame:
    """Links (a, b) between components, from comparing each group's ``asked`` with its ``members``, both
    ``centre, rep, component, n, grams``, tile by tile.  A task returns a spanning forest of each tile pair's
    components, not its pairs."""
    side = lambda rows, name: _tiles(rows, tile_rows, tile_grams).select("centre", *[F.col(c).alias(f"{name}_{c}") for c in ("step", "parts", "sizes", "grams")])
    near = int(np.ceil(np.log(100 / percent) / np.log(1.1))) + 1

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                (px, nx), (py, ny) = ([np.frombuffer(v, np.int64) for v in pair] for pair in ((r.x_parts, r.x_sizes), (r.y_parts, r.y_sizes)))
                common = common_counts(np.frombuffer(r.x_grams, np.uint64), nx, np.frombuffer(r.y_grams, np.uint64), ny)
                linked = (100 * common >= percent * (nx[:, None] + ny[None, :] - common)) & (px[:, None] != py[None, :])
                i, j = np.nonzero(linked)
                if len(i):
                    parts, number = np.unique(np.concatenate([px[i], py[j]]), return_inverse=True)
                    root = spanning_forest(len(parts), number[: len(i)], number[len(i) :], parts)
                    yield pd.DataFrame({"a": parts, "b": parts[root]})

    work = side(asked, "x").join(side(members, "y"), "centre").where(F.abs(F.col("x_step") - F.col("y_step")) <= near)
    return stage(work.mapInPandas(compare, "a long, b long").where("a != b"), "mh-block-links")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, group_grams: int = 1 << 18, tile_rows: int = 128, tile_grams: int = 1 << 19) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; ids are integers."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    signed = stage(signatures(base, width), "mh-signed")
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # Written first, so that the joins below are free to split a digest with very many copies.
    classes = stage(classes, "mh-classes")
    # A representative's own row (one of them, if its id is repeated) carries the class's signature.
    reps = signed.withColumnRenamed("doc_id", "rep").join(classes, ["digest", "rep"]).dropDuplicates(["digest", "rep"])
    sigs = stage(reps.select("rep", "copies", F.col("n_shingles").alias("n"), "sig", "bands"), "mh-sigs")

    # Classes are drawn as centres by copies, then hash: originals are copied more than their variants.  Bucket rows
    # carry nothing else, so that they stay small; should two classes draw the same number, both are the centre.
    draw = F.shiftleft(32767 - F.least("copies", F.lit(32767)), 48).bitwiseOR(F.xxhash64("rep").bitwiseAND(F.lit((1 << 48) - 1)))
    drawn = stage(sigs.select(draw.alias("draw"), "rep", "n", "sig"), "mh-drawn")
    rows = sigs.select(draw.alias("draw"), F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.count("*").alias("size"), F.min("draw").alias("c")).where("size > 1")
    placed = stage(rows.join(buckets, "band").select("band", "c", "draw"), "mh-placed")
    met = _worth_comparing(placed, drawn, percent)
    groups = met.join(drawn.drop("sig"), "draw").join(drawn.select(F.col("draw").alias("c"), F.col("rep").alias("centre"), F.col("n").alias("m")), "c")
    groups = stage(groups.select("centre", "rep", "n", "m").distinct(), "mh-groups")
    sets = _full_sets(base, groups, sigs.select("rep", "n", "sig"), width)
    ordered = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    # Written, so that the join is free to split a centre with very many members.
    totals = stage(groups.groupBy("centre").agg(F.sum("n").alias("grams")), "mh-totals")
    sized = groups.join(totals, "centre")
    links = _group_links(sized.where(F.col("grams") <= group_grams), sets, percent)
    large = stage(sized.where(F.col("grams") > group_grams), "mh-large")
    if large.isEmpty():
        return _labelled(signed, classes, connected_components(links))
    first = large.where("rep != centre").where(_possible("n", "m", percent)).select(*ordered("rep", "centre")).distinct()
    parts = connected_components(links.unionByName(_verify(first, sets, percent)))
    known = sets.select("rep").join(parts, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component"))
    open_ = stage(large.select("centre", "rep", "n").join(known, "rep"), "mh-open")
    by_part = open_.groupBy("centre", "component").agg(F.count("*").alias("members"))
    unsettled = by_part.groupBy("centre").agg(F.count("*").alias("parts"), F.max(F.struct("members", "component"))["component"].alias("main")).where("parts > 1")
    crowd = open_.join(unsettled.select("centre", "main"), "centre").join(sets.select("rep", "grams"), "rep")
    more = _block_links(crowd.where("component != main"), crowd, percent, tile_rows, tile_grams)
    upper = connected_components(more)
    final = (
        parts.join(upper.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
        .select("node", F.coalesce("top", "component").alias("component")).unionByName(upper)
        .groupBy("node").agg(F.min("component").alias("component"))
    )
    return _labelled(signed, classes, final)


def _labelled(signed: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    # Classes are labelled before their documents, so that copies meet in one join only; written, so that it may split them.
    labelled = classes.join(parts, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    labelled = stage(labelled, "mh-labelled")
    rows = signed.where("doc_id is not null").select(F.col("doc_id").alias("id"), "digest").join(labelled, "digest").select("id", "component")
    owner = stage(rows.groupBy("id").agg(F.min("component").alias("component"), F.max("component").alias("other")), "mh-owners")
    several = owner.where("component != other").select("id", F.col("component").alias("a"))
    if not several.isEmpty():
        # Rows that repeat an id with another text: their components are one.
        merged = connected_components(stage(rows.join(several, "id").select("a", F.col("component").alias("b")).where("a != b").distinct(), "mh-merged"))
        merged = merged.select(F.col("node").alias("component"), F.col("component").alias("top"))
        owner = owner.join(merged, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    out = signed.select("doc_id", "n_shingles").join(owner.select("id", "component"), F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs``, all columns, for each group of near duplicates: the one of least id.  An id names one
    document, so of rows that repeat an id one stays; rows without an id all stay."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    row = docs.select(F.col(id_col).alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # Of rows that repeat an id the one with the least hash, found without their texts; equal ones meet in their tasks first.
    named = row.where("row_id is not null").groupBy("row_id").agg(F.count("*").alias("rows"), F.min(F.xxhash64("row")).alias("least"))
    wanted = stage(named.join(kept, F.col("row_id") == F.col("kept_id"), "left_semi"), "mh-wanted")
    # The ids that stay grow with the table, so they are never broadcast, and rows move in proportion at every size.
    stays = row.join(wanted.where("rows = 1").hint("merge"), "row_id", "left_semi").select("row.*").unionByName(row.where("row_id is null").select("row.*"))
    several = wanted.where("rows > 1")
    if several.isEmpty():
        return stays
    least = row.withColumn("least", F.xxhash64("row")).join(several, ["row_id", "least"], "left_semi")
    return stays.unionByName(least.groupBy("row_id").agg(F.any_value("row").alias("row")).select("row.*"))


def oracle(width: int, percent: int = 80) -> str:
    """The same in DuckDB SQL for texts of ``width`` words or more: all pairs that share a shingle, and the least id
    reachable."""
    gram = " || ' ' || ".join(f"w[i{f' + {k}' if k else ''}]" for k in range(width))
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: {gram})) END AS g FROM words),
sized AS (SELECT doc_id, len(g) AS n FROM sets),
rows AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS common FROM rows x JOIN rows y ON x.gram = y.gram AND x.doc_id != y.doc_id
    AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= {percent} * (n + m - common)),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT links.a, root FROM reach JOIN links ON links.b = reach.doc_id),
least_ AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept FROM sized JOIN least_ USING (doc_id)"""
