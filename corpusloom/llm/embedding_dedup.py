"""Near-duplicate embeddings: int8 tile products with per-vector error bounds.

Unit vectors u are quantised to q with one scale per vector; the norm of the rest u - s*q is measured, not guessed,
so a product of quantised tiles bounds each cosine from both sides.  Tiles hold codes, scales and norms of rests only.  Pairs
whose lower bound reaches the threshold are links; for those whose bounds enclose it, the vectors concerned are fetched
in double precision, tile pair by tile pair, and decide.  Equal vectors of a label are one class with a multiplicity, so
copies are not multiplied out; within a tile pair, links become counts and a spanning forest, so no list of all pairs
leaves a task.

Edge cases: a null label, a null vector, a zero vector or one with null or non-finite components links with nothing
(n_links 0, a component of its own); vectors of different lengths never link; repeated ids are merged into one
node but counted as separate vectors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import connected_components, spanning_forest

#: Products of int8 values of this many dimensions are exact in single precision.
EXACT_DIMS = 1024


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q as int8, scale, norm of the rest) of each unit row: u = scale * q + rest."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    rest = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q.astype(np.int8), scale, rest


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows."""
    total = None
    for at in range(0, a.shape[1], EXACT_DIMS):
        part = a[:, at : at + EXACT_DIMS].astype(np.float32) @ b[:, at : at + EXACT_DIMS].astype(np.float32).T
        total = part if total is None else total.astype(np.float64) + part
    return total


def _level(rows: np.ndarray) -> np.ndarray:
    """Rows brought near length 1 by powers of two, which are exact: no square over- or underflows."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1][:, None])


@dataclass
class Tile:
    """Quantised vectors of one label and length, with the classes they stand for."""

    nums: np.ndarray
    reps: np.ndarray
    weights: np.ndarray
    codes: np.ndarray
    scales: np.ndarray
    rests: np.ndarray

    @classmethod
    def of(cls, row, side: str) -> Tile:
        part = lambda name, kind: np.frombuffer(getattr(row, f"{side}_{name}"), kind)
        nums = part("nums", np.int64)
        return cls(nums, part("reps", np.int64), part("weights", np.int64), part("codes", np.int8).reshape(len(nums), -1), part("scales", np.float64), part("rests", np.float64))


def bounded_links(a: Tile, b: Tile, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure) of all pairs whose upper bound reaches the threshold; i < j only if ``same``; sure: the lower too."""
    found = []
    for at in range(0, len(a.nums), 512):  # bounds what one product holds
        s = slice(at, at + 512)
        middle = _product(a.codes[s], b.codes) * a.scales[s, None] * b.scales[None, :]
        slack = a.rests[s, None] * (1 + b.rests[None, :]) + b.rests[None, :] * (1 + a.rests[s, None]) + a.rests[s, None] * b.rests[None, :] + 1e-6
        i, j = np.nonzero(middle + slack >= threshold)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        found.append((i + at, j, (middle - slack)[i, j] >= threshold))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def cosine_reaches(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) of rows of a and b have a cosine of ``threshold`` at least, in double precision."""
    a, b = _level(a), _level(b)
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 65536):
        p, q = i[k : k + 65536], j[k : k + 65536]
        out[k : k + 65536] = np.einsum("ij,ij->i", a[p], b[q]) / (norm_a[p] * norm_b[q]) >= threshold
    return out


def _summed(nums: np.ndarray, reps: np.ndarray, weights: np.ndarray, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
    """Links between rows i and j as counts and a spanning forest: num, links, rep, root of the linked rows."""
    links = np.bincount(i, weights[j], minlength=len(nums)) + np.bincount(j, weights[i], minlength=len(nums))
    root = spanning_forest(len(nums), i, j, reps)
    at = np.flatnonzero(links)
    return {"num": nums[at], "links": links[at].astype(np.int64), "rep": reps[at], "root": reps[root[at]]}


LINKS = "num long, links long, rep long, root long"


def _tiles(reps: DataFrame, tile_rows: int, tile_bytes: int) -> DataFrame:
    """``label, dim, tile`` and blobs of ``nums, reps, weights, codes, scales, rests`` of so many rows or bytes at most."""
    rows_of = F.greatest(F.lit(1), F.least(F.lit(tile_rows), F.floor(F.lit(tile_bytes) / F.greatest("dim", F.lit(1)))))
    # Written, so that the join may split a label with very many rows; then dealt out by tile too.
    counts = stage(reps.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") / rows_of).cast("int").alias("tiles")), "emb-tile-counts")

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby("dim", sort=False):
                q, scale, rest = quantise(_level(np.array(rows["v"].tolist(), np.float64)))
                yield rows.drop(columns="v").assign(code=[c.tobytes() for c in q], scale=scale, rest=rest)

    kind = reps.schema["label"].dataType.simpleString()
    flat = reps.select("num", "label", "dim", "rep", "copies", "v").mapInPandas(coded, f"num long, label {kind}, dim int, rep long, copies long, code binary, scale double, rest double")
    placed = flat.join(counts, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("num"), F.col("tiles"))).drop("tiles")

    def blob(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[:1]
        whole = lambda name, kind: [rows[name].to_numpy(kind).tobytes()]
        return pd.DataFrame({
            "label": first["label"], "dim": first["dim"], "tile": first["tile"], "nums": whole("num", np.int64), "reps": whole("rep", np.int64),
            "weights": whole("copies", np.int64), "codes": [b"".join(rows["code"])], "scales": whole("scale", np.float64), "rests": whole("rest", np.float64),
        })

    schema = f"label {kind}, dim int, tile long, nums binary, reps binary, weights binary, codes binary, scales binary, rests binary"
    return placed.repartition("label", "dim", "tile").groupBy("label", "dim", "tile").applyInPandas(blob, schema)


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tile_rows: int = 1024,
    tile_bytes: int = 1 << 20,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    usable = base.where("vec_id is not null and v is not null and label is not null").where(~F.coalesce(bad, F.lit(True)))
    usable = usable.select("vec_id", "label", F.transform("v", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    classes = usable.groupBy("label", "v").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("copies"))
    reps = stage(classes.select(F.monotonically_increasing_id().alias("num"), "label", F.size("v").alias("dim"), "rep", "copies", "v"), "emb-reps")
    tiles = stage(_tiles(reps, tile_rows, tile_bytes), "emb-tiles")

    key = ["label", "dim", "i", "j"]
    heads = tiles.select("label", "dim", "tile")
    pairs = heads.withColumnRenamed("tile", "i").join(heads.withColumnRenamed("tile", "j"), ["label", "dim"]).where("i <= j")
    blobs = ("nums", "reps", "weights", "codes", "scales", "rests")
    side = lambda t, name: tiles.select("label", "dim", F.col("tile").alias(t), *[F.col(c).alias(f"{name}_{c}") for c in blobs])
    work = pairs.join(side("i", "a"), ["label", "dim", "i"]).join(side("j", "b"), ["label", "dim", "j"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                same = row.i == row.j
                a, b = Tile.of(row, "a"), Tile.of(row, "b")
                i, j, sure = bounded_links(a, b, threshold, same)
                if not len(i):
                    continue
                both = [a.nums, a.reps, a.weights] if same else [np.concatenate(x) for x in ((a.nums, b.nums), (a.reps, b.reps), (a.weights, b.weights))]
                shift = 0 if same else len(a.nums)
                links = _summed(*both, i[sure], j[sure] + shift)
                asked, place = np.unique(np.concatenate([i[~sure], j[~sure] + shift]), return_inverse=True)
                cells = {k: [v.tolist()] for k, v in links.items()} | {"asked": [both[0][asked].tolist()], "pairs": [place.astype(np.int32).tobytes()]}
                yield pd.DataFrame({"label": [row.label], "dim": [row.dim], "i": [row.i], "j": [row.j], **cells})

    kind = reps.schema["label"].dataType.simpleString()
    lists = ", ".join(f"{c.split()[0]} array<long>" for c in LINKS.split(", "))
    judged = stage(work.mapInPandas(compare, f"label {kind}, dim int, i long, j long, {lists}, asked array<long>, pairs binary"), "emb-judged")
    sure = judged.select(F.explode(F.arrays_zip("num", "links", "rep", "root")).alias("x")).select("x.*")

    # What the bounds leave open: the vectors concerned come in double precision, for their tile pair alone.
    open_ = judged.where(F.size("asked") > 0)
    wanted = open_.select(*key, F.posexplode("asked").alias("place", "num")).join(reps.select("num", "rep", "copies", "v"), "num")

    def decide(vectors_: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = vectors_.sort_values("place")
        i, j = np.frombuffer(asked["pairs"].iloc[0], np.int32).reshape(2, -1)
        v = np.array(rows["v"].tolist(), np.float64)
        keep = cosine_reaches(v, v, i, j, threshold)
        return pd.DataFrame(_summed(rows["num"].to_numpy(np.int64), rows["rep"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64), i[keep], j[keep]))

    theirs = open_.select(*[F.col(c).alias(f"{c}_") for c in key], "pairs").groupBy(*[f"{c}_" for c in key])
    settled = wanted.groupBy(*key).cogroup(theirs).applyInPandas(decide, LINKS)
    found = stage(sure.unionByName(settled), "emb-links")
    links = found.groupBy("num").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classed = (
        reps.select("num", "label", "v", "rep", "copies").join(links, "num", "left").join(parts, F.col("rep") == F.col("node"), "left")
        .select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    members = usable.join(classed, ["label", "v"]).select(F.col("vec_id").alias("id"), "links", "component")
    members = members.groupBy("id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    own = base.select("vec_id").join(members, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return own.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def oracle(threshold: float = 0.98) -> str:
    """The same in DuckDB SQL: all pairs of a label, and the least id reachable."""
    square = "list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
    dot = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))"
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding, sqrt({square}) AS norm FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.embedding) = len(b.embedding)
    WHERE {dot} / (a.norm * b.norm) >= {threshold}),
reach AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT links.a, root FROM reach JOIN links ON links.b = reach.vec_id),
least AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY 1),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept FROM least LEFT JOIN counted ON a = vec_id"""
