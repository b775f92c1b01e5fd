"""Exact nearest neighbours by cosine: over a table of vectors as it lies, or over blocks that most queries can skip.

``dense_search`` multiplies.  Queries of up to ``QUERY_BYTES`` together are sent to where the vectors are, which are read once and not
shuffled; more of them meet the vectors as blocks of both, in tasks of at most ``BLOCKS_A_TASK`` products.

``write_blocks`` deals vectors out to the nearest of some pivots, and within a pivot by rings of the angle to it.  Two
vectors at angles a and b from a pivot are at least |a - b| apart, so the ring of a block bounds the cosine that a query can reach
in it.  ``block_search`` first takes each query's own pivot, which gives the k-th best so far, then multiplies a query only
with blocks that could still hold something as good.  Nothing is approximate: the bound is a theorem, and pivots decide how much
is skipped, not what is found.

Edge cases: vectors that are null, zero or hold a null or a NaN have no cosine and are in no list, on either side; vectors of
different length don't meet; ``k`` below 1 gives no rows; ties after rounding to nine digits are settled by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import stage
from .ranking import top_k

QUERY_BYTES = 16 << 20
BLOCKS_A_TASK = 64
ROWS_AT_ONCE = 1024  # vectors that a task multiplies at a time
CLOSE = 2e-9  # what rounding to nine digits may hide
ANGLE_SLACK = 1e-6  # far more than the error of an arc cosine
RINGS = 4
SAMPLE = 2048  # vectors of a length among which pivots are chosen


def _usable(rows: DataFrame) -> DataFrame:
    """``id, v, dim`` of the rows that have a cosine."""
    sound = F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)) & ~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    return rows.where(sound).withColumn("dim", F.size("v"))


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), dtype=np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _kind(rows: DataFrame, name: str = "id") -> str:
    return rows.schema[name].dataType.simpleString()


def _sides(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, query_id: str, query_vector: str) -> tuple[DataFrame, DataFrame]:
    side = lambda rows, name, v: _usable(rows.select(F.col(name).alias("id"), F.col(v).alias("v")))
    return side(vectors, id_col, vector_col), side(queries, query_id, query_vector)


def _small(asked: DataFrame) -> bool:
    return (asked.agg(F.sum(8 * F.col("dim")).alias("bytes")).first()["bytes"] or 0) <= QUERY_BYTES


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row the value that a score must reach to be among its ``k`` best, or to tie with them."""
    take = min(k, scores.shape[1])
    return np.partition(scores, scores.shape[1] - take, axis=1)[:, scores.shape[1] - take] - CLOSE


def _products(q: np.ndarray, names: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> Iterator[pd.DataFrame]:
    """Scores that can be among the ``k`` best; ``floor`` holds what each query has to reach, and rises."""
    for at in range(0, len(q), 256):
        part = slice(at, at + 256)
        scores = q[part] @ v.T
        if scores.shape[1] >= k:
            floor[part] = np.maximum(floor[part], _best(scores, k))
        i, j = np.nonzero(scores >= floor[part, None])
        if len(i):
            yield pd.DataFrame({"query_id": names[at + i], "chunk_id": ids[j], "score": scores[i, j]})


def _pack(rows: DataFrame, block_rows: int, prefix: str) -> DataFrame:
    """``dim`` and, under ``prefix``, block, blocks, ids, vectors, floors: blocks of about ``block_rows`` unit vectors from ``id,
    v, dim`` and what each has to reach, ``floor``, if that is known."""
    rows = rows if "floor" in rows.columns else rows.withColumn("floor", F.lit(None).cast("double"))
    counts = rows.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks"))
    # One row per length of vectors, of which there are a few.
    placed = rows.join(F.broadcast(counts), "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[:1]
        lists = {"ids": [group["id"].tolist()], "vectors": [_unit(group["v"]).tobytes()], "floors": [group["floor"].fillna(-np.inf).tolist()]}
        return pd.DataFrame({c: first[c].to_numpy() for c in ("dim", "block", "blocks")} | lists)

    dealt = placed.repartition("dim", "block").groupBy("dim", "block")
    packed = dealt.applyInPandas(pack, f"dim int, block long, blocks long, ids array<{_kind(rows)}>, vectors binary, floors array<double>")
    return packed.select("dim", *[F.col(c).alias(f"{prefix}_{c}") for c in ("block", "blocks", "ids", "vectors", "floors")])


def _meet(left: DataFrame, right: DataFrame, small: bool) -> DataFrame:
    """Each block of vectors beside each block of queries of its length."""
    if small:
        return left.join(F.broadcast(right), "dim")
    # A block of queries is copied once for every BLOCKS_A_TASK blocks of vectors, each block of vectors once for every
    # block of queries; a key then holds at most about that many products.
    numbers = left.groupBy("dim").agg(F.max("v_blocks").alias("v_many")).join(right.groupBy("dim").agg(F.max("q_blocks").alias("q_many")), "dim")
    many = F.broadcast(numbers.withColumn("salts", F.ceil(F.col("v_many") / BLOCKS_A_TASK).cast("long")))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    sent = left.join(many, "dim").withColumn("q_block", upto("q_many")).withColumn("salt", F.pmod(F.xxhash64("v_block"), F.col("salts"))).drop("v_many", "q_many", "salts")
    copied = right.join(many.select("dim", "salts"), "dim").withColumn("salt", upto("salts")).drop("salts")
    return sent.join(copied, ["dim", "q_block", "salt"])


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema + ", rank int")


def dense_search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    *,
    allow: DataFrame | None = None,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    block_rows: int = 2048,
) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the best ``k`` of each query; ``allow`` (a frame with the id column) restricts the
    candidates first."""
    if allow is not None:
        vectors = vectors.join(allow.select(id_col).distinct(), id_col, "left_semi")
    base, asked = _sides(vectors, queries, id_col, vector_col, query_id, query_vector)
    schema = f"query_id {_kind(asked)}, chunk_id {_kind(base)}, score double"
    if k < 1:
        return _empty(base.sparkSession, schema)
    if _small(asked):
        rows = asked.toPandas()
        sent = {int(dim): (_unit(g["v"]), g["id"].to_numpy()) for dim, g in rows.groupby("dim")}

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            floors = {dim: np.full(len(q), -np.inf) for dim, (q, _) in sent.items()}
            for part in (batch.iloc[at : at + ROWS_AT_ONCE] for batch in batches for at in range(0, len(batch), ROWS_AT_ONCE)):
                for dim, group in part.groupby("dim"):
                    if dim in sent:
                        yield from _products(*sent[dim], _unit(group["v"]), group["id"].to_numpy(), k, floors[dim])

        # A few rows a query, written while some megabytes of vectors at a time go to Python.
        return stage(top_k(base.mapInPandas(near, schema), k), "near")

    return top_k(_multiplied(_meet(_pack(base, block_rows, "v"), _pack(asked, block_rows, "q"), False), schema, k), k)


def _multiplied(work: DataFrame, schema: str, k: int, chosen: Callable | None = None) -> DataFrame:
    """Scores of blocks beside blocks; ``chosen`` says which queries of a row have to be multiplied with its vectors."""

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                q, v = (np.frombuffer(x).reshape(-1, row.dim) for x in (row.q_vectors, row.v_vectors))
                floor, names = np.array(row.q_floors) - CLOSE, np.asarray(row.q_ids)
                mask = chosen(row, q) if chosen else np.ones(len(q), bool)
                if mask.any():
                    yield from _products(q[mask], names[mask], v, np.asarray(row.v_ids), k, floor[mask])

    return work.drop("v_block", "v_blocks", "q_block", "q_blocks", "salt").mapInPandas(multiply, schema)


@dataclass(frozen=True)
class DenseIndex:
    """``blocks``: dim, pivot, ring, salt, lo, hi, v_ids, v_vectors; ``pivots``: dim, pivot, v."""

    blocks: DataFrame
    pivots: DataFrame


def spread(sample: np.ndarray, many: int) -> np.ndarray:
    """Up to ``many`` rows of unit vectors, each the farthest from those taken before."""
    taken, nearest = [0], sample @ sample[0]
    while len(taken) < min(many, len(sample)):
        far = int(np.argmin(nearest))
        if nearest[far] >= 1 - 1e-9:  # the rest repeats what was taken
            break
        taken.append(far)
        nearest = np.maximum(nearest, sample @ sample[far])
    return sample[taken]


def _pivot_table(index_pivots: DataFrame) -> dict[int, np.ndarray]:
    rows = index_pivots.orderBy("dim", "pivot").collect()  # as many rows as pivots were asked for, for each length
    return {dim: np.array([r["v"] for r in rows if r["dim"] == dim]) for dim in {r["dim"] for r in rows}}


def write_blocks(vectors: DataFrame, path: str, *, id_col: str = "chunk_id", vector_col: str = "embedding", pivots: int = 64, block_rows: int = 1024) -> DenseIndex:
    """Writes ``vectors`` as blocks under ``path``.  Pivots come from ``SAMPLE`` vectors of each length, those with the
    least hashes of their ids; vectors are shuffled once, and a pivot that holds a third of them is many blocks."""
    spark = vectors.sparkSession
    base = _usable(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")))
    kind = _kind(base)
    least = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id")
    sample = base.withColumn("place", F.row_number().over(least)).where(F.col("place") <= SAMPLE).orderBy("dim", "place").select("dim", "v").toPandas()
    centres = {int(dim): spread(_unit(g["v"]), pivots) for dim, g in sample.groupby("dim")}
    rows = [(dim, n, [float(x) for x in v]) for dim, table in centres.items() for n, v in enumerate(table)]
    spark.createDataFrame(rows, "dim int, pivot int, v array<double>").write.parquet(f"{path}/pivots")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, group in batch.groupby("dim"):
                cosines = _unit(group["v"]) @ centres[dim].T
                own = np.argmax(cosines, axis=1)
                angle = np.arccos(np.clip(cosines[np.arange(len(own)), own], -1, 1))
                yield pd.DataFrame({"dim": dim, "pivot": own, "angle": angle, "id": group["id"].to_numpy(), "v": group["v"].to_numpy()})

    assigned = stage(base.select("dim", "id", "v").mapInPandas(assign, f"dim int, pivot int, angle double, id {kind}, v {_kind(base, 'v')}"), "assigned")
    # A row for each pivot, then for each of its rings: as many as the parameters allow.
    cuts = assigned.groupBy("dim", "pivot").agg(F.percentile_approx("angle", F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)]), F.lit(1000)).alias("cuts"))
    ringed = assigned.join(F.broadcast(cuts), ["dim", "pivot"]).withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("angle")))).drop("cuts")
    counts = ringed.groupBy("dim", "pivot", "ring").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("salts"))
    salted = ringed.join(F.broadcast(counts), ["dim", "pivot", "ring"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).drop("salts")
    keys = ["dim", "pivot", "ring", "salt"]

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[:1]
        facts = {"lo": [group["angle"].min()], "hi": [group["angle"].max()], "v_ids": [group["id"].tolist()], "v_vectors": [_unit(group["v"]).tobytes()]}
        return pd.DataFrame({c: first[c].to_numpy() for c in keys} | facts)

    packed = salted.repartition(*keys).groupBy(*keys).applyInPandas(pack, f"dim int, pivot int, ring int, salt long, lo double, hi double, v_ids array<{kind}>, v_vectors binary")
    packed.write.parquet(f"{path}/blocks")
    return read_blocks(spark, path, id_type=kind)


def read_blocks(spark: SparkSession, path: str, *, id_type: str = "string") -> DenseIndex:
    """The blocks under ``path`` of vectors whose ids are of ``id_type``."""
    blocks = spark.read.schema(f"dim int, pivot int, ring int, salt long, lo double, hi double, v_ids array<{id_type}>, v_vectors binary").parquet(f"{path}/blocks")
    return DenseIndex(blocks, spark.read.schema("dim int, pivot int, v array<double>").parquet(f"{path}/pivots"))


def reach(angles: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The greatest cosine that vectors at ``lo`` to ``hi`` from a pivot can have with queries at ``angles`` from it."""
    return np.cos(np.maximum(0.0, np.maximum(lo - angles, angles - hi) - ANGLE_SLACK))


class _Search:
    """One search over an index: queries, pivots, and rows of blocks beside queries."""

    def __init__(self, index: DenseIndex, queries: DataFrame, k: int, query_id: str, query_vector: str, block_rows: int):
        self.index, self.k, self.block_rows = index, k, block_rows
        self.asked = stage(_usable(queries.select(F.col(query_id).alias("id"), F.col(query_vector).alias("v"))), "asked")
        self.small, self.centres = _small(self.asked), _pivot_table(index.pivots)
        self.schema = f"query_id {_kind(self.asked)}, chunk_id {index.blocks.schema['v_ids'].dataType.elementType.simpleString()}, score double"

    def beside(self, blocks: DataFrame, asked: DataFrame) -> DataFrame:
        sizes = blocks.groupBy("dim").agg(F.count("*").alias("v_blocks"))
        numbered = blocks.withColumn("v_block", F.xxhash64("pivot", "ring", "salt")).drop("salt")
        return _meet(numbered.join(F.broadcast(sizes), "dim"), _pack(asked, self.block_rows, "q"), self.small)

    def floors(self) -> DataFrame:
        """The queries with ``floor``, the k-th best that the first blocks of their own pivot hold."""
        centres = self.centres
        own = lambda row, q: np.argmax(q @ centres[row.dim].T, axis=1) == row.pivot
        first = top_k(_multiplied(self.beside(self.index.blocks.where("salt = 0"), self.asked), self.schema, self.k, own), self.k)
        reached = first.where(F.col("rank") == self.k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        return stage(self.asked.join(reached, "id", "left"), "floors")

    def able(self) -> Callable:
        centres = self.centres

        def test(row, q: np.ndarray) -> np.ndarray:
            angles = np.arccos(np.clip(q @ centres[row.dim][row.pivot], -1, 1))
            return reach(angles, row.lo, row.hi) >= np.array(row.q_floors) - CLOSE

        return test


def block_search(index: DenseIndex, queries: DataFrame, k: int = 20, *, query_id: str = "query_id", query_vector: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """``query_id, chunk_id, score, rank`` as ``dense_search`` gives them over all vectors of the index."""
    search = _Search(index, queries, k, query_id, query_vector, block_rows)
    if k < 1:
        return _empty(queries.sparkSession, search.schema)
    return top_k(_multiplied(search.beside(index.blocks, search.floors()), search.schema, k, search.able()), k)


def blocks_met(index: DenseIndex, queries: DataFrame, k: int = 20, *, query_id: str = "query_id", query_vector: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """``query_id, blocks, multiplied``: how many blocks of its length there are for a query, and how many it must meet."""
    search = _Search(index, queries, k, query_id, query_vector, block_rows)
    able = search.able()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame({"query_id": row.q_ids, "met": able(row, np.frombuffer(row.q_vectors).reshape(-1, row.dim)).astype(int)})

    work = search.beside(index.blocks, search.floors()).select("dim", "pivot", "lo", "hi", "q_ids", "q_vectors", "q_floors")
    return work.mapInPandas(count, f"query_id {_kind(search.asked)}, met int").groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum("met").alias("multiplied"))
