"""Vector table operations: latest-wins upsert, delete, statistics, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import VectorStoreError


def check(vectors: DataFrame, dim: int, *, vector_col: str = "embedding") -> DataFrame:
    """The same rows; the job fails on a vector that is null or of another length."""
    ok = F.coalesce(F.size(vector_col) == dim, F.lit(False))
    return vectors.withColumn(vector_col, F.when(ok, F.col(vector_col)).otherwise(F.raise_error(F.lit(f"a vector does not have {dim} components"))))


def upsert(current: DataFrame, new: DataFrame, *, id_col: str = "chunk_id", order_col: str | None = None) -> DataFrame:
    """``new`` replaces rows of its ids and adds the others.  Of rows of ``new`` with one id the last by ``order_col`` stays (a column
    that both have), and of those that tie, or without such a column, the greatest."""
    if set(current.columns) != set(new.columns):
        raise VectorStoreError(f"columns differ: {sorted(current.columns)} and {sorted(new.columns)}")
    whole = F.struct(*[F.col(f"`{c}`") for c in current.columns])
    last = new.groupBy(F.col(id_col).alias("_id")).agg(F.max_by(whole, F.struct(F.col(order_col), whole) if order_col else whole).alias("_row"))
    return current.join(new.select(id_col).distinct(), id_col, "left_anti").select(*current.columns).unionByName(last.select("_row.*"))


def delete(current: DataFrame, ids: DataFrame, *, id_col: str = "chunk_id") -> DataFrame:
    """Without the rows of ``ids``; absent ids do no harm."""
    return current.join(ids.select(id_col).distinct(), id_col, "left_anti").select(*current.columns)


def stats(vectors: DataFrame, *, vector_col: str = "embedding") -> DataFrame:
    """One row: count, dim, bytes (4 a component)."""
    return vectors.agg(F.count("*").alias("count"), F.coalesce(F.max(F.size(vector_col)), F.lit(0)).alias("dim"), F.coalesce(F.sum(F.size(vector_col) * 4), F.lit(0)).alias("bytes"))
