"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session on one machine, as in tests, may do without: it gets a folder of its own.
    """
    ctx = spark.sparkContext
    current = ctx._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not ctx.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="corpusloom-")
    ctx.setCheckpointDir(configured)
    return ctx._jsc.sc().getCheckpointDir().get()


BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile some megabytes at a time go to Python, whatever the length of the rows, unless the session sets a bound
    itself."""
    free = spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT
    if free:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    try:
        yield
    finally:
        if free:
            spark.conf.unset(BATCH_KEY)


def stage(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    with bounded_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_repeated(rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id is theirs alone, and those whose id is null or repeats, if there are any.  Only ids are shuffled to find out;
    what repeats is written, so that the rows stay where they are as long as it is little."""
    many = stage(rows.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1 or _id is null").select("_id"), "repeated-ids")
    if many.isEmpty():
        return rows, None
    same = rows[id_col].eqNullSafe(many["_id"])
    return rows.join(many, same, "left_anti"), rows.join(many, same, "left_semi")


@contextmanager
def staged(df: DataFrame, label: str = "t") -> Iterator[DataFrame]:
    """As ``stage``, for as long as the block runs; then the files go."""
    path = os.path.join(shared_dir(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    try:
        with bounded_batches(df.sparkSession):
            df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        discard(df.sparkSession, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove files of the shared folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
