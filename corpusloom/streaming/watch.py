"""Watch mode: a stream of files keeps an index up to date, one snapshot per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.embed import Embedder
from ..operators.ingest import SUFFIXES, UNKNOWN, trust_tier, wanted
from ..plans import engine
from ..plans.store import IndexStore

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, root: str, store: IndexStore, embedder: Embedder | None, checkpoint: str, *, suffixes: Sequence[str] = SUFFIXES, exclude: Sequence[str] = (), rules: Sequence[tuple[str, str]] = (), default: str = UNKNOWN):
    """Starts a query that indexes files as they arrive under ``root``; the caller stops it.

    A batch holds new or changed files only, so it is merged with the documents known; the checkpoint folder remembers
    which files were seen.  A batch that is run again gives the same snapshot contents.
    """
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(root)
    prefix = "^file:/*" + root.strip("/") + "/"
    rel = F.regexp_replace("path", prefix, "")
    files = stream.withColumn("rel", rel).where(wanted(F.col("rel"), F.col("length"), suffixes=suffixes, exclude=exclude))
    documents = files.select(
        identity.doc_id(F.col("rel")).alias("doc_id"), "rel", identity.content_hash(F.col("content")).alias("content_hash"), F.col("length").alias("size"),
        trust_tier(F.col("rel"), rules, default).alias("trust"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("modificationTime").alias("changed_at"),
    )

    def merge(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("doc_id").agg(F.max_by(F.struct(*batch.columns), "changed_at").alias("d")).select("d.*").drop("changed_at")
        current = store.current()
        if current:
            # Known documents keep their hash and so count as unchanged; they are not read again.
            known = current.table("documents").join(latest.select("doc_id"), "doc_id", "left_anti")
            latest = latest.unionByName(known.select("doc_id", "rel", "content_hash", "size", "trust", F.lit(None).cast("string").alias("text")))
        engine.build(spark, store, latest, embedder)

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
