"""Job 1: keeps a table of citable chunks up to date with a growing folder of text tables.

    python jobs/chunk_feed.py --source data/documents.parquet --output out --checkpoint ckpt --config jobs/chunk_feed.yaml

``source`` is a folder of Parquet files, or a pattern of files and folders.  A file stream takes the files that came since the last run (``availableNow``, a bounded number at a time) and ends.  Per micro-batch
each document is compared with the last version known: one with the same content is left alone, one that is new or
changed is split into chunks, and one whose text is null or that the rules exclude goes.  What a batch found out is written
under its own number:

    output/documents/batch=<n>/                 doc_id, rel, root, trust, content_hash, size, status
    output/chunks/batch=<n>/root=<source>/      the chunks of documents that are new or changed in that batch

A document's chunks are those of its last batch; ``current`` reads them.  A batch replaces its own partitions alone and
compares with earlier numbers alone, so one that is run again after a failure writes the same rows once more.  Output and
checkpoint belong together: start a new output with a new checkpoint, also to have documents split by other settings, since
those with the same content are left alone.

Within a batch the version of the latest file counts, and of equally late ones that with the greatest content hash.
A null id is no document.  Texts are read twice (for their hashes, then for their chunks) and shuffled once, to write
files of an even size for each root, a large root as several.  What is decided is decided on ids, hashes and places; versions
that are not to be split are taken out by an anti-join on file and row number, and there are few of them unless a delivery
repeats what is known.
"""

from __future__ import annotations

import logging
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusloom.functions import identity  # noqa: E402
from corpusloom.operators import chunking, ingest  # noqa: E402
from corpusloom.staging import bounded_batches, stage, staged  # noqa: E402
from jobs.common import command_line, settings  # noqa: E402

log = logging.getLogger("jobs.chunk_feed")

DEFAULTS = {
    "max_files_per_batch": 64, "max_chars": chunking.MAX_CHARS, "overlap": chunking.OVERLAP, "min_chars": chunking.MIN_CHARS, "max_bytes": ingest.MAX_BYTES,
    "exclude": [], "trust_rules": [], "default_tier": ingest.UNKNOWN,
}
SOURCE_SCHEMA = "doc_id bigint, text string, source string"
STATE_SCHEMA = "doc_id string, rel string, root string, trust string, content_hash string, size bigint, status string, batch bigint"
CHUNK_COLUMNS = ("chunk_id", "doc_id", "doc_rel", "citation", "trust", "part", "parts", "text")
CHUNK_SCHEMA = "chunk_id string, doc_id string, doc_rel string, citation string, trust string, part int, parts int, text string, batch bigint, root string"


def _versions(batch: DataFrame, config: dict) -> DataFrame:
    """Every version in a batch: its place, and of whom it is what; ``content_hash`` is null if the document is to go."""
    rel = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    size = F.octet_length("text").cast("long")
    keep = F.col("text").isNotNull() & ingest.wanted(rel, size, exclude=config["exclude"], max_bytes=config["max_bytes"])
    rules = [tuple(rule) for rule in config["trust_rules"]]
    return batch.where("doc_id is not null").select(
        identity.doc_id(rel).alias("doc_id"), rel.alias("rel"), F.coalesce("source", F.lit("")).alias("root"), ingest.trust_tier(rel, rules, config["default_tier"]).alias("trust"),
        F.when(keep, identity.content_hash(F.col("text"))).alias("content_hash"), size.alias("size"), "text", "file_path", "row_index", "modified",
    )


def _decide(versions: DataFrame, before: DataFrame) -> DataFrame:
    """The version of each document that counts, with its ``status`` against the last of the versions ``before``."""
    # What is known of other documents is read, as narrow columns, and left where it is.
    known = last_versions(before.join(versions.select("doc_id").distinct(), "doc_id", "left_semi"))
    order = F.struct("modified", F.coalesce("content_hash", F.lit("")), "file_path", "row_index")
    latest = versions.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in versions.columns if c != "doc_id"]), order).alias("v"))
    joined = latest.select("doc_id", "v.*").join(known.select("doc_id", F.col("content_hash").alias("old")), "doc_id", "left")
    new, old = F.col("content_hash").isNotNull(), F.col("old").isNotNull()
    status = F.when(new & ~old, "added").when(new & (F.col("old") == F.col("content_hash")), "unchanged").when(new, "changed").when(old, "removed").otherwise("absent")
    return joined.withColumn("status", status).drop("old")


def state(spark: SparkSession, output: str) -> DataFrame:
    """All versions that were ever written down."""
    return spark.read.schema(STATE_SCHEMA).parquet(f"{output}/documents")


def last_versions(versions: DataFrame) -> DataFrame:
    """``doc_id, content_hash, batch``: of each document the version of its last batch; the hash is null of those that went."""
    last = versions.groupBy("doc_id").agg(F.max_by(F.struct("content_hash", "batch"), "batch").alias("v"))
    return last.select("doc_id", "v.content_hash", "v.batch")


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of the documents as they stand."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{output}/chunks")
    versions = state(spark, output).select("doc_id", "batch")
    # Only documents with several versions have old ones; as long as those are few, chunks need not be shuffled.
    last = versions.groupBy("doc_id").agg(F.max("batch").alias("last"), F.count("*").alias("n")).where("n > 1")
    # Written, so that it's known to be small before chunks would be shuffled to meet it.
    old = stage(versions.join(last, "doc_id").where("batch < last").select("doc_id", "batch"), "old-versions")
    return chunks.withColumn("root", F.coalesce("root", F.lit(""))).join(old, ["doc_id", "batch"], "left_anti")


def take_batch(spark: SparkSession, batch: DataFrame, number: int, output: str, config: dict) -> dict[str, int]:
    """Writes what micro-batch ``number`` says under its number; the documents by status."""
    began = time.monotonic()
    versions = _versions(batch, config)
    before = state(spark, output).where(F.col("batch") < number) if number else spark.createDataFrame([], STATE_SCHEMA)
    place, under = ["file_path", "row_index"], F.lit(number).cast("long").alias("batch")
    into = lambda rows, name, *by: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(f"{output}/{name}")
    with staged(versions.drop("text"), "versions") as narrow, staged(_decide(narrow, before), "decided") as decided:
        into(decided.where("status not in ('unchanged', 'absent')").select("doc_id", "rel", "root", "trust", "content_hash", "size", "status", under), "documents")
        other = narrow.join(decided.where("status in ('added', 'changed')"), place, "left_anti").select(place)
        split = versions.join(other, place, "left_anti").select("doc_id", "rel", "trust", "text")
        made = chunking.chunks(split, max_chars=config["max_chars"], overlap=config["overlap"], min_chars=config["min_chars"])
        rows = made.select(*CHUNK_COLUMNS, under, F.regexp_extract("doc_rel", "^(.*)/[^/]*$", 1).alias("root"))
        with bounded_batches(spark):
            into(rows.hint("rebalance", "root"), "chunks", "root")
        counts = {r["status"]: r["n"] for r in decided.groupBy("status").agg(F.count("*").alias("n")).collect()}
    said = ", ".join(f"{counts[s]} {s}" for s in sorted(counts)) or "none"
    log.info("batch %d: documents %s; written to %s/documents and %s/chunks in %.1f s", number, said, output, output, time.monotonic() - began)
    return counts


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> list[dict[str, int]]:
    """Takes what is new under ``source``; for each micro-batch that this made, its documents by status."""
    config, taken = settings(config, DEFAULTS), []
    stream = spark.readStream.schema(SOURCE_SCHEMA).option("maxFilesPerTrigger", int(config["max_files_per_batch"])).parquet(source)
    placed = stream.select("*", "_metadata.file_path", "_metadata.row_index", F.col("_metadata.file_modification_time").alias("modified"))
    log.info("reading %s, checkpoint %s", source, checkpoint)
    query = (
        placed.writeStream.foreachBatch(lambda batch, number: taken.append(take_batch(batch.sparkSession, batch, number, output, config)))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("%d batches with %d documents read from %s", len(taken), sum(sum(t.values()) for t in taken), source)
    return taken


if __name__ == "__main__":
    sys.exit(command_line(run, ("source", "output", "checkpoint"), DEFAULTS, __doc__))
