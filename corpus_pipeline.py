"""From raw documents to packed training sequences.

Each stage takes what the one before it kept, written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import minhash, mixing, packing, quality, secrets
from corpusloom.llm.common import stage, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on the labelled ones outside the held-out third, rejects.

    Null texts are scored as empty ones; without labels of both kinds all rows have one score, so all stay or all go.  Rows that
    repeat an id are judged each; null ids are not held out; further columns stay as they are, whatever their names.
    """
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8), that of least id.

    Null and empty texts are like nothing and stay, as do rows without an id; of rows that repeat an id one stays, the same
    in every run; further columns stay with their row.
    """
    return minhash.deduplicate(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every found secret; the documents stay.

    Null texts stay null, and their ``n_chars`` as it was; of other texts it is counted anew.  Rows that repeat an id are each
    cleared; a row's other columns stay.
    """
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources asks for; a copy is a row with the same doc_id.

    A null source is a source of its own.  Rows without words (null, empty or blank texts) stay once; rows that repeat an id or
    have none are taken each by itself; further columns stay with their row.
    """
    return mixing.take(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all rows into sequences; one row per piece.

    Null and empty texts are one separator; long ones are cut into pieces; rows that repeat an id are packed each; a null id
    is kept; further columns are dropped.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("secret_redaction", secret_redaction),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

#: Classifier, MinHash and tokenizer have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
