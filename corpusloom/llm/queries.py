"""Registered queries of the corpus operators; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, filter_audit, fingerprint, language_id, license_scan, minhash, mixing, packing, quality, secrets, suffix_dedup, url_filter
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


# What SQL can say of three operators, as queries of their own: their columns without the method's part.


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    dealt = (
        op1_secret_scan, op2_near_dedup, op3_quality, op4_mix, op5_pack, op6_license_scan, op7_suffix_dedup, op8_embedding_dedup, op9_fingerprint, op10_url_filter,
        op11_filter_audit, op12_language_id,
    )
    return {f.__name__: f for f in (*dealt, secret_base_spans, mix_targets, edited_texts)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_dedup": minhash.oracle(2), "op7_suffix_dedup": suffix_dedup.oracle(), "op8_embedding_dedup": embedding_dedup.oracle(), "op10_url_filter": url_filter.oracle(),
        "op11_filter_audit": filter_audit.oracle(), "op12_language_id": language_id.oracle(),
        "secret_base_spans": secrets.oracle(), "mix_targets": mixing.oracle(), "edited_texts": fingerprint.oracle(),
    }
