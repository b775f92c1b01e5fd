"""Scope, trust and ingest as expressions and joins over file and document rows."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import TIERS

# What is never indexed, whatever the configuration says, and the defaults.
ALWAYS_EXCLUDED = tuple(
    ".env .env.* *.pem *.key *.p12 *.pfx id_rsa id_ed25519 credentials credentials.json token.json *.credentials .netrc .npmrc .pypirc "
    ".git .hg .svn node_modules __pycache__ .venv venv site-packages .tox .mypy_cache .pytest_cache .ruff_cache dist build target .next .cache".split()
)
SUFFIXES = (".md", ".markdown")
MAX_BYTES = 2_000_000
UNKNOWN = "unknown"


def glob_regex(pattern: str) -> str:
    """A Java pattern for a whole string, from a shell glob in which ``*`` also crosses ``/``."""
    return "^" + fnmatch.translate(pattern).replace(r"\Z", r"\z")


def matches_glob(rel: Column, pattern: str) -> Column:
    """A pattern with ``/`` is matched with the whole path, another with each of its components."""
    regex = glob_regex(pattern)
    return rel.rlike(regex) if "/" in pattern else F.exists(F.split(rel, "/"), lambda part: part.rlike(regex))


def wanted(rel: Column, length: Column, *, suffixes: Sequence[str] = SUFFIXES, exclude: Sequence[str] = (), max_bytes: int = MAX_BYTES) -> Column:
    """Cheap tests first: suffix (the file's is lower-cased, the configured ones are not), exclusions, size."""
    suffix = F.lower(F.regexp_extract(rel, r"[^/](\.[^./]+)$", 1))
    patterns = dict.fromkeys((*exclude, *ALWAYS_EXCLUDED))
    excluded = F.lit(False)
    for p in patterns:
        excluded = excluded | matches_glob(rel, p)
    return suffix.isin(*suffixes) & ~excluded & (length <= max_bytes)


def trust_tier(rel: Column, rules: Sequence[tuple[str, str]], default: str = UNKNOWN) -> Column:
    """The tier of the first rule (pattern, tier) that matches; rules with unknown tiers or blank patterns don't count."""
    out = None
    for pattern, tier in rules:
        if pattern.strip() and tier in TIERS:
            test = matches_glob(rel, pattern)
            out = F.when(test, tier) if out is None else out.when(test, tier)
    fallback = F.lit(default if default in TIERS else UNKNOWN)
    return fallback if out is None else out.otherwise(fallback)


def scope_report(files: DataFrame) -> DataFrame:
    """Files and bytes of each root, from names and lengths alone."""
    return files.groupBy("root").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def plan(found: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, status``: added, changed, unchanged or removed, by a full outer join on id; ids are distinct per side."""
    a = found.select("doc_id", F.col("content_hash").alias("new_hash"), F.lit(True).alias("is_found"))
    b = known.select("doc_id", F.col("content_hash").alias("old_hash"), F.lit(True).alias("is_known"))
    status = (
        F.when(F.col("is_known").isNull(), "added").when(F.col("is_found").isNull(), "removed")
        .when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("changed")
    )
    return a.join(b, "doc_id", "full_outer").select("doc_id", status.alias("status"))


def work(planned: DataFrame) -> DataFrame:
    return planned.where(F.col("status").isin("added", "changed")).select("doc_id")


def removed(found: DataFrame, known: DataFrame) -> DataFrame:
    return known.select("doc_id").join(found.select("doc_id"), "doc_id", "left_anti")


def replace_documents(current: DataFrame, new: DataFrame, drop: DataFrame) -> DataFrame:
    """Rows of the documents in ``drop`` go, ``new`` rows come: a new snapshot of a table with a doc_id."""
    return current.join(drop.select("doc_id").distinct(), "doc_id", "left_anti").select(*current.columns).unionByName(new)


def drop_documents(chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the chunks that stay, ``chunk_id`` of those that go with their documents); both from one table of chunks."""
    ids = gone.select("doc_id").distinct()
    return chunks.join(ids, "doc_id", "left_anti"), chunks.join(ids, "doc_id", "left_semi").select("chunk_id")
