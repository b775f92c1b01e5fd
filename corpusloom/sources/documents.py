"""Files of a scope as a DataFrame of documents."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..operators.ingest import UNKNOWN, trust_tier
from .scope import ScopePolicy


def _escaped(path: str) -> str:
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def discover(spark: SparkSession, policy: ScopePolicy, rules: Sequence[tuple[str, str]] = (), default: str = UNKNOWN) -> DataFrame:
    """``doc_id, rel, root, content_hash, size, trust, text`` of every file in scope; unreadable files are left out.

    Only the listed files are opened.  Bytes that are no UTF-8 become replacement characters; identity is of the raw bytes.
    """
    listed = [(path.as_uri(), str(root), rel) for path, root, rel in policy.listing()]
    schema = "uri string, root string, rel string"
    names = spark.createDataFrame(listed, schema)
    if not listed:
        content = spark.createDataFrame([], "uri string, content binary, size long")
    else:
        reader = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        content = reader.load([_escaped(str(p)) for p, _, _ in policy.listing()]).select("path", "content", F.col("length").alias("size"))
        # Spark writes file:/x (unescaped), a URI file:///x (escaped).
        names = names.withColumn("key", F.url_decode(F.regexp_replace(F.regexp_replace("uri", r"\+", "%2B"), "^file://", "")))
        content = content.withColumn("key", F.regexp_replace("path", "^file:/*", "/"))
        return _documents(names.join(content, "key"), rules, default)
    return _documents(names.join(content, "uri"), rules, default)


def _documents(rows: DataFrame, rules: Sequence[tuple[str, str]], default: str) -> DataFrame:
    return rows.select(
        identity.doc_id(F.col("rel")).alias("doc_id"), "rel", "root", identity.content_hash(F.col("content")).alias("content_hash"), F.col("size").cast("long").alias("size"),
        trust_tier(F.col("rel"), rules, default).alias("trust"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )
