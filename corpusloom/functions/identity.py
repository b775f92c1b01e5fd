"""Identity: hashes of bytes and of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """SHA-256 of the raw bytes; never of times or names."""
    return F.sha2(content.cast("binary"), 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def doc_id(rel: Column) -> Column:
    """From the path, so an edited document keeps its identity."""
    return short_hash(rel)


def chunk_id(doc: Column, ordinal: Column, part: Column) -> Column:
    return short_hash(F.concat_ws(":", doc, ordinal.cast("string"), part.cast("string")))
