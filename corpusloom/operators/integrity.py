"""References between tables: which values of a column name no row of the table that they refer to."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """Values of ``child.column`` must be among those of ``parent.key``; nulls refer to nothing."""

    name: str
    child: str
    column: str
    parent: str
    key: str


#: What the tables of an index owe each other.
INDEX_REFERENCES = (
    Reference("chunk of a document", "chunks", "doc_id", "documents", "doc_id"), Reference("posting of a chunk", "postings", "chunk_id", "chunks", "chunk_id"),
    Reference("length of a chunk", "lengths", "chunk_id", "chunks", "chunk_id"), Reference("vector of a chunk", "vectors", "chunk_id", "chunks", "chunk_id"),
    Reference("parent of a chunk", "chunks", "parent_chunk_id", "chunks", "chunk_id"),
)
#: Ids that must not repeat, by table.
INDEX_KEYS = (("documents", "doc_id"), ("chunks", "chunk_id"), ("lengths", "chunk_id"), ("vectors", "chunk_id"))


def dangling(tables: Mapping[str, DataFrame], references: Iterable[Reference]) -> DataFrame:
    """``constraint, value, rows``: each value that is missing from the table referred to, and how many rows have it.

    Children are counted by value before they meet their parents, so a value that a third of all rows share is one row,
    and only keys are read on either side.
    """
    found = []
    for r in references:
        values = tables[r.child].where(F.col(r.column).isNotNull()).groupBy(F.col(r.column).alias("value")).agg(F.count("*").alias("rows"))
        missing = values.join(tables[r.parent].select(F.col(r.key).alias("value")), "value", "left_anti")
        found.append(missing.select(F.lit(r.name).alias("constraint"), F.col("value").cast("string").alias("value"), "rows"))
    return reduce(DataFrame.unionByName, found)


def repeated(tables: Mapping[str, DataFrame], keys: Iterable[tuple[str, str]]) -> DataFrame:
    """``constraint, value, rows``: each value of a key that several rows have; a null counts as a value."""
    counts = [tables[t].groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("rows")).where("rows > 1").select(F.lit(f"one row of {t} for a {c}").alias("constraint"), "value", "rows") for t, c in keys]
    return reduce(DataFrame.unionByName, counts)


def violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """What is wrong between and within the tables of an index; no rows if nothing is."""
    return dangling(tables, INDEX_REFERENCES).unionByName(repeated(tables, INDEX_KEYS))
