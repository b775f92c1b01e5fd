"""Registered queries over tables as wholes: references between them, and places in their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import integrity, ordered
from .queries import _table, query

TURN = "concat(CAST(conv_id AS VARCHAR), ':', CAST({} AS VARCHAR))"
#: Conversations as an index from which some rows were lost: every eleventh document, the second turn of every fifth, some lengths twice.
LOST_SQL = f"""documents AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS doc_id FROM conversations WHERE conv_id % 11 != 0),
turns AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, {TURN.format("turn")} AS chunk_id, CASE WHEN turn > 0 THEN {TURN.format("turn - 1")} END AS parent_chunk_id, conv_id, turn FROM conversations),
chunks AS (SELECT * FROM turns WHERE NOT (conv_id % 5 = 0 AND turn = 1)),
lengths AS (SELECT chunk_id FROM turns WHERE conv_id % 5 != 0 UNION ALL SELECT chunk_id FROM turns WHERE conv_id % 13 = 0 AND conv_id % 5 != 0)"""
_DANGLING = "SELECT '{0}' AS constraint, {1} AS value, count(*) AS rows FROM {2} WHERE {1} IS NOT NULL AND {1} NOT IN (SELECT {3} FROM {4}) GROUP BY 2"
_REPEATED = "SELECT 'one row of {0} for a {1}' AS constraint, {1} AS value, count(*) AS rows FROM {0} GROUP BY 2 HAVING count(*) > 1"


@query(f"""WITH {LOST_SQL} {" UNION ALL ".join(_DANGLING.format(*x) for x in (
    ("chunk of a document", "doc_id", "chunks", "doc_id", "documents"), ("posting of a chunk", "chunk_id", "turns", "chunk_id", "chunks"), ("length of a chunk", "chunk_id", "lengths", "chunk_id", "chunks"),
    ("vector of a chunk", "chunk_id", "turns", "chunk_id", "chunks"), ("parent of a chunk", "parent_chunk_id", "chunks", "chunk_id", "chunks")))}
    UNION ALL {" UNION ALL ".join(_REPEATED.format(*x) for x in (("documents", "doc_id"), ("chunks", "chunk_id"), ("lengths", "chunk_id")))}
    UNION ALL SELECT 'one row of vectors for a chunk_id', chunk_id, count(*) FROM turns GROUP BY 2 HAVING count(*) > 1""")
def w04_integrity(spark, sf_dir):
    """What is wrong in an index of the conversations from which rows were lost."""
    all_turns = _table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    turns = all_turns.select(
        F.col("conv_id").cast("string").alias("doc_id"), name(F.col("turn")).alias("chunk_id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_chunk_id"), "conv_id", "turn",
    )
    kept = turns.where("conv_id % 5 != 0").select("chunk_id", "conv_id")
    tables = {
        "documents": turns.where("conv_id % 11 != 0").select("doc_id").distinct(), "chunks": turns.where("not (conv_id % 5 = 0 and turn = 1)"), "postings": turns, "vectors": turns,
        "lengths": kept.unionByName(kept.where("conv_id % 13 = 0")),
    }
    return integrity.violations(tables)


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn, role, text) - 1 AS position FROM conversations")
def s05_scan_order(spark, sf_dir):
    """The place of every turn in the order in which documents and their parts were taken in."""
    return ordered.with_positions(_table(spark, sf_dir, "conversations"), ("conv_id", "turn", "role", "text")).select("conv_id", "turn", "position")
