"""Places of rows in the order of a whole table, found by ranges instead of one sorted task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


def with_positions(rows: DataFrame, order: Sequence[str], *, name: str = "position", ranges: int | None = None) -> DataFrame:
    """``rows`` with their places, from 0, in the order of the columns ``order`` (nulls first).

    Ranges of the order are sorted each in a task of its own and written down with the row's place in its range, so that
    files lie in order, too; then one row a range says how many rows come before it.  Rows that are equal in ``order`` have
    neighbouring places; to have the same ones in every run, ``order`` must tell all rows apart.  Ranges are cut between values, so
    rows that share all values of ``order`` are one range, however many they are; name a further column to split them.
    """
    within, taken = name, set(rows.columns)
    while within in taken:
        within += "_"
    number, columns = within + "_range", [F.col(f"`{c}`") for c in order]
    ranged = rows.repartitionByRange(ranges, *columns) if ranges else rows.repartitionByRange(*columns)
    # The lower 33 bits count the rows of a task.
    placed = ranged.sortWithinPartitions(*columns).select("*", F.spark_partition_id().alias(number), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(within + "_place"))
    written = stage(placed, "positions")
    sizes = written.groupBy(number).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select(number, before.alias(within + "_before")))  # one row a range
    return written.join(starts, number).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(within + "_before") + F.col(within + "_place")).alias(name))
