"""Mixing sources to target weights by entropy balancing.

Sources in code point order (null last) get weights 5, 2, 1, 5, ...; they share all words of the table by
weight, but none gets more than ``max_copies`` times its own words: the excess goes to the others.  Document
rates are the solution of a convex problem: stay as near (in relative entropy) to one copy each as the token
constraint of the source allows, between 0 and ``max_copies``.  Its dual has one multiplier per source and gives
exponentially tilted rates ``min(max_copies, exp(lambda * size / mean size))``; safeguarded Newton steps find the
multipliers from sums over a (source, size) histogram.  Rates are rounded into whole copies size by size, each
carrying its rest on to the next, so a source misses its target by about one small document.

Edge cases: null or blank texts have size 0 and are not taken (0 words either way); a null source is a source of
its own, the last; sources without words have target 0; rows are numbered, so rows that repeat an id or have none are
separate documents (equal ones may get different numbers of copies); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SQL, stage, text_or_empty


def source_targets(sized: DataFrame, weights: Sequence[float], max_copies: float) -> DataFrame:
    """``source, sid, source_size, n_docs, target``: water-filling over one row per source."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("sid", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
    )
    cap = F.col("source_size") * float(max_copies)
    by_ratio = Window.orderBy("ratio", "sid")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ranked.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = level.withColumn("level", (F.sum("source_size").over(everything) - before) / left)
    # Below the first source that the common level doesn't fill, all are full.
    free = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    return level.withColumn("target", F.when(F.col("ratio") <= F.col("level"), F.col("cap")).otherwise(F.col("weight") * free)).select(
        "source", "sid", "source_size", "n_docs", "target"
    )


def _solve(hist: DataFrame, sources: DataFrame, max_copies: float, steps: int, tolerance: float) -> DataFrame:
    """``sid, lam`` by Newton steps, each one aggregation of the histogram; a step that leaves the bracket is halved."""
    top = float(max_copies)
    open_ = (F.col("target") > 0) & (F.col("target") < top * F.col("source_size") * (1 - 1e-9))
    state = sources.select(
        "sid", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"), open_.alias("open"), F.lit(0.0).alias("lam"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("miss"),
    )
    state = stage(state, "mix-state")
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        sums = (
            hist.join(state.where("open and (miss is null or miss > %r)" % tolerance), "sid")
            .groupBy("sid")
            .agg(F.sum(words * F.least(rate, F.lit(top))).alias("g"), F.sum(F.when(rate < top, words * x * rate).otherwise(0.0)).alias("h"))
        )
        gap = F.col("g") - F.col("target")
        lo = F.when(gap <= 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        moved = state.join(sums, "sid", "left").withColumns({"lo2": lo, "hi2": hi, "newton": F.col("lam") - F.when(F.col("h") > 0, gap / F.col("h"))})
        width = F.greatest(F.lit(1.0), F.abs("lam"))
        outside = F.col("newton").isNull() | (F.col("newton") <= F.col("lo2")) | (F.col("newton") >= F.col("hi2"))
        fallback = F.coalesce((F.col("lo2") + F.col("hi2")) / 2, F.when(gap > 0, F.col("lam") - width).otherwise(F.col("lam") + width))
        step = F.when(F.coalesce(outside, F.lit(False)), fallback).otherwise(F.greatest(F.least("newton", F.col("lam") + 2 * width), F.col("lam") - 2 * width))
        idle = F.col("g").isNull()
        miss = F.abs(gap) / F.col("target")
        keep = idle | (miss <= tolerance)
        state = stage(
            moved.select(
                "sid", "target", "mean", "open", F.when(keep, F.col("lam")).otherwise(step).alias("lam"),
                F.when(idle, F.col("lo")).otherwise(F.col("lo2")).alias("lo"), F.when(idle, F.col("hi")).otherwise(F.col("hi2")).alias("hi"),
                F.when(idle, F.col("miss")).otherwise(miss).alias("miss"),
            ),
            "mix-state",
        )
        if state.where("open").agg(F.coalesce(F.max("miss"), F.lit(0.0)).alias("m")).first()["m"] <= tolerance:
            break
    return state.select("sid", "lam", "mean", "open")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    max_copies: int = 3,
    newton_steps: int = 40,
    tolerance: float = 1e-6,
    cell_rows: int = 512,
    row_col: str | None = None,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, rate``, one row per document; also ``row``, the number that
    ``row_col`` holds for each row, where it is given.

    The documents' words are counted once; all later steps use (id, source, size) rows.  Which of the equally
    long documents of a source get the extra copy is decided by a hash of the id, in subcells of about
    ``cell_rows`` rows so that a hot cell spreads over tasks.
    """
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD_SQL)).cast("long")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sized = stage(docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")), "mix-sizes")
    sources = stage(source_targets(sized, weights, max_copies), "mix-sources")
    tagged = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("row", "doc_id", "size", "sid", "source_size", "target")
    hist = stage(tagged.groupBy("sid", "size", "source_size", "target").agg(F.count("*").alias("n")), "mix-hist")
    solved = _solve(hist.select("sid", "size", "n"), sources, max_copies, newton_steps, tolerance)

    top = int(max_copies)
    rated = hist.join(solved, "sid").withColumn(
        "rate",
        F.when(F.col("open"), F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(top))))
        .when(F.col("target") > 0, F.lit(float(top)))
        .otherwise(0.0),
    )

    def round_cells(cells: pd.DataFrame) -> pd.DataFrame:
        """From the longest size down, each size takes the nearest whole number of copies and hands on its rest."""
        cells = cells.sort_values("size", ascending=False, kind="stable").reset_index(drop=True)
        rest, copies = 0.0, []
        for size_, n, rate in zip(cells["size"], cells["n"], cells["rate"], strict=True):
            want = n * rate * size_ + rest
            k = min(top * n, max(0, round(want / size_))) if size_ else 0
            rest = want - k * size_
            copies.append(k)
        return cells[["sid", "size", "n", "rate"]].assign(cell_copies=copies)

    # One group per source holds a row per distinct size only.
    cells = rated.select("sid", "size", "n", "rate").groupBy("sid").applyInPandas(round_cells, "sid int, size long, n long, rate double, cell_copies long")
    # Cells above a ten-thousandth of all rows, of which there are fewer than that, are dealt out in parts before the join.
    total = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # By id, so that reruns agree however rows are numbered; rows without an id by number.
    spread = lambda seed: F.when(F.col("doc_id").isNull(), F.xxhash64("row", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    hot = F.broadcast(hist.where(F.col("n") > max(cell_rows, total // 10_000)).select("sid", "size", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts")))
    placed = tagged.join(hot, ["sid", "size"], "left").withColumn("part", F.coalesce(F.pmod(spread(1), F.col("parts")), F.lit(0)).cast("int"))
    counts = placed.where("parts is not null").groupBy("sid", "size", "part").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("sid", "size").orderBy("part"))
    shares = counts.withColumn("upto", upto)
    dealt = cells.join(shares, ["sid", "size"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    rows = placed.drop("parts").join(dealt, ["sid", "size", "part"])
    cell = Window.partitionBy("sid", "size", "part")
    # The cell's odd copies, dealt to its parts in proportion to their rows without a remainder.
    odd, upto = F.col("cell_copies") % F.col("n"), F.coalesce("upto", "n")
    extra = F.floor(odd * upto / F.col("n")) - F.floor(odd * (upto - F.coalesce("m", "n")) / F.col("n"))
    copies = F.floor(F.col("cell_copies") / F.col("n")) + (F.row_number().over(cell.orderBy(spread(7), "doc_id", "row")) <= extra).cast("long")
    numbered = ["row"] if row_col else []
    return rows.select("doc_id", "size", "source_size", "target", F.least(copies, F.lit(top)).alias("copies"), "rate", *numbered).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", *numbered
    )


def take(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken, all columns kept.  Rows are numbered first, so ids may repeat
    or be null; rows without words, which add nothing to any source, stay once."""
    number = "row_number"
    while number in docs.columns:
        number += "_"
    numbered = stage(docs.withColumn(number, F.monotonically_increasing_id()), "mix-rows")
    mixed = mix(numbered, id_col=id_col, row_col=number, **options)
    mixed = mixed.select("row", F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int").alias("mixed_copies")).where("mixed_copies > 0")
    rows = numbered.select(F.col(number).alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"))
    return rows.join(mixed, "row").select("kept", F.explode(F.array_repeat(F.lit(1), F.col("mixed_copies")))).select("kept.*")


def oracle(weights: Sequence[float] = (5, 2, 1), max_copies: int = 3) -> str:
    """Sizes and targets in DuckDB SQL: of the sources in order of their cap by weight, those below the common level are full."""
    listed = ", ".join(str(float(w)) for w in weights)
    return rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{listed}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] AS weight FROM sized GROUP BY 1),
levels AS (SELECT *, {max_copies} * source_size / weight AS ratio, (sum(source_size) OVER () - coalesce(sum({max_copies} * source_size) OVER before, 0)) / sum(weight) OVER after AS level FROM sources
    WINDOW before AS (ORDER BY {max_copies} * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY {max_copies} * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (SELECT source, source_size, CASE WHEN ratio <= level THEN CAST({max_copies} * source_size AS DOUBLE) ELSE weight * max(CASE WHEN ratio > level THEN level END) OVER () END AS target FROM levels)
SELECT doc_id, size, source_size, round(target, 3) AS target FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source"""
