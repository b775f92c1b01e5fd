"""Retrieval metrics over a question set, for all questions and retrievers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("hit", "recall", "precision", "mrr", "ndcg")


def target_label(doc: Column, section: Column, heading: Column) -> Column:
    return F.when(section.isNotNull(), F.concat(doc, F.lit(" §"), section)).when(heading.isNotNull(), F.concat(doc, F.lit(" > "), heading)).otherwise(doc)


def matches(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Ranked rows with the targets they meet: an equi-join on document and question; then the section if the target names
    one, else a heading that contains the target's, else the document alone."""
    t = targets.select("query_id", F.col("doc").alias("doc_rel"), "section", "heading")
    low = F.lower("heading")
    fits = (
        F.when(F.col("section").isNotNull(), F.col("section_ref").eqNullSafe(F.col("section")))
        .when(F.col("heading").isNotNull(), F.exists("heading_path", lambda h: F.contains(F.lower(h), low))).otherwise(True)
    )
    return ranked.join(t, ["query_id", "doc_rel"]).where(fits).withColumn("label", target_label(F.col("doc_rel"), F.col("section"), F.col("heading")))


def first_ranks(matched: DataFrame) -> DataFrame:
    """``query_id, retriever, label, rank``: where each distinct target was found first."""
    return matched.groupBy("query_id", "retriever", "label").agg(F.min("rank").alias("rank"))


def outcomes(ranked: DataFrame, targets: DataFrame, questions: DataFrame, retrievers: DataFrame) -> DataFrame:
    """One row per question and retriever: ``positions`` of relevant chunks, ``target_positions`` of distinct targets,
    ``total_relevant`` targets; questions without a match are kept."""
    hit = matches(ranked, targets)
    positions = hit.groupBy("query_id", "retriever").agg(F.array_sort(F.collect_set("rank")).alias("positions"))
    firsts = first_ranks(hit).groupBy("query_id", "retriever").agg(F.array_sort(F.collect_list("rank")).alias("target_positions"))
    totals = targets.groupBy("query_id").agg(F.count("*").cast("int").alias("total_relevant"))
    none = F.array().cast("array<int>")
    # Every question meets every retriever: the retrievers are a handful.
    grid = questions.select("query_id").crossJoin(F.broadcast(retrievers.select("retriever")))
    return (
        grid.join(positions, ["query_id", "retriever"], "left").join(firsts, ["query_id", "retriever"], "left").join(totals, "query_id", "left")
        .select("query_id", "retriever", F.coalesce("positions", none).alias("positions"), F.coalesce("target_positions", none).alias("target_positions"), F.coalesce("total_relevant", F.lit(0)).alias("total_relevant"))
    )


def reciprocal_rank(positions: Column) -> Column:
    return F.coalesce(1.0 / F.array_min(positions), F.lit(0.0))


def hit_rate(positions: Column, k: int) -> Column:
    return F.exists(positions, lambda p: p <= k).cast("double")


def recall_at(target_positions: Column, total: Column, k: int) -> Column:
    found = F.size(F.filter(target_positions, lambda p: p <= k))
    return F.when(total > 0, F.least(found, total) / total).otherwise(0.0)


def precision_at(positions: Column, k: int) -> Column:
    return F.size(F.filter(positions, lambda p: p <= k)) / F.lit(float(k)) if k > 0 else F.lit(0.0)


def ndcg_at(target_positions: Column, total: Column, k: int) -> Column:
    """Binary gain over distinct targets; at most ``total`` of them count."""
    gain = lambda s, p: s + 1.0 / F.log2(p + F.lit(1.0))
    top = F.slice(F.array_sort(F.filter(target_positions, lambda p: p <= k)), 1, F.greatest(total, F.lit(0)))
    ideal = F.slice(F.sequence(F.lit(1), F.lit(max(k, 1))), 1, F.greatest(total, F.lit(0)))
    return F.when((total > 0) & (F.lit(k) > 0), F.aggregate(top, F.lit(0.0), gain) / F.aggregate(ideal, F.lit(0.0), gain)).otherwise(0.0)


def metrics(rows: DataFrame, k: int = 10) -> DataFrame:
    p, t, n = F.col("positions"), F.col("target_positions"), F.col("total_relevant")
    return rows.select(
        "query_id", "retriever", hit_rate(p, k).alias("hit"), recall_at(t, n, k).alias("recall"), precision_at(p, k).alias("precision"),
        reciprocal_rank(p).alias("mrr"), ndcg_at(t, n, k).alias("ndcg"),
    )


def summary(rows: DataFrame, k: int = 10) -> DataFrame:
    """Means by retriever; no rows for no outcomes."""
    return metrics(rows, k).groupBy("retriever").agg(F.count("*").alias("questions"), *[F.avg(m).alias(m) for m in METRICS])


def best_retriever(table: DataFrame) -> DataFrame:
    """One row: the retriever of highest ndcg (the first name on a tie)."""
    return table.orderBy(F.col("ndcg").desc(), "retriever").limit(1)


def misses(rows: DataFrame, limit: int = 5) -> DataFrame:
    """``retriever, place, query_id`` of the first questions without any relevant chunk: a report."""
    order = Window.partitionBy("retriever").orderBy("query_id")
    return rows.where(F.size("positions") == 0).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("retriever", "place", "query_id")


def gate_failures(table: DataFrame, *, min_ndcg: float = 0.0, min_hit: float = 0.0, min_mrr: float = 0.0) -> DataFrame:
    """``retriever, metric, value, floor`` for each floor that the best retriever misses."""
    floors = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(f)).alias("floor")) for m, f in (("ndcg", min_ndcg), ("hit", min_hit), ("mrr", min_mrr))])
    return best_retriever(table).select("retriever", F.inline(floors)).where("value < floor")
