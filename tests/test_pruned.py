"""Search over clustered postings beside search over all of them, and what it reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import pruned, ranking

WORDS = [f"w{i}" for i in range(60)]


def corpus(seed, n=400):
    r = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [(i, " ".join(r.choices(WORDS, weights, k=r.choice([3, 10, 40, 200])))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "w0 w0 w0"), (n + 3, "w0 w0 w0"), (n + 4, "w59")]


QUESTIONS = [(1, "w0 w1 w2"), (2, "w59"), (3, "w30 w31 w0 w0 w40"), (4, "nothing known"), (5, None), (6, " ".join(WORDS)), (7, "w50 w51 w1"), (8, "?!")]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    chunks = spark.createDataFrame(corpus(3), "chunk_id long, text string").withColumn("head", F.when(F.col("chunk_id") % 5 == 0, "w5 w50").otherwise(""))
    index = ranking.build_index(chunks, headings_col="head", staged=True)
    return index, pruned.write_clustered(index, f"{tmp_path_factory.mktemp('clustered')}/i")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUESTIONS, "query_id long, question string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize(("k", "weights", "seed_rows"), [(1, (0.5, 1.0), None), (5, (0.5, 1.0), 0), (10, (1.0, 1.0), None), (10, (2.0, 0.0), 50), (1000, (0.5, 1.0), None)])
def test_same_as_scoring_everything(made, asked, k, weights, seed_rows):
    index, clustered = made
    assert rows(pruned.pruned_search(clustered, asked, k, weights=weights, seed_rows=seed_rows)) == rows(ranking.lexical_search(index, asked, k, weights=weights))


def test_stemmed_terms(spark, tmp_path, asked):
    chunks = spark.createDataFrame([(1, "running relations"), (2, "the runner runs"), (3, "relational run")], "chunk_id long, text string")
    index = ranking.build_index(chunks, stem=True, staged=True)
    queries = spark.createDataFrame([(1, "run"), (2, "relation runs")], "query_id long, question string")
    assert rows(pruned.pruned_search(pruned.write_clustered(index, f"{tmp_path}/i"), queries, 2)) == rows(ranking.lexical_search(index, queries, 2))


def test_most_postings_stay_unread(spark, made):
    """Of a rare and a common word, the common word's postings are looked up for candidates alone."""
    _, clustered = made
    queries = spark.createDataFrame([(1, "w20 w0")], "query_id long, question string")
    found = pruned.rounds(clustered, queries, 3)
    common = found.bounds.where("term = 'w0'").agg(F.sum("rows")).first()[0]
    assert found.shares.count() <= found.candidates.count() < 0.4 * common
    assert found.scores.count() < 0.5 * common


def test_plan_reads_the_parts_asked_for(spark, made):
    _, clustered = made
    queries = spark.createDataFrame([(1, "w7 w9")], "query_id long, question string")
    plan = pruned.rounds(clustered, queries, 3).shares._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "/postings]" in line)
    parts = {r[0] for r in spark.createDataFrame([("w7",), ("w9",)], "t string").select(pruned.term_part(F.col("t"))).collect()}
    assert set(map(int, re.search(r"PartitionFilters: \[part#\d+ IN \(([\d,]+)\)", scan)[1].split(","))) == parts
    assert "In(term, [w7,w9])" in scan


def test_no_chunks(spark, tmp_path, asked):
    none = spark.createDataFrame([], "chunk_id long, text string")
    clustered = pruned.write_clustered(ranking.build_index(none, staged=True), f"{tmp_path}/i")
    assert pruned.pruned_search(clustered, asked, 5).collect() == []
