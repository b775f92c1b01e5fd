"""An index is built where the texts lie: no shuffle of tokens, and the counts of one that shuffles."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import pruned, ranking

DOCS = [
    (1, "running vessels run; the vessel runs", "Vessels"), (2, None, None), (3, "", "only a heading"), (4, "?!", ""), (5, "Variação VARIACAO variação", "x x x"),
    (6, "first part runs", "A"), (6, "second part ran", "B"), (None, "no id", "C"),
]


def chunks(spark):
    return spark.createDataFrame(DOCS, "chunk_id long, text string, head string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stem", [False, True])
def test_postings_without_a_shuffle(spark, stem):
    alone = chunks(spark).where("chunk_id != 6")
    index = ranking.build_index(alone, headings_col="head", stem=stem, positions=True)
    assert "Exchange" not in plan(index.postings) and "Exchange" not in plan(index.lengths)


@pytest.mark.parametrize("stem", [False, True])
def test_same_as_with_a_shuffle(spark, stem, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_AT_ONCE", 2)
    index = ranking.build_index(chunks(spark), headings_col="head", stem=stem, positions=True)
    whole = ranking._postings_by_shuffle(chunks(spark), "chunk_id", "text", "head", stem=stem, positions=True)
    rows = lambda df: sorted(map(tuple, df.select("chunk_id", "term", "tf_text", "tf_head", "pos_text", "pos_head").collect()), key=repr)
    assert rows(index.postings) == rows(whole)
    lengths = {r["chunk_id"]: r["n"] for r in index.lengths.collect()}
    assert lengths == {1: 7, 2: 0, 3: 3, 4: 0, 5: 6, 6: 8, None: 0} and index.lengths.count() == 7


def test_postings_meet_few_bounds_where_they_lie(spark, tmp_path):
    many = spark.range(3000).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), F.col("id") % 50), F.concat(F.lit("x"), "id")).alias("text"))
    asked = spark.createDataFrame([(n, f"common w{n} x{n}") for n in range(40)], "query_id long, question string")
    index = ranking.build_index(many, staged=True)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clustered = pruned.write_clustered(index, f"{tmp_path}/i")
        found = pruned.rounds(clustered, asked, 3)
        text = plan(found.shares)
        assert "BroadcastHashJoin" in text and "LeftSemi" in text
        rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "chunk_id").collect()))
        assert rows(pruned.pruned_search(clustered, asked, 3)) == rows(ranking.lexical_search(index, asked, 3))
        assert {r["term"]: r["n_docs"] for r in clustered.terms.collect()} == {r["term"]: r["n_docs"] for r in index.terms.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
