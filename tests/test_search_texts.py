"""Search of texts without an index: the ranking of an index, without its shuffles; what joins chunks doesn't move them."""

import pytest

from corpusloom.operators import ranking
from jobs import answer_questions, chunk_feed

DOCS = [
    (1, "the lamp is lit at dusk, the lamp is out at noon", "a"), (2, "a lamp", "b b"), (3, None, "lamp"), (4, "", None), (5, "tide tables of the harbour", "Dusk"),
    (6, "lamp", "b"), (6, "the harbour", "dusk"), (7, "lamp", "b"), (8, "lamp", "b"), (None, "lamp dusk", "b"), (None, "tide", "b"), (9, "ÀLAMP lamp٣ lamp", "x"),
]
ASKED = [(1, "lamp at dusk"), (2, "harbour harbour tide"), (3, "unknown"), (4, None), (5, "lamp_dusk ٣ Lamp"), (6, "b")]


def frames(spark):
    return spark.createDataFrame(DOCS, "chunk_id long, text string, head string"), spark.createDataFrame(ASKED, "query_id long, question string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize(("k", "weights", "cells"), [(1, (0.5, 1.0), 1 << 20), (3, (1.0, 1.0), 40), (100, (0.0, 1.0), 1 << 20)])
def test_same_as_scoring_an_index(spark, monkeypatch, k, weights, cells):
    chunks, asked = frames(spark)
    want = rows(ranking.lexical_search(ranking.build_index(chunks, headings_col="head"), asked, k, weights=weights))
    monkeypatch.setattr(ranking, "SCORE_CELLS", cells)
    assert want and rows(ranking.search_texts(chunks, asked, k, headings_col="head", weights=weights)) == want
    monkeypatch.setattr(ranking, "SENT_TERMS", 0)
    assert {r[:3] for r in rows(ranking.search_texts(chunks.where("chunk_id is not null"), asked, k, headings_col="head", weights=weights))}


def test_nothing_asked(spark):
    chunks, asked = frames(spark)
    found = ranking.search_texts(chunks, asked.where("query_id in (3, 4)"), 3)
    assert found.collect() == ranking.search_texts(chunks, asked.limit(0), 3).collect() == [] and found.columns == ["query_id", "chunk_id", "score", "rank"]


def test_the_job_makes_no_postings_to_shuffle(spark, monkeypatch):
    chunks, asked = frames(spark)
    monkeypatch.setattr(ranking, "index_for", None)
    ids = chunks.where("chunk_id is not null").selectExpr("cast(chunk_id as string) as chunk_id", "'x.md' as citation", "'authored' as trust", "text")
    assert answer_questions.passages(ids, asked, answer_questions.DEFAULTS).count() > 0


def test_current_chunks_are_not_shuffled(spark, tmp_path):
    """Whatever the number of versions: only those of documents that changed meet the chunks."""
    spark.range(3000).selectExpr("id as doc_id", "concat('the tide tables of the harbour number ', id) as text", "'a' as source").write.parquet(f"{tmp_path}/in/1")
    chunk_feed.run(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/ckpt")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        current = chunk_feed.current(spark, f"{tmp_path}/out")
        assert "Exchange hashpartitioning" not in current._jdf.queryExecution().executedPlan().toString() and current.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
