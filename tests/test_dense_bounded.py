"""Vectors go to Python and back in small parts."""

import numpy as np

from corpusloom.functions import embed
from corpusloom.operators import dense


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_candidates_are_written_with_bounded_batches(spark):
    docs = spark.createDataFrame([(n, f"word{n} word{n % 7} same") for n in range(600)], "id long, text string")
    embedder = embed.HashingEmbedder(64)
    vectors = embedder.encode(docs, "id", "text").withColumnRenamed("id", "chunk_id")
    asked = embedder.encode(docs.where("id < 5"), "id", "text").withColumnRenamed("id", "query_id")
    found = dense.dense_search(vectors, asked, 3)
    assert "MapInPandas" not in plan(found)
    assert {(r["query_id"], r["chunk_id"]) for r in found.where("rank = 1").collect()} == {(n, n) for n in range(5)}


def test_encoder_remembers_and_makes_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(embed, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(embed, "KNOWN_TOKENS", 3)
    docs = spark.createDataFrame([(n, None if n == 9 else f"a{n} b{n % 3} b") for n in range(40)], "id long, text string").coalesce(1)
    embedder = embed.HashingEmbedder(32)
    got = {r["id"]: r["embedding"] for r in embedder.encode(docs, "id", "text").collect()}
    assert len(got) == 40 and all(np.allclose(got[n], embedder.encode_one("" if n == 9 else f"a{n} b{n % 3} b"), atol=1e-6) for n in got)
