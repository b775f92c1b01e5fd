"""Tokens are counted where a text lies."""

from collections import Counter

from corpusloom.functions import embed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_of_tokens_are_not_shuffled(spark):
    rows = [(1, "a b a c"), (2, None), (3, ""), (4, "z Z z"), (5, "one two"), (5, "two three"), (None, "x"), (None, "y x")]
    docs = spark.createDataFrame(rows, "id long, text string")
    for hasher in ("md5", "blake2b"):
        assert "Exchange" not in plan(embed.sparse_embedding(docs.where("id < 5"), "id", "text", 64, hasher))
        embedder, texts = embed.HashingEmbedder(64, hasher), {}
        for i, text in rows:
            texts[i] = f"{texts.get(i, '')} {text or ''}"
        want = {(i, b): round(w, 9) for i, t in texts.items() for b, w in enumerate(embedder.encode_one(t)) if w}
        got = [((r["id"], r["bucket"]), round(r["weight"], 9)) for r in embed.sparse_embedding(docs, "id", "text", 64, hasher).collect()]
        assert dict(got) == want and len(got) == len(want) and max(Counter(k for k, _ in got).values()) == 1
