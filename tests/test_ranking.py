import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stem, text
from corpusloom.functions.embed import HashingEmbedder, make_embedder
from corpusloom.errors import EmbeddingError, VectorStoreError
from corpusloom.operators import dense, ranking, vectors

DOCS = [
    (1, "Compass deviation varies with the heading of the vessel; running vessels deviate.", "Navigation / Deviation"),
    (2, "The snake case of a variable and the case of a snake.", "Programming"),
    (3, "Variação magnética: the angle between true and magnetic north.", "Charts / Variation"),
    (4, "", "Empty"),
    (5, "Relational operators are running happily; relations relate.", ""),
    (6, "snake_case names", "Names / snake case"),
]
QUERIES = ["compass deviations", "snake_case", "variacao", "running relation", "the", "vessel vessel heading", "?!", "naïve names"]


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, text, headings, tokenize = 'porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without FTS5")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", DOCS)
    return con


def test_scores_equal_a_full_text_engine(spark, fts):
    """Stemmed two-field scores with phrases; the engine counts its unindexed column, so text weighs 0.5 and headings 1."""
    chunks = spark.createDataFrame(DOCS, "chunk_id long, text string, headings string")
    index = ranking.build_index(chunks, headings_col="headings", stem=True, positions=True)
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, question string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in ranking.bm25_scores(index, asked, phrases=True).collect()}
    expressions = {r["query_id"]: r["e"] for r in asked.select("query_id", text.match_expression(F.col("question")).alias("e")).collect()}
    want = {}
    for q, e in expressions.items():
        if e:
            want |= {(q, i): -s for i, s in fts.execute("SELECT id, bm25(t, 1.0, 0.5) FROM t WHERE t MATCH ?", (e,))}
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("word", "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators as is y say".split())
def test_stems_equal_a_full_text_engine(word):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(a, tokenize = 'porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, row)")
    con.execute("INSERT INTO t VALUES (?)", (word,))
    assert [stem.porter(word)] == [r[0] for r in con.execute("SELECT term FROM v")]


def test_stopwords_only_stay(spark):
    rows = spark.createDataFrame([("who",), ("The Lunar a I method",), ("",), (None,), ("x yy",)], "t string")
    assert [r[0] for r in rows.select(text.query_words(F.col("t"))).collect()] == [["who"], ["Lunar", "method"], [], [], ["yy"]]


def test_fusion_by_hand(spark):
    rows = [("q", "lexical", "a", 1), ("q", "lexical", "b", 2), ("q", "dense", "b", 1), ("q", "dense", "c", 2), ("q", "lexical", "d", 3), ("q", "dense", "e", 3)]
    fused = {r["chunk_id"]: r for r in ranking.fuse(spark.createDataFrame(rows, "query_id string, retriever string, chunk_id string, rank int")).collect()}
    assert abs(fused["b"]["score"] - (1 / 62 + 1 / 61)) < 1e-12
    assert [k for k, _ in sorted(fused.items(), key=lambda x: x[1]["fused_rank"])] == ["b", "a", "c", "d", "e"]
    assert fused["b"]["retrievers"] == ["dense", "lexical"] and fused["b"]["ranks"] == {"lexical": 2, "dense": 1}


def test_trust_breaks_ties_only(spark):
    fused = ranking.fuse(spark.createDataFrame([("q", "l", "a", 1), ("q", "d", "b", 1), ("q", "d", "gone", 2), ("q", "l", "c", 3)], "query_id string, retriever string, chunk_id string, rank int"))
    chunks = spark.createDataFrame([("a", "unknown"), ("b", "authored"), ("c", "authored")], "chunk_id string, trust string")
    order = lambda **o: [r["chunk_id"] for r in ranking.hydrate(fused, chunks, 5, **o).orderBy("rank").collect()]
    assert order() == ["a", "b", "c"] and order(prefer_trust=True) == ["b", "a", "c"]
    assert ranking.hydrate(fused, chunks, 0).count() == 0


def test_dense_order_allow_and_zero(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [-1.0, 0.0]), ("z", [0.0, 0.0])], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [2.0, 0.1]), ("none", [0.0, 0.0])], "query_id string, embedding array<double>")
    found = dense.dense_search(rows, asked, 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in found] == ["a", "b", "c"] and found[2]["score"] < 0
    allow = spark.createDataFrame([("b",), ("nope",)], "chunk_id string")
    assert [r["chunk_id"] for r in dense.dense_search(rows, asked, 10, allow=allow).collect()] == ["b"]
    assert dense.dense_search(rows, asked, 10, allow=allow.limit(0)).count() == 0
    assert dense.dense_search(rows, asked, 0).count() == 0


def test_vector_table(spark):
    now = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, embedding array<double>")
    new = spark.createDataFrame([("b", [3.0]), ("c", [4.0])], "chunk_id string, embedding array<double>")
    merged = vectors.upsert(now, new)
    assert sorted(map(tuple, merged.select("chunk_id", F.col("embedding")[0]).collect())) == [("a", 1.0), ("b", 3.0), ("c", 4.0)]
    again = spark.createDataFrame([("b", [9.0], 1), ("b", [5.0], 2), ("d", [7.0], 1), ("d", [8.0], 1)], "chunk_id string, embedding array<double>, at int")
    last = vectors.upsert(now.withColumn("at", F.lit(0)), again, order_col="at")
    assert sorted(map(tuple, last.select("chunk_id", F.col("embedding")[0]).collect())) == [("a", 1.0), ("b", 5.0), ("d", 8.0)]
    assert sorted(map(tuple, vectors.upsert(now, again.drop("at")).select("chunk_id", F.col("embedding")[0]).collect())) == [("a", 1.0), ("b", 9.0), ("d", 8.0)]
    assert vectors.delete(merged, new.withColumn("chunk_id", F.lit("zzz"))).count() == 3
    assert vectors.stats(merged).first().asDict() == {"count": 3, "dim": 1, "bytes": 12}
    assert vectors.stats(merged.limit(0)).first()["count"] == 0
    with pytest.raises(VectorStoreError):
        vectors.upsert(now, new.drop("embedding"))
    with pytest.raises(Exception, match="components"):
        vectors.check(merged, 2).collect()


def test_hashing_embedder(spark):
    e = HashingEmbedder(64)
    rows = spark.createDataFrame([(1, "a b a"), (2, "A, B! a"), (3, "?"), (4, None)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in e.encode(rows, "id", "text").collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-6
    assert not any(got[3]) and not any(got[4]) and e.signature == "hashing:64"
    assert make_embedder({"provider": "hash", "dim": 8}).dim == 8
    for bad in ({"provider": "somewhere-hosted"}, {"dim": 0}):
        with pytest.raises(EmbeddingError):
            make_embedder(bad)
