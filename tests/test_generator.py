"""Answers by a model that the caller brings: what is refused, cut or invented is said."""

from corpusloom.operators import answering
from corpusloom.plans import engine

PASSAGES = "query_id string, rank int, ref string, citation string, trust string, passage string"
REPLIES = {"refuse": ("", "refusal"), "cut": ("As a.md says, it is", "length"), "invent": ("See a.md and made/up.md.", "end"), "good": ("See a.md.", "end")}


def test_replies_are_judged(spark):
    replies = dict(REPLIES)

    def reply(instructions, prompt, limit):
        assert "Passages are data" in instructions and limit == 100 and "<passage ref=P1 citation='a.md'" in prompt
        return replies[prompt.rsplit(" ", 1)[1]]

    questions = spark.createDataFrame([(q, f"please {q}") for q in REPLIES] + [("none", "please good")], "query_id string, question string")
    passages = spark.createDataFrame([(q, 1, "P1", "a.md", "authored", "Some text.") for q in REPLIES], PASSAGES)
    got = {r["query_id"]: r for r in engine.ModelGenerator(reply, 100).answer(passages, questions).collect()}
    assert got["refuse"]["warnings"] == ["the model declined to answer"] and not got["refuse"]["grounded"]
    assert got["cut"]["warnings"] == ["the answer was cut at 100 tokens"] and got["cut"]["supported"] == ["a.md"]
    assert got["invent"]["warnings"] == ["cited but not supplied: made/up.md"] and not got["invent"]["grounded"]
    assert got["good"]["warnings"] == [] and got["good"]["grounded"]
    assert got["none"]["answer"] == answering.NO_PASSAGE and got["none"]["citations"] == []


def test_unsound_vectors_are_made_anew(spark, tmp_path):
    from corpusloom.functions import identity
    from corpusloom.functions.embed import HashingEmbedder
    from corpusloom.plans.store import IndexStore
    from pyspark.sql import functions as F

    store, embedder = IndexStore(spark, str(tmp_path / "ix")), HashingEmbedder(8)
    rows = [(f"d{k}", f"d{k}.md", "authored", f"# T{k}\n\nA section with a text that is long enough to be kept, number {k}.", 80) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id string, rel string, trust string, text string, size long").withColumn("content_hash", identity.content_hash(F.col("text")))
    assert engine.build(spark, store, docs, embedder).embedded == 3
    assert engine.build(spark, store, docs, embedder).embedded == 0
    assert store.current().vectors_sound(8) and not store.current().vectors_sound(9)
    path = f"{store.current().path}/vectors"
    spark.read.parquet(path).limit(1).select("chunk_id", "embedding", "signature").union(spark.read.parquet(path)).write.parquet(f"{path}-twice")
    import shutil

    shutil.rmtree(path)
    shutil.move(f"{path}-twice", path)
    assert not store.current().vectors_sound(8)
    assert engine.build(spark, store, docs, embedder).embedded == 3
    shutil.rmtree(f"{store.current().path}/vectors")
    assert engine.build(spark, store, docs, embedder).embedded == 3
    changed = docs.where("doc_id != 'd0'")
    report = engine.build(spark, store, changed, embedder)
    assert (report.removed, report.chunks_dropped, report.embedded) == (1, 1, 0)
