"""References and keys of an index's tables, places in the order of a whole table, and documents that repeat an id."""

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.functions.embed import HashingEmbedder
from corpusloom.operators import integrity, ordered
from corpusloom.plans import engine
from corpusloom.plans.store import KEYS, IndexStore

LONG = "This is a sentence about the deviation of a compass, long enough for a chunk."
DOCS = "doc_id string, rel string, trust string, text string, content_hash string, size long"


def found(tables):
    return sorted(map(tuple, integrity.violations(tables).collect()))


@pytest.fixture
def index(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/index")
    rows = [(f"d{i}", f"n/{i}.md", "authored", f"# T{i}\n\n{LONG}\n\n## Part\n\n{LONG} {i}", f"h{i}", 1) for i in range(4)]
    engine.build(spark, store, spark.createDataFrame(rows, DOCS), HashingEmbedder(16))
    return store


def test_a_sound_index_and_a_broken_one(spark, index):
    tables = {name: index.current().table(name) for name in KEYS}
    assert found(tables) == []
    gone = tables["chunks"].where("doc_id = 'd1' and ordinal = 0").first()["chunk_id"]
    broken = tables | {"chunks": tables["chunks"].where(F.col("chunk_id") != gone), "documents": tables["documents"].where("doc_id != 'd2'"), "vectors": tables["vectors"].unionByName(tables["vectors"].limit(1))}
    wrong = {(c, v) for c, v, _ in found(broken)}
    assert {("chunk of a document", "d2"), ("posting of a chunk", gone), ("length of a chunk", gone), ("vector of a chunk", gone), ("parent of a chunk", gone)} <= wrong
    assert len([c for c, _ in wrong if c == "one row of vectors for a chunk_id"]) == 1 and len(wrong) == 6


def test_check_command(spark, index, tmp_path, capsys):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/a.md").write_text(f"# A\n\n{LONG}")
    (tmp_path / "config.yaml").write_text("scope: {profiles: {index: {roots: [notes]}}}\nindex: {path: .}\n")
    assert cli.main(["check", "-c", f"{tmp_path}/config.yaml"]) == 0 and "no contradiction" in capsys.readouterr().out
    snapshot = index.current()
    snapshot.table("lengths").limit(1).write.mode("append").parquet(f"{snapshot.path}/lengths")
    assert cli.main(["check", "-c", f"{tmp_path}/config.yaml"]) == 1 and "one row of lengths for a chunk_id" in capsys.readouterr().out


def test_repeated_ids_give_one_document(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/index")
    row = lambda h, text: ("d", "n/d.md", "authored", f"# T\n\n{LONG} {text}", h, 1)
    docs = spark.createDataFrame([row("h1", "one"), row("h2", "two"), row("h2", "two"), ("e", "n/e.md", "authored", f"# E\n\n{LONG}", "h", 1)], DOCS).repartition(4)
    report = engine.build(spark, store, docs, None)
    assert (report.added, report.chunks_written) == (2, 2)
    snapshot = store.current()
    assert snapshot.table("documents").where("doc_id = 'd'").first()["content_hash"] == "h2"
    assert [r["text"][-3:] for r in snapshot.table("chunks").where("doc_id = 'd'").collect()] == ["two"]
    assert engine.build(spark, store, docs, None).unchanged == 2


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_places_in_order(spark, ranges):
    rows = [(i * 37 % 101, f"t{i % 5}", i) for i in range(500)] + [(None, "t", 1), (3, None, 2)]
    df = spark.createDataFrame(rows, "a int, b string, position_ int").repartition(5)
    got = {(r["a"], r["b"], r["position_"]): r["position"] for r in ordered.with_positions(df, ("a", "b", "position_"), ranges=ranges).collect()}
    want = sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == want and sorted(got.values()) == list(range(len(rows)))


def test_places_of_equal_rows_and_of_none(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 3, "a int")
    assert sorted(r["n"] for r in ordered.with_positions(df, ("a",), name="n").collect()) == list(range(53))
    assert ordered.with_positions(df.limit(0), ("a",)).collect() == []
