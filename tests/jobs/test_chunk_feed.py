"""The chunk feed: over growing input, against one run over everything, after a failure, and on odd rows."""

import os
import shutil
import subprocess
import sys

import pytest

from corpusloom.operators import chunking
from jobs import chunk_feed
from jobs.common import load_config, settings

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "doc_id long, text string, source string"


def deliver(spark, folder, name, rows, at, schema=SCHEMA):
    """One file of rows under ``folder``, as a delivery at time ``at``."""
    scratch = f"{folder}-{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(scratch)
    part = next(f for f in os.listdir(scratch) if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    shutil.copy(f"{scratch}/{part}", f"{folder}/{name}.parquet")
    os.utime(f"{folder}/{name}.parquet", (at, at))


def text(i, version=""):
    return f"Document {i} {version} says something of forty characters and more.\n\n" + " ".join(f"word{n}" for n in range(40 * (i % 20)))


def rows_of(spark, output):
    return sorted((r["doc_rel"], r["part"], r["text"]) for r in chunk_feed.current(spark, output).collect())


def expected(docs):
    """Chunks of {(id, source): text} by the library's function."""
    out = []
    for (i, source), body in docs.items():
        rel = f"{source}/{i}.md"
        out += [(row[1], row[9], row[3]) for row in chunking.chunk_document(body, "x", rel)]
    return sorted(out)


@pytest.fixture
def places(tmp_path):
    return f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ckpt"


def test_two_runs_over_growing_input(spark, places):
    source, output, checkpoint = places
    first = {(i, f"src{i % 3}"): text(i) for i in range(60)}
    deliver(spark, source, "a", [(i, t, s) for (i, s), t in first.items()], 1_000_000)
    assert chunk_feed.run(spark, source, output, checkpoint) == [{"added": 60}]
    assert rows_of(spark, output) == expected(first)
    before = {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(output) for f in fs if f.endswith(".parquet")}

    second = first | {(i, f"src{i % 3}"): text(i, "changed") for i in range(10)} | {(i, "new"): text(i) for i in range(100, 130)}
    del second[(11, "src2")]
    deliver(spark, source, "b", [(i, second.get((i, s)), s) for i, s in [*[(i, f"src{i % 3}") for i in range(12)], *[(i, "new") for i in range(100, 130)]]], 2_000_000)
    assert chunk_feed.run(spark, source, output, checkpoint) == [{"added": 30, "changed": 10, "removed": 1, "unchanged": 1}]
    assert rows_of(spark, output) == expected(second)
    # What was written before is as it was: the second run wrote what is new and nothing else.
    assert all(os.path.getmtime(f) == at for f, at in before.items())
    assert {r["doc_id"] for r in chunk_feed.state(spark, output).where("batch = 1 and status = 'added'").collect()}.isdisjoint({r["doc_id"] for r in chunk_feed.state(spark, output).where("batch = 0").collect()})

    assert chunk_feed.run(spark, source, output, checkpoint) == []
    assert rows_of(spark, output) == expected(second)
    # One run over everything says the same.
    chunk_feed.run(spark, source, f"{output}-whole", f"{checkpoint}-whole")
    assert rows_of(spark, f"{output}-whole") == expected(second)


def test_many_small_batches_say_the_same(spark, places):
    source, output, checkpoint = places
    for n in range(4):
        deliver(spark, source, f"f{n}", [(i, text(i, f"v{n}" if i % 4 == n else ""), "s") for i in range(n * 5, n * 5 + 12)], 1_000_000 + n)
    taken = chunk_feed.run(spark, source, output, checkpoint, {"max_files_per_batch": 1})
    assert len(taken) == 4
    want = {}
    for n in range(4):
        want |= {(i, "s"): text(i, f"v{n}" if i % 4 == n else "") for i in range(n * 5, n * 5 + 12)}
    assert rows_of(spark, output) == expected(want)


def test_a_failed_batch_is_made_up_for(spark, places, monkeypatch):
    source, output, checkpoint = places
    deliver(spark, source, "a", [(i, text(i), "s") for i in range(20)], 1_000_000)
    chunk_feed.run(spark, source, output, checkpoint)
    deliver(spark, source, "b", [(i, text(i, "b"), "s") for i in range(10, 30)], 2_000_000)
    whole = chunking.chunks

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    monkeypatch.setattr(chunking, "chunks", broken)
    with pytest.raises(Exception, match="lost"):  # after the documents of the batch were written
        chunk_feed.run(spark, source, output, checkpoint)
    monkeypatch.setattr(chunking, "chunks", whole)
    assert chunk_feed.run(spark, source, output, checkpoint) == [{"added": 10, "changed": 10}]
    assert rows_of(spark, output) == expected({(i, "s"): text(i, "b" if i >= 10 else "") for i in range(30)})


def test_odd_rows(spark, places):
    """Null ids, texts and sources, empty texts, repeated ids, a text that comes back, columns that clash."""
    source, output, checkpoint = places
    schema = "doc_id long, text string, source string, file_path string, batch int, trust string"
    extra = ("x", 7, "authored")
    deliver(spark, source, "a", [(None, text(1), "s", *extra), (1, None, "s", *extra), (2, "", "s", *extra), (3, text(3), None, *extra), (4, text(4), "s", *extra), (4, text(4), "s", *extra), (5, "x" * 3_000_000, "s", *extra)], 1_000_000, schema)
    assert chunk_feed.run(spark, source, output, checkpoint) == [{"added": 3, "absent": 2}]
    assert {r["doc_rel"]: r["root"] for r in chunk_feed.current(spark, output).collect()} == {"/3.md": "", "s/4.md": "s"}
    deliver(spark, source, "b", [(4, None, "s", *extra), (2, text(2), "s", *extra)], 2_000_000, schema)
    deliver(spark, source, "c", [(4, text(4, "again"), "s", *extra)], 3_000_000, schema)
    assert chunk_feed.run(spark, source, output, checkpoint, {"max_files_per_batch": 1}) == [{"removed": 1, "changed": 1}, {"added": 1}]
    assert rows_of(spark, output) == expected({(3, ""): text(3), (4, "s"): text(4, "again"), (2, "s"): text(2)})


def test_nothing_to_read(spark, places):
    source, output, checkpoint = places
    os.makedirs(source)
    assert chunk_feed.run(spark, source, output, checkpoint) == []
    deliver(spark, source, "a", [], 1_000_000)
    deliver(spark, source, "b", [(1, text(1), "s")], 2_000_000)
    chunk_feed.run(spark, source, output, checkpoint, {"max_files_per_batch": 1})
    assert rows_of(spark, output) == expected({(1, "s"): text(1)})


def test_settings(tmp_path):
    assert load_config(f"{ROOT}/jobs/chunk_feed.yaml", chunk_feed.DEFAULTS)["trust_rules"]
    with pytest.raises(Exception, match="unknown settings: colour"):
        settings({"colour": 1}, chunk_feed.DEFAULTS)


def test_command_line(spark, places):
    source, output, checkpoint = places
    deliver(spark, source, "a", [(i, text(i), "src0") for i in range(5)], 1_000_000)
    done = subprocess.run(
        [sys.executable, f"{ROOT}/jobs/chunk_feed.py", "--source", source, "--output", output, "--checkpoint", checkpoint, "--master", "local[2]"],
        capture_output=True, text=True, timeout=300, cwd=os.path.dirname(source),
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "5 added" in done.stderr and rows_of(spark, output) == expected({(i, "src0"): text(i) for i in range(5)})
    assert {r["trust"] for r in chunk_feed.current(spark, output).collect()} == {"authored"}
