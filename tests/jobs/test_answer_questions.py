"""Answers from the chunk feed: what is quoted, reruns, other runs, a corpus that grew, odd questions."""

import os
import subprocess
import sys

import pytest
from test_chunk_feed import ROOT, deliver

from corpusloom.operators import answering
from jobs import answer_questions, chunk_feed

ASKED = "item_id long, text string"


@pytest.fixture
def places(spark, tmp_path):
    """A feed of three documents and where to write."""
    source = f"{tmp_path}/in"
    rows = [
        (1, "The lighthouse keeper trims the lamp at dusk. He sleeps at noon and reads the tide tables.", "src0"),
        (2, "Charts of the harbour were drawn in 1850. A lamp marks the shoal beyond the harbour mole.", "src9"),
        (3, "Bread needs flour, water, salt and a warm place to rise before it is baked.", "src9"),
    ]
    deliver(spark, source, "a", rows, 1_000_000)
    feed = {"trust_rules": [["src0/*", "authored"]]}
    chunk_feed.run(spark, source, f"{tmp_path}/chunks", f"{tmp_path}/ckpt", feed)
    return source, f"{tmp_path}/chunks", f"{tmp_path}/q", f"{tmp_path}/out", feed


def ask(spark, path, rows):
    spark.createDataFrame(rows, ASKED).write.mode("overwrite").parquet(path)


def said(spark, output, run="all"):
    return {r["query_id"]: r for r in answer_questions.read_answers(spark, output).where(f"run = '{run}'").collect()}


def test_answers_and_support(spark, places):
    _, chunks, questions, output, _ = places
    ask(spark, questions, [(1, "who trims the lamp at dusk"), (2, "how is bread baked"), (3, "zebra"), (4, None), (4, None), (None, "lamp")])
    assert answer_questions.run(spark, chunks, questions, output) == {"weak": 2, "none": 2}
    got = said(spark, output)
    assert got[1]["answer"].startswith(answering.LEAD) and "trims the lamp at dusk" in got[1]["answer"]
    assert got[1]["citations"] == ["src0/1.md", "src9/2.md"] and got[1]["grounded"] and got[1]["weak_tiers"] == "unknown"
    assert got[2]["citations"] == ["src9/3.md"] and got[3]["answer"] == got[4]["answer"] == answering.NO_PASSAGE
    answer_questions.run(spark, chunks, questions, output, {"run": "floor", "trust_floor": "curated"})
    floor = said(spark, output, "floor")
    assert floor[1]["citations"] == ["src0/1.md"] and floor[2]["answer"] == answering.NO_PASSAGE and floor[2]["support"] == "weak"


def test_a_rerun_replaces_its_run_alone(spark, places):
    _, chunks, questions, output, _ = places
    ask(spark, questions, [(1, "lamp"), (2, "bread"), (3, "zebra")])
    answer_questions.run(spark, chunks, questions, output, {"run": "one"})
    first = said(spark, output, "one")
    answer_questions.run(spark, chunks, questions, output, {"run": "one"})
    assert said(spark, output, "one") == first
    answer_questions.run(spark, chunks, questions, output, {"run": "two"})
    ask(spark, questions, [(1, "lamp")])
    answer_questions.run(spark, chunks, questions, output, {"run": "one"})
    # The partition of questions without a passage is gone from this run and stays in the other.
    assert set(said(spark, output, "one")) == {1} and set(said(spark, output, "two")) == {1, 2, 3}
    assert not os.path.isdir(f"{output}/answers/run=one/support=none") and os.path.isdir(f"{output}/answers/run=two/support=none")


def test_answers_follow_the_feed(spark, places):
    source, chunks, questions, output, feed = places
    ask(spark, questions, [(1, "lamp"), (2, "bread")])
    answer_questions.run(spark, chunks, questions, output, {"run": "before"})
    deliver(spark, source, "b", [(2, None, "src9"), (3, "Salt alone makes no bread, says the miller of the upper mill.", "src9"), (4, "A lamp of brass hangs over the bread in the bakery window.", "src0")], 2_000_000)
    chunk_feed.run(spark, source, chunks, chunks.replace("chunks", "ckpt"), feed)
    answer_questions.run(spark, chunks, questions, output, {"run": "after"})
    got = said(spark, output, "after")
    assert set(got[1]["citations"]) == {"src0/1.md", "src0/4.md"} and got[1]["support"] == "strong"
    assert set(got[2]["citations"]) == {"src9/3.md", "src0/4.md"} and "Salt alone" in got[2]["answer"] and "flour" not in got[2]["answer"]
    assert set(said(spark, output, "before")[1]["citations"]) == {"src0/1.md", "src9/2.md"}


def test_no_questions_and_bad_names(spark, places):
    _, chunks, questions, output, _ = places
    ask(spark, questions, [])
    assert answer_questions.run(spark, chunks, questions, output) == {} and said(spark, output) == {}
    with pytest.raises(Exception, match="a run is named"):
        answer_questions.run(spark, chunks, questions, output, {"run": "a/b"})


def test_command_line(spark, places):
    _, chunks, questions, output, _ = places
    ask(spark, questions, [(1, "lamp")])
    done = subprocess.run(
        [sys.executable, f"{ROOT}/jobs/answer_questions.py", "--chunks", chunks, "--questions", questions, "--output", output, "--master", "local[2]"],
        capture_output=True, text=True, timeout=300, cwd=os.path.dirname(chunks),
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "1 weak" in done.stderr and set(said(spark, output)) == {1}
