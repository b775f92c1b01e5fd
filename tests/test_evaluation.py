import math

import pytest
from pyspark.sql import functions as F

from corpusloom.errors import EvaluationError
from corpusloom.operators import evaluation as e
from corpusloom.sources.questions import load_questions


def value(spark, column, positions, total=1):
    row = spark.createDataFrame([(positions, positions, total)], "positions array<int>, tp array<int>, total int")
    return row.select(column).first()[0]


@pytest.mark.parametrize(("positions", "want"), [([3, 7], 1 / 3), ([1], 1.0), ([], 0.0)])
def test_reciprocal_rank(spark, positions, want):
    assert value(spark, e.reciprocal_rank(F.col("positions")), positions) == want


@pytest.mark.parametrize(("positions", "total", "k", "want"), [([3], 1, 5, 0.5), ([1, 4], 2, 5, (1 + 1 / math.log2(5)) / (1 + 1 / math.log2(3))), ([1, 2, 3, 4, 5], 1, 5, 1.0), ([9], 1, 5, 0.0), ([1], 0, 5, 0.0), ([], 3, 5, 0.0)])
def test_ndcg(spark, positions, total, k, want):
    assert abs(value(spark, e.ndcg_at(F.col("tp"), F.col("total"), k), positions, total) - want) < 1e-12


def test_recall_precision_hit(spark):
    assert value(spark, e.recall_at(F.col("tp"), F.col("total"), 5), [1, 9], 2) == 0.5
    assert value(spark, e.recall_at(F.col("tp"), F.col("total"), 5), [1, 2, 3], 2) == 1.0
    assert value(spark, e.recall_at(F.col("tp"), F.col("total"), 5), [1], 0) == 0.0
    assert value(spark, e.precision_at(F.col("positions"), 5), [1, 2, 9]) == 0.4
    assert value(spark, e.hit_rate(F.col("positions"), 3), [4]) == 0.0


def test_matching_and_outcomes(spark):
    ranked = spark.createDataFrame([("q", "lexical", 1, "a.md", "5.3", ["A", "Deep Water"]), ("q", "lexical", 2, "a.md", None, ["A"]), ("q", "lexical", 3, "b.md", "1", ["B"])], "query_id string, retriever string, rank int, doc_rel string, section_ref string, heading_path array<string>")
    targets = spark.createDataFrame([("q", "a.md", "5.3", None), ("q", "a.md", None, "deep"), ("q", "b.md", None, None), ("r", "c.md", None, None)], "query_id string, doc string, section string, heading string")
    asked = spark.createDataFrame([("q",), ("r",)], "query_id string")
    lanes = spark.createDataFrame([("lexical",)], "retriever string")
    got = {r["query_id"]: r for r in e.outcomes(ranked, targets, asked, lanes).collect()}
    assert got["q"]["positions"] == [1, 3] and got["q"]["target_positions"] == [1, 1, 3] and got["q"]["total_relevant"] == 3
    assert got["r"]["positions"] == [] and got["r"]["total_relevant"] == 1
    rows = e.outcomes(ranked, targets, asked, lanes)
    assert e.misses(rows).first()["query_id"] == "r"
    table = e.summary(rows, 5)
    assert table.first()["hit"] == 0.5
    assert [r["metric"] for r in e.gate_failures(table, min_hit=0.9, min_mrr=0.1).collect()] == ["hit"]
    assert e.summary(rows.limit(0)).count() == 0


@pytest.mark.parametrize(("body", "words"), [(None, "no question set"), ("a: [", "invalid YAML"), ("{}", "empty|list"), ("[]", "empty"), ("- x", "mapping"), ("- {id: a, question: q}\n- {id: a, question: q}", "duplicate"), ("- {id: a}", "no text")])
def test_bad_question_sets(tmp_path, body, words):
    path = tmp_path / "q.yaml"
    if body is not None:
        path.write_text(body)
    with pytest.raises(EvaluationError, match=words):
        load_questions(path)


def test_question_forms(tmp_path):
    path = tmp_path / "q.yaml"
    path.write_text("- question: one\n  relevant: [a.md, {doc: b.md, section: 5.3}, {doc: c.md, heading: H}]\n  tags: [t]\n")
    (q,) = load_questions(path)
    assert q.id == "q1" and q.targets == (("a.md", None, None), ("b.md", "5.3", None), ("c.md", None, "H")) and q.tags == ("t",)
