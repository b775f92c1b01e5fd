import pytest
from pyspark.sql import functions as F

from corpusloom.errors import GenerationError
from corpusloom.functions import text
from corpusloom.operators import answering as a

HIT = "query_id string, rank int, chunk_id string, parent_chunk_id string, citation string, trust string, text string"


def hits(spark, *rows):
    return spark.createDataFrame(rows, HIT)


def test_parent_expansion(spark):
    chunks = spark.createDataFrame([("p", "above")], "chunk_id string, text string")
    rows = a.with_parents(hits(spark, ("q", 1, "a", "p", "A", "authored", "own"), ("q", 2, "b", None, "B", "authored", "own"), ("q", 3, "c", "gone", "C", "authored", "own")), chunks)
    assert [r["context"] for r in rows.orderBy("rank").collect()] == ["above\n\nown", "own", "own"]


def test_budget_stops_and_cuts_the_first(spark):
    rows = hits(spark, ("q", 1, "a", None, "A", "authored", "x" * 10), ("q", 2, "b", None, "B", "authored", "y" * 5), ("q", 3, "c", None, "C", "authored", "z"))
    kept = lambda n: [(r["ref"], len(r["passage"])) for r in a.within_budget(rows, n, text_col="text").orderBy("rank").collect()]
    assert kept(100) == [("P1", 10), ("P2", 5), ("P3", 1)] and kept(12) == [("P1", 10)] and kept(4) == [("P1", 4)]


def test_floor_and_warnings(spark):
    rows = hits(spark, ("q", 1, "a", None, "A", "authored", "x"), ("q", 2, "b", None, "B", "untrusted", "y"), ("q", 3, "c", None, "C", "odd", "z"))
    kept, warnings = a.trust_floor(rows, "upstream")
    assert [r["chunk_id"] for r in kept.collect()] == ["a"]
    assert warnings.first().asDict() == {"query_id": "q", "passages": 3, "weak": 2, "weak_tiers": "odd, untrusted", "withheld": 2}
    assert a.trust_floor(rows)[0].count() == 3
    with pytest.raises(GenerationError):
        a.trust_floor(rows, "golden")


def test_extractive_answer(spark):
    rows = hits(spark, ("q", 1, "a", None, "A.md §1", "authored", "Nothing here. The lunar method lost! Chronometers won the day?"))
    asked = spark.createDataFrame([("q", "Why did the lunar method lose?"), ("none", "x")], "query_id string, question string")
    got = {r["query_id"]: r for r in a.extractive_answers(a.within_budget(rows, text_col="text"), asked).collect()}
    assert got["q"]["answer"].endswith("A.md §1\n  The lunar method lost!\n  Chronometers won the day?") and got["q"]["citations"] == ["A.md §1"]
    assert got["none"]["answer"] == a.NO_PASSAGE and got["none"]["citations"] == []


def test_citation_check(spark):
    rows = [("See A b.md §2 and other/X.md, B.md. Also B.md §9", ["A b.md §2 (1/3)", "B.md §1"]), ("none", []), ("x.md", None)]
    got = a.check_citations(spark.createDataFrame(rows, "answer string, citations array<string>")).collect()
    assert got[0]["supported"] == ["A b.md §2 (1/3)"] and got[0]["unsupported"] == ["b.md §2", "other/X.md", "B.md §9"] and not got[0]["grounded"]
    assert got[1]["grounded"] and got[2]["unsupported"] == ["x.md"]


def test_formatted_block(spark):
    rows = a.within_budget(hits(spark, ("q", 1, "a", None, "it's.md", "authored", " body ")), text_col="text")
    assert a.formatted(rows).first()["block"] == "<passage ref=P1 citation=\"it's.md\" provenance='authored'>\nbody\n</passage>"


def test_text_columns(spark):
    rows = spark.createDataFrame([("**Bold** `code` heading (added 2024)", "  a\n b  "), ("x" * 60, "w " * 200)], "h string, t string")
    got = rows.select(text.clean_heading(F.col("h")), text.snippet(F.col("t"))).collect()
    assert got[0][0] == "Bold code heading" and got[0][1] == "a b"
    assert got[1][0] == "x" * 47 + "…" and got[1][1].endswith("…") and len(got[1][1]) <= 160
    refs = spark.createDataFrame([("6.5 Memory",), ("3. Dead",), ("2026 in review",), ("Plain",), ("7",)], "t string").select(text.section_ref(F.col("t"))).collect()
    assert [r[0] for r in refs] == ["6.5", "3", "2026", None, None]


def test_citation_forms(spark):
    rows = spark.createDataFrame([("1.2", ["A", "B"], 0, 1), (None, ["A", "B"], 1, 3), (None, ["A"], 0, 1), (None, [], 0, 1)], "ref string, path array<string>, part int, parts int")
    got = [r[0] for r in rows.select(text.citation(F.lit("d.md"), F.col("ref"), F.col("path"), F.col("part"), F.col("parts"))).collect()]
    assert got == ["d.md §1.2", "d.md > B (2/3)", "d.md", "d.md"]
