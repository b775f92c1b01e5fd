"""Ends of lines and of bodies in SQL functions."""

from pyspark.sql import functions as F

from corpusloom.operators import chunking, sections


def test_blanks_are_trimmed_from_the_ends(spark):
    """Every blank, at both ends, without a pattern that walks through the text between them."""
    assert "regexp" not in sections._stripped("t")
    texts = ["", " ", "x", *[f"{c}a{c}{c}b{c}{c}" for c in sections.SPACES], "​a​", "".join(sections.SPACES), " a " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(F.expr(sections._stripped("t"))).collect()] == [t.strip() for t in texts]


def test_every_line_end(spark):
    text = "# A\r\nx\r\r\n# B\x0b# C\x85# D # E\x1e\n=\n# F"
    df = spark.createDataFrame([("1", text)], "doc_id string, text string")
    rows = lambda f: sorted((r["ordinal"], r["title"], r["start_line"], r["end_line"], r["body"]) for r in f(df).collect())
    assert rows(sections.section_rows) == rows(chunking.section_rows)
