"""Sections in SQL functions beside the chunker's, on every form of heading and on texts put together at random."""

import random
import time

import pytest

from corpusloom.operators import chunking, sections

COLUMNS = ["doc_id", "ordinal", "level", "title", "section_ref", "body", "start_line", "end_line", "path", "parent"]
PIECES = [
    "# A", "## B b ##", "### 1.2 c", "text", "", "```", "````", "~~~", "~~~~ py", "   ```", "    ```", "===", "---", "--", "-", "- item", "| a", "1. x", "***", "# ", "#x", "...",
    "  # y", "a b", "====  ", "--- ", " ", "# #", "###### z", "####### q", "```x```", " # n", "١. y", "#  t ", "x" * 50,
]


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(COLUMNS).collect())


def same(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    got, want = rows(sections.section_rows(df)), rows(chunking.section_rows(df))
    assert got == want and (want or not any(t and t.strip() for t in texts))


def test_forms(spark):
    same(spark, [
        "# Map\n\n## 1. First thing\n\nx\n\n### 1.2 Deeper\n\ny\n\n## 2026 in review\n\nz", "# A\n\n```\n# not\n~~~\n```\n\n~~~~\n```\n# no\n~~~\n~~~~\n# B", "Top\n===\n\nSub\n---\n\ntext\n\n---\n\n- item\n---\n",
        "  # indented\n\n#\n\n#nospace", "# closed ##  ", "---\na: 1\n---\nintro\n\n# H\nbody\n", "---\na: 1\n", "---\na: 1\n...\nb", "a\n---\n===\n---\n===", "#### deep\n# top\n###### deepest\n### mid", "```\n# a\n```\n```\n# b", "```", "a\r\n===\r\nb\rc\x0b# d",
        "---\n---\na\n\n", "---", "\n\n", "", "   ", None,
    ])


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    r, texts = random.Random(seed), []
    for _ in range(1200):
        text = r.choice(["\n", "\n", "\n", "\r\n", "\r", " ", "\x85", "\x1c"]).join(r.choice(PIECES) for _ in range(r.choice([0, 1, 3, 8, 15])))
        front = "---\nk: v\n" + r.choice(["---", "...", "--"]) + "\n" if r.random() < 0.3 else ""
        texts.append(front + text + ("\n" if r.random() < 0.3 else ""))
    same(spark, texts)


def test_nearest_section_that_gives_a_chunk(spark):
    prose = "This sentence is long enough to be kept as a chunk of its own."
    text = f"# A\n\n{prose}\n\n## Empty\n\n### Leaf\n\n{prose}\n\n## Other\n\n{prose}\n\n#### Last\n\n{prose}"
    df = spark.createDataFrame([("d", "d.md", "authored", text)], "doc_id string, rel string, trust string, text string")
    got = {r["ordinal"]: r["giving"] for r in sections.section_rows(df).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 0, 4: 3}
    ups = {r["ordinal"]: r["parent_chunk_id"] for r in chunking.chunks(df).collect()}
    assert all(up == (chunking.make_chunk_id("d", got[k], 0) if got[k] is not None else None) for k, up in ups.items())


def test_odd_rows(spark):
    """Null and repeated ids, columns that clash, a table without rows."""
    df = spark.createDataFrame([(None, "# A", 1, "x"), ("1", "# A", 2, "y"), ("1", "# A", 2, "y"), ("2", None, 3, "z")], "doc_id string, text string, _lines int, sections string")
    assert [r[0] for r in rows(sections.section_rows(df))] == ["1", "1", "None"]
    assert sections.section_rows(df.limit(0)).collect() == []


def test_long_texts_take_linear_time(spark):
    for unit in ("# h\ntext\n", "```\n", "~~~ x\n", "a\n---\n", "   " * 30 + "\n", "x" * 200 + "\n"):
        df = spark.createDataFrame([("1", unit * (200_000 // len(unit)))], "doc_id string, text string")
        began = time.perf_counter()
        sections.section_rows(df).write.format("noop").mode("overwrite").save()
        assert time.perf_counter() - began < 40, unit
