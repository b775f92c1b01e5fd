"""Registered queries over Markdown in all its forms of headings: front matter, a preamble, both kinds of fences, hash and
underlined headings, skipped levels, a fence that is never closed.  The documents' texts are its paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import chunking, sections
from .queries import _table, query
from .staging import stage

BODY = r"concat('Text: ', regexp_replace(text, '[\t\n\x0b\f\r ]+', ' '{}))"


def _forms(spark, sf_dir) -> DataFrame:
    """``doc_id, rel, trust, text``."""
    lines = lambda *parts: F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    given = lambda number, some, other=None: F.when(F.col("doc_id") % number == 0, some).otherwise(other if other is not None else F.array().cast("array<string>"))
    # A Spark string literal takes the pattern's escapes once more.
    body, number = F.expr(BODY.format("").replace("\\", "\\\\")), F.col("doc_id").cast("string")
    text = F.concat(
        given(2, lines("---", "title: x", F.when(F.col("doc_id") % 4 == 0, "---").otherwise("..."))), given(3, lines("Before any heading.", "")),
        lines(F.concat(F.lit("# Document "), number), "", body, ""),
        given(5, lines("~~~~ text", "# no heading", "```", "~~~~"), lines("```", "## no heading", "---", "~~~", "```")),
        lines("", F.concat(F.lit("First "), number), "=====", body, "", "Part", "-----", "### 1.2 Deep part ###", "short", "##### 1.2.3 Deeper", body, "- item", "---", "## 2. Second"),
        given(7, lines("```", "# never a heading", body)),
    )
    return _table(spark, sf_dir, "documents").select(number.alias("doc_id"), F.concat(F.lit("forms/"), number, F.lit(".md")).alias("rel"), F.lit("authored").alias("trust"), F.array_join(text, "\n").alias("text"))


#: Each document's sections as the template has them: k, level, title, reference, lines, body, and the section above.
FORMS_SQL = rf"""d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS cut, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS pre, {BODY.format(", 'g'")} AS body, chr(10) AS nl FROM documents),
s AS (SELECT doc_id, cut, pre, unnest([
    {{'k': 1, 'level': 1, 'title': 'Document ' || doc_id, 'ref': NULL, 'lines': CASE WHEN doc_id % 5 = 0 THEN 9 ELSE 10 END, 'up': NULL,
      'body': body || nl || nl || CASE WHEN doc_id % 5 = 0 THEN concat_ws(nl, '~~~~ text', '# no heading', '```', '~~~~') ELSE concat_ws(nl, '```', '## no heading', '---', '~~~', '```') END}},
    {{'k': 2, 'level': 1, 'title': 'First ' || doc_id, 'ref': NULL, 'lines': 4, 'up': NULL, 'body': body}},
    {{'k': 3, 'level': 2, 'title': 'Part', 'ref': NULL, 'lines': 2, 'up': 2, 'body': ''}},
    {{'k': 4, 'level': 3, 'title': '1.2 Deep part', 'ref': '1.2', 'lines': 2, 'up': 3, 'body': 'short'}},
    {{'k': 5, 'level': 5, 'title': '1.2.3 Deeper', 'ref': '1.2.3', 'lines': 4, 'up': 4, 'body': concat_ws(nl, body, '- item', '---')}},
    {{'k': 6, 'level': 2, 'title': '2. Second', 'ref': '2', 'lines': CASE WHEN doc_id % 7 = 0 THEN 4 ELSE 1 END, 'up': 2,
      'body': CASE WHEN doc_id % 7 = 0 THEN concat_ws(nl, '```', '# never a heading', body) ELSE '' END}}], recursive := true) FROM d),
placed AS (SELECT *, cut + 2 * pre + coalesce(sum(lines) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    length(body) >= {chunking.MIN_CHARS} AS gives FROM s),
climb AS (SELECT doc_id, k, up, title AS path, CAST(NULL AS INT) AS giving FROM placed
    UNION ALL SELECT c.doc_id, c.k, p.up, p.title || ' > ' || c.path, coalesce(c.giving, CASE WHEN p.gives THEN p.k END) FROM climb c JOIN placed p ON p.doc_id = c.doc_id AND p.k = c.up),
tops AS (SELECT * FROM climb WHERE up IS NULL)"""

SECTIONS_SQL = f"""WITH RECURSIVE {FORMS_SQL}
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(k - 1 + pre AS INT) AS ordinal, CAST(level AS INT) AS level, title, ref AS section_ref, md5(body) AS body_md5, CAST(before + 1 AS INT) AS start_line,
    CAST(before + lines AS INT) AS end_line, path, CAST(p.up - 1 + pre AS INT) AS parent, CAST(giving - 1 + pre AS INT) AS giving FROM placed p JOIN tops USING (doc_id, k)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, 0, '', NULL, md5('Before any heading.'), cut + 1, cut + 2, '', NULL, NULL FROM d WHERE pre = 1"""


@query(SECTIONS_SQL)
def t01_t04_sections(spark, sf_dir):
    """Sections with their lines, paths, parents and the nearest ones above that give a chunk, in SQL functions."""
    rows = sections.section_rows(_forms(spark, sf_dir))
    return rows.select("doc_id", "ordinal", "level", "title", "section_ref", F.md5("body").alias("body_md5"), "start_line", "end_line", F.array_join("path", " > ").alias("path"), "parent", "giving")


@query(f"SELECT * EXCLUDE (giving) FROM ({SECTIONS_SQL})")
def t01_t04_sections_by_line(spark, sf_dir):
    """The same sections as the chunker finds them, going through a document's lines."""
    rows = chunking.section_rows(_forms(spark, sf_dir))
    return rows.select("doc_id", "ordinal", "level", "title", "section_ref", F.md5("body").alias("body_md5"), "start_line", "end_line", F.array_join("path", " > ").alias("path"), "parent")


@query(f"""WITH RECURSIVE {FORMS_SQL}, n AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, k - 1 + pre AS ordinal, giving - 1 + pre AS giving FROM placed JOIN tops USING (doc_id, k) WHERE gives)
SELECT doc_id, CAST(ordinal AS INT) AS ordinal, substr(sha256(concat(doc_id, ':', CAST(ordinal AS VARCHAR), ':0')), 1, 16) AS chunk_id,
    CASE WHEN giving IS NOT NULL THEN substr(sha256(concat(doc_id, ':', CAST(giving AS VARCHAR), ':0')), 1, 16) END AS parent_chunk_id FROM n""")
def j08_parent_chunks(spark, sf_dir):
    """The first chunk of each section that gives one, with the first chunk of the nearest section above that gives one."""
    # Written here, where what goes to Python at a time has a bound.
    return stage(chunking.chunks(_forms(spark, sf_dir)).where("part = 0").select("doc_id", "ordinal", "chunk_id", "parent_chunk_id"), "parents")
