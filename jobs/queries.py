"""The jobs as registered queries: each is run twice into one new folder, and its whole output is read back."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import answering, chunking, ingest
from corpusloom.queries import HITS_SQL, REL, SENTENCES_SQL, TRUST_SQL, WORDS_CTE, _postings_sql, _ranked_sql, _scores_sql, windows_sql
from corpusloom.staging import shared_dir

from . import answer_questions, chunk_feed
from .common import load_config

HERE = os.path.dirname(os.path.abspath(__file__))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_chunk_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents, after a second run that finds nothing new."""
    # A pattern, since a stream reads folders and patterns, and a table may be a single file.
    config, folder = load_config(f"{HERE}/chunk_feed.yaml", chunk_feed.DEFAULTS), _folder(spark, "job1")
    for _ in range(2):
        chunk_feed.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/output", f"{folder}/checkpoint", config)
    return chunk_feed.current(spark, f"{folder}/output").select("root", *chunk_feed.CHUNK_COLUMNS)


def job2_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to all questions from the chunks of all documents, after a run and the same run again."""
    folder = _folder(spark, "job2")
    feed, config = load_config(f"{HERE}/chunk_feed.yaml", chunk_feed.DEFAULTS), load_config(f"{HERE}/answer_questions.yaml", answer_questions.DEFAULTS)
    chunk_feed.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/chunks", f"{folder}/checkpoint", feed)
    for _ in range(2):
        answer_questions.run(spark, f"{folder}/chunks", f"{sf_dir}/benchmark.parquet", f"{folder}/output", config)
    rows = answer_questions.read_answers(spark, f"{folder}/output")
    return rows.select("run", "support", "query_id", "passages", "weak_tiers", "answer", F.array_join("citations", "; ").alias("citations"), "grounded")


STRIPPED = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
#: CTEs up to ``fed``.  Texts without headings: each is one section, of which only its surrounding line ends are cut.
FED_SQL = rf"""bodies AS (SELECT doc_id AS id, trim(text, chr(10)) AS body FROM documents
    WHERE {STRIPPED.format("text")} != '' AND octet_length(encode(text)) <= {ingest.MAX_BYTES}), {windows_sql("bodies")},
counted AS (SELECT id, number, a, piece, length({STRIPPED.format("piece")}) >= {chunking.MIN_CHARS} AS enough, row_number() OVER (PARTITION BY id ORDER BY number, a) AS place FROM parts),
stay AS (SELECT * FROM counted WHERE enough OR (place = 1 AND id NOT IN (SELECT id FROM counted WHERE enough))),
numbered AS (SELECT id, piece, CAST(row_number() OVER (PARTITION BY id ORDER BY number, a) - 1 AS INT) AS part, CAST(count(*) OVER (PARTITION BY id) AS INT) AS parts FROM stay),
named AS (SELECT doc_id AS id, source AS root, {REL} AS doc_rel, substr(sha256({REL}), 1, 16) AS doc_id, {TRUST_SQL} AS trust FROM documents),
fed AS (SELECT root, substr(sha256(concat(doc_id, ':0:', CAST(part AS VARCHAR))), 1, 16) AS chunk_id, doc_id, doc_rel,
    doc_rel || CASE WHEN parts > 1 THEN ' (' || (part + 1) || '/' || parts || ')' ELSE '' END AS citation, trust, part, parts, piece AS text FROM numbered JOIN named USING (id))"""
#: The CTEs of passages, sentences and answers of the engine's queries, over chunks.
FED_HITS_SQL = f"""{WORDS_CTE}, {_postings_sql("SELECT chunk_id, text AS body, CAST(NULL AS VARCHAR) AS head FROM fed")}, {_scores_sql(1.0, 1.0)}, {_ranked_sql(5)},
hits AS (SELECT query_id, chunk_id, score, rank, citation, trust, text FROM ranked JOIN fed USING (chunk_id))"""
ANSWERS_SQL = f"""WITH RECURSIVE {FED_SQL}, {FED_HITS_SQL}{SENTENCES_SQL[len(HITS_SQL):]},
blocks AS (SELECT query_id, rank, citation || chr(10) || '  ' || string_agg(sentence, chr(10) || '  ' ORDER BY sentence_rank) AS block FROM passages JOIN best USING (query_id, rank) GROUP BY query_id, rank, citation),
texts AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS body FROM blocks GROUP BY 1),
w AS (SELECT query_id, count(*) AS passages, coalesce(string_agg(DISTINCT trust, ', ' ORDER BY trust) FILTER (trust NOT IN ('authored', 'curated')), '') AS weak_tiers,
    string_agg(citation, '; ' ORDER BY rank) AS citations FROM passages GROUP BY 1)
SELECT 'all' AS run, CASE WHEN passages IS NULL THEN 'none' WHEN weak_tiers != '' THEN 'weak' ELSE 'strong' END AS support, item_id AS query_id, coalesce(passages, 0) AS passages, coalesce(weak_tiers, '') AS weak_tiers,
    CASE WHEN body IS NULL THEN '{answering.NO_PASSAGE}' ELSE '{answering.LEAD}' || chr(10) || chr(10) || body END AS answer, coalesce(citations, '') AS citations, TRUE AS grounded
FROM benchmark b LEFT JOIN texts t ON t.query_id = item_id LEFT JOIN w ON w.query_id = item_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_chunk_feed, job2_answer_questions)}
ORACLES = {"job1_chunk_feed": f"WITH RECURSIVE {FED_SQL} SELECT * FROM fed", "job2_answer_questions": ANSWERS_SQL}
