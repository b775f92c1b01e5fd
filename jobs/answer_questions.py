"""Job 2: answers a table of questions from the chunks that job 1 keeps, with citations and how far they can be trusted.

    python jobs/answer_questions.py --chunks out --questions data/benchmark.parquet --output answers --config jobs/answer_questions.yaml

Each question gets its best passages by BM25, within a budget of characters; the sentences that share most words with the
question are quoted under their citations; what the answer cites is checked against what was supplied.  One run, named in
the configuration, is written as

    output/passages/run=<run>/trust=<tier>/      query_id, rank, chunk_id, citation, score, ref, passage
    output/answers/run=<run>/support=<support>/  query_id, answer, citations, passages, weak_tiers, grounded

``support`` is ``none`` without a passage, ``weak`` if any passage is of a tier below curated (before the floor is applied), else
``strong``.  A run that is made again replaces its own folders whole, so it leaves the same rows and no stale partition; other
runs stay, to be compared with it.

Questions are ``item_id, text``: a null or empty one, or one without a word of the chunks, gets the answer that says so;
rows that repeat an id and text are one question, and of an id with several texts the least counts; a null id is no question.
The texts of the chunks are read once, against the words asked for; answers are made from the passages as written.
"""

from __future__ import annotations

import logging
import os
import re
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusloom.errors import ConfigError  # noqa: E402
from corpusloom.operators import answering, ranking  # noqa: E402
from jobs import chunk_feed  # noqa: E402
from jobs.common import command_line, settings  # noqa: E402

log = logging.getLogger("jobs.answer_questions")

DEFAULTS = {"run": "all", "passages": 5, "max_chars": answering.CONTEXT_CHARS, "sentences": answering.SENTENCES, "trust_floor": None, "weights": [1.0, 1.0]}
PASSAGE_COLUMNS = ("query_id", "rank", "chunk_id", "citation", "score", "ref", "passage", "trust")
ANSWER_COLUMNS = ("query_id", "answer", "citations", "passages", "weak_tiers", "grounded", "support")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(path).where("item_id is not null")
    return found.groupBy(F.col("item_id").alias("query_id")).agg(F.coalesce(F.min("text"), F.lit("")).alias("question"))


def passages(chunks: DataFrame, questions: DataFrame, config: dict) -> DataFrame:
    """The best passages of each question, in order, as far as the budget goes."""
    best = ranking.search_texts(chunks, questions, int(config["passages"]), weights=tuple(config["weights"]))
    # A few rows a question meet the chunks by id: texts that no question asks for are left where they are.
    return answering.within_budget(best.join(chunks, "chunk_id"), int(config["max_chars"]), text_col="text").select(*PASSAGE_COLUMNS)


def answers(found: DataFrame, questions: DataFrame, config: dict) -> DataFrame:
    quoted, warned = answering.trust_floor(found, config["trust_floor"])
    said = answering.check_citations(answering.extractive_answers(quoted, questions, int(config["sentences"])))
    joined = said.join(warned, "query_id", "left")
    count = F.coalesce("passages", F.lit(0))
    support = F.when(count == 0, "none").when(F.col("weak") > 0, "weak").otherwise("strong")
    return joined.select("query_id", "answer", "citations", count.alias("passages"), F.coalesce("weak_tiers", F.lit("")).alias("weak_tiers"), "grounded", support.alias("support"))


def read_answers(spark: SparkSession, output: str) -> DataFrame:
    """The answers of all runs."""
    kind = "query_id bigint, answer string, citations array<string>, passages bigint, weak_tiers string, grounded boolean, run string, support string"
    return spark.read.schema(kind).parquet(f"{output}/answers")


def run(spark: SparkSession, chunks: str, questions: str, output: str, config: dict | None = None) -> dict[str, int]:
    """Makes the run that the configuration names; the number of answers by support."""
    config, began = settings(config, DEFAULTS), time.monotonic()
    name = str(config["run"])
    if not re.fullmatch(r"[\w.-]+", name):
        raise ConfigError(f"a run is named by letters, digits, dots, dashes and underscores, not {name!r}")
    asked = read_questions(spark, questions)
    log.info("reading questions of %s and the chunks of %s", questions, chunks)
    found = passages(chunk_feed.current(spark, chunks).select("chunk_id", "citation", "trust", "text"), asked, config)
    found.write.mode("overwrite").partitionBy("trust").parquet(f"{output}/passages/run={name}")
    written = spark.read.schema(found.schema).parquet(f"{output}/passages/run={name}")
    answers(written, asked, config).write.mode("overwrite").partitionBy("support").parquet(f"{output}/answers/run={name}")
    counts = {r["support"]: r["n"] for r in read_answers(spark, output).where(F.col("run") == name).groupBy("support").agg(F.count("*").alias("n")).collect()}
    log.info("%d passages written to %s/passages/run=%s", written.count(), output, name)
    log.info("answers written to %s/answers/run=%s: %s; %.1f s", output, name, ", ".join(f"{counts[s]} {s}" for s in sorted(counts)) or "none", time.monotonic() - began)
    return counts


if __name__ == "__main__":
    sys.exit(command_line(run, ("chunks", "questions", "output"), DEFAULTS, __doc__))
