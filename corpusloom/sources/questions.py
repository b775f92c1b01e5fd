"""Golden questions from YAML, checked on the driver (a question set is written by hand)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..errors import EvaluationError

QUESTION_SCHEMA = "query_id string, place int, question string, tags array<string>, note string"
TARGET_SCHEMA = "query_id string, doc string, section string, heading string"


@dataclass(frozen=True)
class Question:
    id: str
    question: str
    targets: tuple[tuple[str, str | None, str | None], ...]
    tags: tuple[str, ...] = ()
    note: str = ""


def _target(entry: object) -> tuple[str, str | None, str | None] | None:
    if isinstance(entry, str):
        return entry, None, None
    if isinstance(entry, Mapping):
        text = lambda key: None if entry.get(key) is None else str(entry[key])
        return text("doc") or "", text("section"), text("heading")
    return None


def load_questions(path: str | Path) -> list[Question]:
    file = Path(path)
    if not file.is_file():
        raise EvaluationError(f"no question set at {file}")
    try:
        data = yaml.safe_load(file.read_text(encoding="utf-8")) or []
    except yaml.YAMLError as e:
        raise EvaluationError(f"{file}: invalid YAML: {e}") from e
    if not isinstance(data, list):
        raise EvaluationError(f"{file}: expected a list of questions")
    out: dict[str, Question] = {}
    for n, entry in enumerate(data, 1):
        if not isinstance(entry, Mapping):
            raise EvaluationError(f"{file}: entry {n - 1} is not a mapping")
        name, text = str(entry.get("id") or f"q{n}"), str(entry.get("question") or "").strip()
        if name in out:
            raise EvaluationError(f"{file}: duplicate question id {name!r}")
        if not text:
            raise EvaluationError(f"{file}: question {name!r} has no text")
        targets = tuple(t for t in map(_target, entry.get("relevant") or []) if t)
        out[name] = Question(name, text, targets, tuple(map(str, entry.get("tags") or ())), str(entry.get("note") or ""))
    if not out:
        raise EvaluationError(f"{file}: the question set is empty")
    return list(out.values())


def as_frames(spark: SparkSession, questions: list[Question]) -> tuple[DataFrame, DataFrame]:
    """(questions, targets)."""
    asked = spark.createDataFrame([(q.id, n, q.question, list(q.tags), q.note) for n, q in enumerate(questions)], QUESTION_SCHEMA)
    return asked, spark.createDataFrame([(q.id, *t) for q in questions for t in q.targets], TARGET_SCHEMA)
