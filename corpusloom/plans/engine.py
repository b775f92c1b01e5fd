"""The engine: index a scope, search it, evaluate it, answer from it.  All queries are batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EvaluationError, GenerationError, IndexStoreError
from ..functions.embed import Embedder
from ..operators import answering, chunking, dense, evaluation, ingest, ranking, vectors
from ..staging import stage
from .store import IndexStore, Snapshot

MODES = ("lexical", "dense", "fused")
VECTOR_SCHEMA = "chunk_id string, embedding array<float>, signature string"
OUTCOME_SCHEMA = "query_id string, question string, retriever string, ranked array<string>, citations array<string>, positions array<int>, target_positions array<int>, total_relevant int, targets array<string>"


@dataclass(frozen=True)
class IndexReport:
    added: int
    changed: int
    unchanged: int
    removed: int
    chunks_written: int = 0
    chunks_dropped: int = 0
    embedded: int = 0
    signature: str = ""

    def render(self) -> str:
        rows = (("added", self.added), ("changed", self.changed), ("unchanged (skipped)", self.unchanged), ("removed", self.removed))
        return "\n".join(f"  {n:>5}  {name}" for name, n in rows)


def one_of_each(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``documents`` without repeated ids, their ids and hashes).  Of an id's rows the one with the greatest hash stays, the
    same whenever the result is computed; texts are shuffled for ids that do repeat, of which there should be none."""
    found = stage(documents.groupBy("doc_id").agg(F.max("content_hash").alias("content_hash"), F.count("*").alias("rows")), "index-found")
    repeated = found.where("rows > 1").select("doc_id")
    if not repeated.isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
        last = documents.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(row, F.struct(F.coalesce("content_hash", F.lit("")), F.xxhash64(row))).alias("d"))
        documents = documents.join(repeated, "doc_id", "left_anti").unionByName(last.select("d.*"))
    return documents, found.select("doc_id", "content_hash")


def build(spark: SparkSession, store: IndexStore, documents: DataFrame, embedder: Embedder | None, *, rebuild: bool = False, dry_run: bool = False, max_chars: int = chunking.MAX_CHARS) -> IndexReport:
    """Brings the index to the state of ``documents`` and publishes it as one snapshot.

    Unchanged documents are neither chunked nor embedded again, nor are their rows written, but when segments are merged;
    vectors are made for every chunk that has none of the embedder's signature, whatever the reason, and dropped with
    their chunks.  A run that finds nothing to do publishes nothing; ``dry_run`` writes nothing, also with ``rebuild``.
    """
    current = None if rebuild else store.current()
    documents, found = one_of_each(documents)
    known = current.table("documents") if current else spark.createDataFrame([], "doc_id string, content_hash string")
    plan = stage(ingest.plan(found, known.select("doc_id", "content_hash")), "index-plan")
    counts = {r["status"]: r["n"] for r in plan.groupBy("status").agg(F.count("*").alias("n")).collect()}
    report = {s: counts.get(s, 0) for s in ("added", "changed", "unchanged", "removed")}
    if dry_run:
        return IndexReport(**report)

    todo = ingest.work(plan)
    gone = plan.where(F.col("status").isin("changed", "removed")).select("doc_id")
    made = chunking.chunks(documents.join(F.broadcast(todo) if report["added"] + report["changed"] < 100_000 else todo, "doc_id", "left_semi"), max_chars=max_chars)
    made = stage(made, "index-chunks")
    stamp = F.lit(datetime.now(UTC).replace(tzinfo=None, microsecond=0)).cast("timestamp")
    sizes = made.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    new_docs = documents.join(todo, "doc_id", "left_semi").join(sizes, "doc_id", "left").select("doc_id", "rel", "content_hash", "trust", "size", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), stamp.alias("indexed_at"))
    fresh = ranking.build_index(made.withColumn("headings", F.array_join("heading_path", " / ")), headings_col="headings", stem=True, positions=True, staged=True)
    chunks, terms, corpus, lost = made, fresh.terms, fresh.corpus, 0
    if current:
        stay, dropped = ingest.drop_documents(current.table("chunks"), gone)
        dropped = stage(dropped, "index-dropped")
        lost, chunks = dropped.count(), stay.unionByName(made)
        corpus = ranking.corpus_row(current.table("lengths").join(dropped, "chunk_id", "left_anti").unionByName(fresh.lengths))
        terms = ranking.with_idf(ranking.changed_terms(current.table("terms"), current.table("postings"), dropped, fresh.postings), corpus)

    signature, embedded, renewed = embedder.signature if embedder else "", 0, ()
    table = old = spark.createDataFrame([], VECTOR_SCHEMA)
    if current:
        if current.signature == signature and (embedder is None or current.vectors_sound(embedder.dim)):
            # A chunk id says where a chunk is, not what it says: of changed documents no vector is kept.
            old = current.table("vectors").where(F.col("signature") == signature).join(dropped, "chunk_id", "left_anti")
        else:
            renewed = ("vectors",)
    if embedder is not None:
        missing = chunks.join(old.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "text")
        fresh_vectors = embedder.encode(missing, "chunk_id", "text").select(F.col("id").alias("chunk_id"), "embedding", F.lit(signature).alias("signature"))
        table, embedded = vectors.check(fresh_vectors, embedder.dim), missing.count()
    written = made.count()
    if current is None or renewed or embedded or report["added"] + report["changed"] + report["removed"]:
        rows = {"documents": new_docs, "chunks": made, "postings": fresh.postings, "lengths": fresh.lengths, "vectors": table}
        left = {"doc_id": gone, "chunk_id": dropped} if current and report["changed"] + report["removed"] else None
        store.publish(rows, {"terms": terms, "corpus": corpus}, size=written, base=current, gone=left, renewed=renewed, embedder_signature=signature, stemmed=True)
    return IndexReport(**report, chunks_written=written, chunks_dropped=lost, embedded=embedded, signature=signature)


def open_index(store: IndexStore) -> Snapshot:
    snapshot = store.current()
    if snapshot is None or snapshot.table("chunks").isEmpty():
        raise IndexStoreError(f"the index at {store.directory} is empty; index the scope first")
    return snapshot


def question_frame(spark: SparkSession, questions: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(f"q{n}", q) for n, q in enumerate(questions, 1)], "query_id string, question string")


class Retriever:
    """Search over one snapshot; dense search needs vectors of the embedder's own signature."""

    def __init__(self, snapshot: Snapshot, embedder: Embedder | None = None, *, candidates: int = 50, prefer_trust: bool = False, weights: tuple[float, float] = (0.5, 1.0)):
        self.snapshot, self.candidates, self.prefer_trust, self.weights = snapshot, max(1, candidates), prefer_trust, weights
        same = embedder is not None and snapshot.signature == embedder.signature
        self.embedder = embedder if same and not snapshot.table("vectors").isEmpty() else None

    @property
    def has_dense(self) -> bool:
        return self.embedder is not None

    def lexical(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        return ranking.lexical_search(self.snapshot.lexical(), queries, self.candidates if k is None else k, weights=self.weights, phrases=True)

    def dense(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        if self.embedder is None:
            return queries.sparkSession.createDataFrame([], "query_id string, chunk_id string, score double, rank int")
        encoded = self.embedder.encode(queries, "query_id", "question").withColumnRenamed("id", "query_id")
        return dense.dense_search(self.snapshot.table("vectors"), encoded, self.candidates if k is None else k)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Hits in order: chunk columns, score, retrievers, ranks, rank.  Blank questions and k < 1 have none."""
        lanes = self.lexical(queries).withColumn("retriever", F.lit("lexical"))
        if self.has_dense:
            lanes = lanes.unionByName(self.dense(queries.where(F.trim("question") != "")).withColumn("retriever", F.lit("dense")))
        fused = ranking.fuse(lanes.select("query_id", "chunk_id", "rank", "retriever"))
        return ranking.hydrate(fused, self.snapshot.table("chunks"), max(k, 0), prefer_trust=self.prefer_trust)

    def ranked(self, mode: str, queries: DataFrame, k: int) -> DataFrame:
        """``query_id, chunk_id, rank`` of one mode."""
        if mode not in MODES:
            raise EvaluationError(f"unknown retrieval mode {mode!r}. Known: {', '.join(MODES)}")
        rows = self.search(queries, k) if mode == "fused" else getattr(self, mode)(queries, k)
        return rows.select("query_id", "chunk_id", "rank")


@dataclass
class EvalRun:
    """Outcomes of a run and what they were measured on; metrics can be computed again from it without an index."""

    outcomes: DataFrame
    k: int
    profile: str = ""
    embedder: str = ""
    corpus_chunks: int = 0
    golden_set: str = ""
    created_at: str = ""

    def summary(self) -> DataFrame:
        return evaluation.summary(self.outcomes, self.k)

    def save(self, path: str | Path) -> None:
        file = Path(path)
        file.parent.mkdir(parents=True, exist_ok=True)
        rows = [json.loads(r) for r in self.outcomes.orderBy("retriever", "query_id").toJSON().collect()]  # a hand-written set
        head = {k: getattr(self, k) for k in ("profile", "embedder", "k", "corpus_chunks", "created_at", "golden_set")}
        file.write_text(json.dumps(head | {"outcomes": rows}, indent=2) + "\n")

    @classmethod
    def load(cls, spark: SparkSession, path: str | Path) -> EvalRun:
        file = Path(path)
        if not file.is_file():
            raise EvaluationError(f"no cached run at {file}")
        data = json.loads(file.read_text())
        names = [f.split()[0] for f in OUTCOME_SCHEMA.split(", ")]
        rows = [tuple(o.get(n, [] if n in ("ranked", "citations", "positions", "target_positions", "targets") else None) for n in names) for o in data.get("outcomes", [])]
        return cls(spark.createDataFrame(rows, OUTCOME_SCHEMA), int(data.get("k", 10)), str(data.get("profile", "")), str(data.get("embedder", "")), int(data.get("corpus_chunks", 0)), str(data.get("golden_set", "")), str(data.get("created_at", "")))


def evaluate(retriever: Retriever, questions: DataFrame, targets: DataFrame, *, k: int = 10, modes: Sequence[str] = MODES, profile: str = "") -> EvalRun:
    """All questions in all usable modes: without vectors neither dense nor fused is measured."""
    usable = [m for m in modes if m == "lexical" or retriever.has_dense]
    if not usable:
        raise EvaluationError("no usable retrieval mode: the index has no vectors")
    spark = questions.sparkSession
    chunks = retriever.snapshot.table("chunks")
    lanes = None
    for mode in usable:
        lane = retriever.ranked(mode, questions, k).withColumn("retriever", F.lit(mode))
        lanes = lane if lanes is None else lanes.unionByName(lane)
    lanes = stage(lanes, "lanes")
    ranked = lanes.join(chunks.select("chunk_id", "doc_rel", "section_ref", "heading_path", "citation"), "chunk_id")
    modes_df = spark.createDataFrame([(m,) for m in usable], "retriever string")
    rows = evaluation.outcomes(ranked, targets, questions, modes_df)
    in_order = lambda c: F.array_sort(F.collect_list(F.struct("rank", c)))[c]
    lists = ranked.groupBy("query_id", "retriever").agg(in_order("chunk_id").alias("ranked"), in_order("citation").alias("citations"))
    labels = targets.groupBy("query_id").agg(F.collect_list(evaluation.target_label(F.col("doc"), F.col("section"), F.col("heading"))).alias("targets"))
    none = F.array().cast("array<string>")
    full = rows.join(lists, ["query_id", "retriever"], "left").join(labels, "query_id", "left").join(questions.select("query_id", "question"), "query_id")
    names = [f.split()[0] for f in OUTCOME_SCHEMA.split(", ")]
    full = full.select(*[F.coalesce(n, none).alias(n) if n in ("ranked", "citations", "targets") else F.col(n) for n in names])
    # Written down at once: a run is what was measured, not a plan to measure it again.
    return EvalRun(stage(full, "outcomes"), k, profile, retriever.snapshot.signature, chunks.count(), "", datetime.now(UTC).isoformat(timespec="seconds"))


def render_run(run: EvalRun) -> str:
    table = {r["retriever"]: r for r in run.summary().collect()}
    if not table:
        return "no outcomes"
    questions = max(r["questions"] for r in table.values())
    lines = [f"profile={run.profile or '-'}  embedder={run.embedder or '-'}  k={run.k}  chunks={run.corpus_chunks}", f"questions: {questions}", ""]
    lines.append("  " + "retriever".ljust(12) + "".join(m.rjust(11) for m in evaluation.METRICS))
    lines += ["  " + m.ljust(12) + "".join(f"{table[m][x]:.3f}".rjust(11) for x in evaluation.METRICS) for m in MODES if m in table]
    text = {r["query_id"]: r["question"] for r in run.outcomes.select("query_id", "question").distinct().collect()}
    missed: dict[str, list] = {}
    for r in evaluation.misses(run.outcomes).orderBy("retriever", "place").collect():
        missed.setdefault(r["retriever"], []).append(r["query_id"])
    counts = {r["retriever"]: r["n"] for r in run.outcomes.where(F.size("positions") == 0).groupBy("retriever").agg(F.count("*").alias("n")).collect()}
    for mode, ids in missed.items():
        lines += ["", f"  {mode}: {counts[mode]} question(s) found nothing relevant", *[f"    - {q}: {(text[q] or '')[:64]}" for q in ids]]
    return "\n".join(lines)


class ExtractiveGenerator:
    """Answers with the passages' own best sentences: no model, nothing leaves the cluster."""

    name = "extractive"

    def __init__(self, sentences: int = answering.SENTENCES):
        self.sentences = max(1, sentences)

    def answer(self, passages: DataFrame, questions: DataFrame) -> DataFrame:
        """Sources are the passages given; what their sentences mention is quoted, so nothing can be invented."""
        answers = answering.extractive_answers(passages, questions, self.sentences)
        none = F.array().cast("array<string>")
        return answers.select("*", F.col("citations").alias("supported"), none.alias("unsupported"), F.lit(True).alias("grounded"))


class ModelGenerator:
    """Answers by a model that the caller brings, one call for each question, from the executors.

    ``complete(instructions, prompt, max_tokens)`` gives (text, why it stopped): "end", "length" or "refusal".  Beside the
    answer stand the citations that no passage supports, and ``warnings`` of refusals, cut answers and those citations.
    """

    name = "model"

    def __init__(self, complete: Callable[[str, str, int], tuple[str, str]], max_tokens: int = 4096):
        self.complete, self.max_tokens = complete, max_tokens

    def answer(self, passages: DataFrame, questions: DataFrame) -> DataFrame:
        complete, limit = self.complete, self.max_tokens
        blocks = answering.formatted(passages).join(passages.select("query_id", "rank", "citation"), ["query_id", "rank"])
        given = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block", "citation"))).alias("p"))
        prompt = F.concat_ws("\n\n", F.array_join(F.col("p.block"), "\n\n"), F.concat(F.lit("Question: "), F.col("question")))
        asked = questions.join(given, "query_id", "left").select("query_id", F.when(F.col("p").isNotNull(), prompt).alias("prompt"), F.coalesce(F.col("p.citation"), F.array().cast("array<string>")).alias("citations"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                replies = [complete(answering.INSTRUCTIONS, p, limit) if p is not None else (answering.NO_PASSAGE, "end") for p in batch["prompt"]]
                yield batch.drop(columns="prompt").assign(answer=[r[0] or "" for r in replies], stop=[r[1] for r in replies])

        kind = asked.schema["query_id"].dataType.simpleString()
        replied = asked.mapInPandas(run, f"query_id {kind}, citations array<string>, answer string, stop string")
        checked = answering.check_citations(stage(replied, "replies"))
        notes = F.array(
            F.when(F.col("stop") == "refusal", F.lit("the model declined to answer")),
            F.when(F.col("stop") == "length", F.lit(f"the answer was cut at {limit} tokens")),
            F.when(F.size("unsupported") > 0, F.concat(F.lit("cited but not supplied: "), F.array_join("unsupported", ", "))),
        )
        grounded = F.col("grounded") & (F.col("stop") != "refusal")
        return checked.withColumn("grounded", grounded).withColumn("warnings", F.filter(notes, lambda n: n.isNotNull())).drop("stop")


def make_generator(config) -> ExtractiveGenerator:
    provider = str((config or {}).get("provider", "extractive")).strip().lower()
    if provider in ("extractive", "none", "local", "off"):
        return ExtractiveGenerator(int((config or {}).get("sentences", answering.SENTENCES)))
    raise GenerationError(f"unknown generation provider {provider!r}. Known: extractive; others can be passed to ask() as objects with an answer method")


def ask(retriever: Retriever, questions: DataFrame, generator=None, *, k: int = 5, expand: bool = True, floor: str | None = None, max_chars: int = answering.CONTEXT_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, passages, trust warnings).  The budget is applied before the trust floor."""
    hits = retriever.search(questions, k)
    hits = answering.with_parents(hits, retriever.snapshot.table("chunks")) if expand else hits.withColumn("context", F.col("text"))
    passages, warnings = answering.trust_floor(answering.within_budget(hits, max_chars), floor)
    return (generator or ExtractiveGenerator()).answer(passages, questions), passages, warnings
