"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Each text becomes a vector of statistics (character classes, word, line and sentence shape, repetition).  Random
Fourier features approximate a Gaussian kernel over the standardised vectors; every partition sums its own normal
equations, which are added up and solved for ridge scores; a monotone fit on a held-back part of the training rows
(pool adjacent violators over at most 4096 score bins) turns scores into probabilities.

Edge cases: null texts count as empty; an empty text has a zero vector of counts and is scored like any other.
Without a training row of each class, every score is the training mean (0.5 without any).  Labels that are null or
match no document are not used; several labels of one id are several training rows.  Repeated rows repeat their
score; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty

STATISTICS = (
    "log_bytes", "log_words", "lower", "upper", "digit", "space", "newline", "sentence_marks", "commas", "quotes", "brackets", "symbols",
    "controls", "non_ascii", "word_mean", "word_std", "word_long", "word_short", "capitalised", "all_caps", "type_share", "top_share",
    "line_mean", "line_std", "line_repeats", "words_per_sentence", "symbol_words", "adjacent_marks", "bigram_repeats",
)


def _class_table() -> np.ndarray:
    """A class number for each byte: lower, upper, digit, space, newline, ... as the statistics name them."""
    table = np.full(256, 11, dtype=np.uint8)  # what is left over is non-ASCII
    groups = (
        bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" \t", b"\n\r\x0b\x0c", b".!?", b",;:", b"'\"`", b"()[]{}<>",
        b"#$%&*+-/=@\\^_|~", bytes(b for b in range(32) if b not in b" \t\n\r\x0b\x0c") + b"\x7f",
    )
    for number, members in enumerate(groups):
        table[np.frombuffer(members, dtype=np.uint8)] = number
    return table


CLASSES = _class_table()


def text_statistics(text: str) -> list[float]:
    """The values named in STATISTICS, each of bounded size, from the whole text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    total = max(len(raw), 1)
    kinds = CLASSES[raw]
    share = np.bincount(kinds, minlength=12) / total
    space = (kinds == 3) | (kinds == 4)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    n = max(len(lengths), 1)
    words = text.split()
    counts = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    lines = text.split("\n")
    line_lengths = np.fromiter(map(len, lines), dtype=np.float64, count=len(lines))
    upper = (kinds == 1).astype(np.int32)
    mark = (kinds >= 5) & (kinds <= 9)
    run = np.concatenate(([0], np.cumsum(upper)))
    caps = run[ends] - run[starts]
    symbol = np.concatenate(([0], np.cumsum((kinds == 9).astype(np.int32))))
    sentences = int((kinds == 5).sum())
    return [
        np.log1p(len(raw)), np.log1p(len(lengths)), share[0], share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8], share[9],
        share[10], share[11], lengths.mean() / 20 if len(lengths) else 0.0, lengths.std() / 20 if len(lengths) else 0.0, (lengths > 12).sum() / n,
        (lengths < 3).sum() / n, (caps > 0).sum() / n, ((caps * 2 > lengths) & (lengths > 1)).sum() / n, len(counts) / n, max(counts.values(), default=0) / n,
        np.log1p(line_lengths.mean()), np.log1p(line_lengths.std()), 1 - len(set(lines)) / len(lines), np.log1p(len(lengths) / (sentences + 1)),
        (symbol[ends] > symbol[starts]).sum() / n, (mark[1:] & mark[:-1]).sum() / total, 1 - len(pairs) / max(len(words) - 1, 1),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x`` with x the text's statistics."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": [text_statistics(t) for t in batch["text"]]})

    return base.mapInPandas(measure, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class QualityModel:
    """Of fixed size: 2 vectors of statistics, the random projection, the weights, the calibration's knots."""

    mean: np.ndarray
    std: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0]), np.array([0.5])))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        fourier = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1])
        return np.hstack([np.ones((len(x), 1)), fourier])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights if self.weights is not None else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def pool_adjacent_violators(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (centre, mean) of the monotone fit to sums ``total`` of ``weight`` rows at increasing ``x``."""
    blocks: list[list[float]] = []
    for at, t, w in zip(x, total, weight, strict=True):
        blocks.append([at * w, t, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(train: DataFrame, *, components: int = 384, bandwidth: float = 4.0, ridge: float = 1e-4, bins: int = 4096, seed: int = 7, max_rows: int = 1_000_000) -> QualityModel:
    """Fit on ``doc_id, x, y`` (y 0 or 1).  Above ``max_rows`` rows, a hash of the id picks about that many (the
    stated bound on the labelled sample).  What reaches the driver has a fixed size: the summed equations and the bins.
    """
    d = len(STATISTICS)
    columns = [F.col("x")[i] for i in range(d)]
    facts = train.agg(F.count("*").alias("n"), F.sum("y").alias("ones"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    rng = np.random.default_rng(seed)
    model = QualityModel(np.zeros(d), np.ones(d), rng.normal(size=(d, components)) / bandwidth, rng.uniform(0, 2 * np.pi, components))
    if not facts["n"]:
        return model
    share = facts["ones"] / facts["n"]
    model.knots = (np.array([0.0]), np.array([share]))
    if share in (0.0, 1.0):
        return model
    model.mean = np.array([facts[f"m{i}"] for i in range(d)])
    model.std = np.array([facts[f"s{i}"] or 1.0 for i in range(d)])
    if facts["n"] > max_rows:
        train = train.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * max_rows / facts["n"]))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    size = components + 1

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = model.features(np.array(batch["x"].tolist()))
            gram += z.T @ z
            right += z.T @ batch["y"].to_numpy(dtype=float)
        yield pd.DataFrame({"row": np.arange(size), "sums": [*np.hstack([gram, right[:, None]])]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": rows["row"].iloc[:1], "sums": [np.sum(rows["sums"].tolist(), axis=0)]})

    # One small matrix per partition of the labelled rows; the rows of a given number are added up in one task.
    parts = train.where(fold != 0).select("x", "y").coalesce(max(1, min(64, facts["n"] // 20_000))).mapInPandas(equations, "row int, sums array<double>")
    summed = {r["row"]: r["sums"] for r in parts.groupBy("row").applyInPandas(add, "row int, sums array<double>").collect()}
    whole = np.array([summed[i] for i in range(size)])
    penalty = ridge * whole[0, 0] * np.eye(size)  # by the rows in the equations, so a sample is penalised as a table of its size
    penalty[0, 0] = 0
    model.weights = np.linalg.solve(whole[:, :size] + penalty + 1e-9 * np.eye(size), whole[:, size])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = np.clip(model.raw(np.array(batch["x"].tolist())), -1, 2)
                yield pd.DataFrame({"bin": np.floor((raw + 1) / 3 * (bins - 1)).astype(int), "raw": raw, "y": batch["y"].astype(float)})

    held = train.where(fold == 0).select("x", "y").mapInPandas(binned, "bin int, raw double, y double")
    rows = held.groupBy("bin").agg(F.avg("raw").alias("at"), F.sum("y").alias("t"), F.count("*").alias("w")).orderBy("bin").collect()
    if rows:
        model.knots = pool_adjacent_violators(*(np.array([float(r[k]) for r in rows]) for k in ("at", "t", "w")))
    return model


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score``."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.score(np.array(batch["x"].tolist()))})

    return stats.mapInPandas(apply, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def train_model(stats: DataFrame, labels: DataFrame, *, label_col: str = "quality", **options) -> QualityModel:
    """A model fitted on ``doc_id, x`` without held-out rows."""
    known = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return fit(stage(stats.join(known, "doc_id"), "quality-train"), **options)


def filter_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``.  Each text is measured once, and its
    statistics are written beside the row, so no text is shuffled."""
    name = "statistics"
    while name in docs.columns:
        name += "_"

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([text_statistics(t) for t in texts], dtype=object)

    rows = stage(docs.withColumn(name, measured(text_or_empty(text_col))), "quality-rows")
    model = train_model(rows.select(F.col(id_col).alias("doc_id"), F.col(name).alias("x")), labels, **options)

    @F.pandas_udf("double")
    def row_score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist()).reshape(len(x), len(STATISTICS))))

    return rows.where(row_score(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; held-out rows' labels are never read."""
    stats = stage(statistics(docs, id_col, text_col), "quality-stats")
    scored = score(stats, train_model(stats, labels, label_col=label_col, **options))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
