"""Language identification by rank-order profiles of n-grams.

A text's letters are lower-cased, every run of anything else is one blank, and a blank is put at both ends.  Its grams are all runs of
one, two and three characters with a letter in the middle: letters, letters beside a blank, and so on; no gram spans two
words.  A profile is the ``size`` most frequent grams by count, then code points.  The out-of-place distance of a document
to a language is the sum, over the grams of the document's profile, of how far apart the ranks in both profiles are, or
``size`` for a gram that the language's profile lacks.  The nearest language wins, the first by code points of several;
the score is one minus the distance over its greatest possible value.

A gram is one number (21 bits for each of its code points), so counts are exact and numbers sort as the grams do.
Each partition sums the counts of its training texts and hands them on whenever they reach ``flush`` grams; Spark adds
them up and ranks them per language, the greatest before the shuffle.  Texts are never shuffled, and long ones are counted
in slices.  What reaches the driver and the tasks is ``size`` grams a language, for at most ``max_languages`` of them; beyond that
number the fit ends in an error.

Edge cases: texts that are null or without a letter are ``und`` with score 0, and so is every text if nothing was learned.  Rows
with a null language teach nothing, nor do texts without a letter.  A null id is not held out.  A document that shares no
gram with any profile gets the first language with score 0.  Repeated rows repeat their result and count once each in
training; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty
from .quality import held_out

SIZE = 400
UNKNOWN = "und"
BLANK, BITS, SLICE = 32, 21, 1 << 19


def letters(text: Column) -> Column:
    """Lower-case letters with single blanks between, before and after the words; one or two blanks if there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text_or_empty(text)), r"\P{L}+", " ")), F.lit(" "))


def merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in ascending order with their summed counts."""
    if len(grams) == 1:
        return grams[0], counts[0]
    distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The grams of what ``letters`` made, ascending, and their counts."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.concatenate([codes, [BLANK]])  # so that every place has two successors but the last two, which are blanks
    parts = []
    for at in range(0, max(len(codes) - 2, 1), SLICE):
        c = codes[at : at + SLICE + 2]
        first, second, third = c[:-2] << 2 * BITS, c[1:-1] << BITS, c[2:]
        blank, after = c[:-2] == BLANK, c[1:-1] == BLANK
        found = np.concatenate([first[~blank], (first | second)[~(blank & after)], (first | second | third)[~after]])
        parts.append(np.unique(found, return_counts=True))
    return merged([p[0] for p in parts], [p[1] for p in parts])


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent grams; ``grams`` ascend, so ties keep the order of code points."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def gram_text(gram: int) -> str:
    return "".join(chr(c) for c in (gram >> 2 * BITS, gram >> BITS & (1 << BITS) - 1, gram & (1 << BITS) - 1) if c)


def profiles(train: DataFrame, *, size: int = SIZE, flush: int = 1 << 20) -> DataFrame:
    """``lang, gram, n, rank`` (from 0) from ``lang, text``: each language's most frequent grams."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[list, list]] = {}
        waiting = 0

        def out() -> Iterator[pd.DataFrame]:
            for lang, parts in held.items():
                grams, n = merged(*parts)
                for at in range(0, len(grams), 1 << 16):
                    yield pd.DataFrame({"lang": lang, "gram": grams[at : at + (1 << 16)], "n": n[at : at + (1 << 16)]})
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["letters"], strict=True):
                grams, n = gram_counts(text)
                parts = held.setdefault(lang, ([], []))
                parts[0].append(grams)
                parts[1].append(n)
                waiting += len(grams)
                if waiting >= flush:
                    for parts in held.values():
                        parts[0][:], parts[1][:] = ([x] for x in merged(*parts))
                    waiting = sum(len(p[0][0]) for p in held.values())
                    if waiting >= flush // 2:
                        yield from out()
                        waiting = 0
        yield from out()

    texts = train.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), letters(F.col("text")).alias("letters")).where("trim(letters) != ''")
    counted = texts.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counted.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)


class RankModel:
    """All profiles: the grams in ascending order and, for each, the languages that have it with their ranks."""

    def __init__(self, rows: list, size: int):
        self.size = size
        self.languages = sorted({r["lang"] for r in rows})
        number = {lang: i for i, lang in enumerate(self.languages)}
        rows = sorted((r["gram"], number[r["lang"]], r["rank"]) for r in rows)
        gram, self.lang, self.rank = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        self.grams, self.start = np.unique(gram, return_index=True)
        self.many = np.diff(np.append(self.start, len(gram)))

    def nearest(self, text: str) -> tuple[str, float]:
        """Language and score of what ``letters`` made of a text."""
        if not self.languages or not text.strip(" "):
            return UNKNOWN, 0.0
        mine = ranked(*gram_counts(text), self.size)
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        ranks = np.flatnonzero(self.grams[at] == mine)
        many = self.many[at[ranks]]
        # Places of all (gram of the document, language that has it), and what each takes off the greatest distance.
        entry = np.repeat(self.start[at[ranks]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        nearness = np.bincount(self.lang[entry], self.size - np.abs(np.repeat(ranks, many) - self.rank[entry]), len(self.languages))
        best = int(np.argmax(nearness))
        return self.languages[best], float(nearness[best] / (self.size * len(mine)))


def fit(train: DataFrame, *, size: int = SIZE, max_languages: int = 4096) -> RankModel:
    """A model of ``lang, text`` rows."""
    table = stage(profiles(train, size=size), "language-profiles")
    found = table.select("lang").distinct().limit(max_languages + 1).count()
    if found > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages if their profiles fit into a task")
    return RankModel(table.select("lang", "gram", "rank").collect(), size)


def predict(docs: DataFrame, model: RankModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.nearest(t) for t in batch["letters"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), letters(F.col(text_col)).alias("letters"))
    return base.mapInPandas(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SIZE, max_languages: int = 4096) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learned from the languages of the rows that are not held out."""
    known = ~F.coalesce(held_out(F.col(id_col)), F.lit(False))
    train = docs.where(known).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return predict(docs, fit(train, size=size, max_languages=max_languages), id_col=id_col, text_col=text_col)


def oracle(size: int = SIZE) -> str:
    return rf"""
WITH table_of(n, crc) AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FROM range(256) r(i)),
crcs AS (SELECT list(crc ORDER BY n) AS crc FROM table_of),
d AS (SELECT row_number() OVER () AS row_id, doc_id, lang, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g'), ' ') || ' ' AS t,
  coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: ascii(b)::BIGINT)),
    lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) % 3 = 1, false) AS held_out
  FROM documents, crcs),
s AS (SELECT row_id, string_split(t, '') AS c FROM d WHERE trim(t, ' ') <> ''),
g AS (SELECT row_id, unnest(list_concat(c, list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS gram
  FROM s),
c AS (SELECT row_id, gram, count(*) AS n FROM g WHERE trim(gram, ' ') <> '' AND NOT (length(gram) = 3 AND gram[2:2] = ' ') GROUP BY ALL),
mine AS (SELECT row_id, gram, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, gram) - 1 AS r FROM c QUALIFY r < {size}),
sums AS (SELECT lang, gram, sum(n) AS n FROM c JOIN d USING (row_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
prof AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS p FROM sums QUALIFY p < {size}),
near AS (SELECT row_id, prof.lang, sum({size} - abs(r - p)) AS s FROM mine JOIN prof USING (gram) GROUP BY ALL),
best AS (SELECT row_id, lang, s FROM near QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY s DESC, lang) = 1),
sizes AS (SELECT row_id, count(*) AS m FROM mine GROUP BY 1)
SELECT doc_id, held_out, CASE WHEN m IS NULL THEN '{UNKNOWN}' ELSE coalesce(best.lang, (SELECT min(lang) FROM prof), '{UNKNOWN}') END AS lang_pred,
  coalesce(CAST(s AS DOUBLE) / ({size} * m), 0) AS score
FROM d LEFT JOIN sizes USING (row_id) LEFT JOIN best USING (row_id)"""
