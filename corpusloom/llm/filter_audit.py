"""How document filters interact: what each removes, alone and after others, in every order of application.

Words are exploded into rows and aggregated by (document, word), then by document, for totals and distinct words.  Flags
that need no words (capitals, symbols, repeats of a text) are found beside them and outer-joined, since a document
without words has no word rows.  The set of filters that a document fails is a number below 32; per part, 32 conditional
counts (of documents, of good and of toxic ones) hold all that the orders ask for, so the 120 orders are sums over those
counts and read no documents.

A document is the triple of its id, a 64-bit hash of its text and its part; rows that repeat one are counted together.  Texts are
shuffled once, by document and after equal rows have met in their tasks; both aggregations of words then need no shuffle,
which would be of some three times the bytes of the texts.  A text that a third of the rows share meets no join by text: its first
id comes from a partial aggregation, and rows look themselves up by (id, text), of which no pair is hot.

Edge cases: a null text is empty; an empty text fails A, not B, C or D, and E if a smaller id's text is empty too.  A
null language is the part ''.  Rows that repeat an id and text are judged alike and each counted; none of them is smaller
than another.  A null id is neither smaller nor larger than any, so it never fails E and has no labels.  Of several
labels of one id, 1 wins; labels other than 1, null ones included, count as 0.  An empty table has no parts, so no rows.
Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Words wanted, percentages of distinct words and of capitals, symbols that must not occur.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
MEASURES = ("docs", "good", "toxic")
BLANKS = r"[\x20\x09-\x0D]+"


DOCUMENT = ("doc_id", "key", "part")


def word_facts(documents: DataFrame) -> DataFrame:
    """``doc_id, key, part, words, distinct`` of documents with words, from ``doc_id, key, part, text``."""
    once = documents.groupBy(*DOCUMENT).agg(F.any_value("text").alias("text"))
    words = once.select(*DOCUMENT, F.explode(F.split("text", BLANKS)).alias("word")).where("word != ''")
    by_word = words.groupBy(*DOCUMENT, "word").agg(F.count("*").alias("n"))
    return by_word.groupBy(*DOCUMENT).agg(F.sum("n").alias("words"), F.count("*").alias("distinct"))


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, key, part, copies, mask`` for each document, which ``copies`` rows repeat: bit ``i`` of ``mask`` is set if
    it fails the ``i``-th filter."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("text"))
    documents = base.withColumn("key", F.xxhash64("text"))
    capitals = 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > MAX_CAPITALS * F.length("text")
    seen = documents.select(*DOCUMENT, F.unhex(F.sha2("text", 256)).alias("digest"), capitals.alias("c"), F.col("text").rlike(SYMBOLS).alias("d"))
    flags = seen.groupBy(*DOCUMENT, "digest", "c", "d").agg(F.count("*").alias("copies"))
    firsts = seen.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("first"))
    facts = word_facts(documents).select(*[F.col(c).alias(f"of_{c}") for c in DOCUMENT], "words", "distinct")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("key") == F.col("of_key")) & (F.col("part") == F.col("of_part"))
    joined = flags.join(facts, same, "left").join(firsts, ["doc_id", "digest"], "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct", F.lit(0))
    failed = {
        "A": words < MIN_WORDS, "B": 100 * distinct < MIN_DISTINCT * words, "C": F.col("c"), "D": F.col("d"),
        "E": F.col("first").isNull() & F.col("doc_id").isNotNull(),
    }
    mask = sum((F.when(failed[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    return joined.select(*DOCUMENT, "copies", mask.alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, docs, good, toxic``: for each part three arrays of 32 numbers, at place ``m`` the documents whose set of failed
    filters is ``m``."""
    known = labels.groupBy(F.col("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    rows = failed.join(known, "doc_id", "left").select("part", "copies", "mask", "is_good", "is_toxic")
    counted = {"docs": F.lit(True), "good": F.coalesce("is_good", F.lit(False)), "toxic": F.coalesce("is_toxic", F.lit(False))}
    sums = [F.sum(F.when((F.col("mask") == m) & counted[name], F.col("copies")).otherwise(0)).alias(f"{name}_{m}") for name in MEASURES for m in range(MASKS)]
    per_part = rows.groupBy("part").agg(*sums)
    return per_part.select("part", *[F.array(*[F.col(f"{name}_{m}") for m in range(MASKS)]).alias(name) for name in MEASURES])


def _sum(name: str, wanted: str) -> Column:
    """Sum of an array of counts over the masks ``m`` for which ``wanted`` holds."""
    return F.expr(f"aggregate(filter(sequence(0, {MASKS - 1}), m -> {wanted}), 0L, (total, m) -> total + {name}[m])")


def orders(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    every = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    bit = f"shiftleft(1, instr('{FILTERS}', {{}}) - 1)"
    steps = counts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    placed = steps.select(
        "*", F.expr("substr(filter_order, step, 1)").alias("letter"), F.expr(bit.format("substr(filter_order, step, 1)")).alias("bit"),
        F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (mask, i) -> mask + if(i < step, {bit.format('substr(filter_order, i, 1)')}, 0))").alias("before"),
    )
    here = "m & bit > 0 AND m & before = 0"
    measured = placed.select(
        "part", "filter_order", "step", "letter", _sum("docs", "m & (bit | before) = 0").alias("kept"), _sum("docs", here).alias("removed"),
        _sum("docs", "m & bit > 0 AND m & before > 0").alias("redundant"), F.expr("docs[bit]").alias("unique_fails"),
        _sum("good", here).alias("good_lost"), _sum("toxic", here).alias("toxic_lost"),
    )
    # A window of 120 rows for each letter of a part: a join would count the documents a second time.
    return measured.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    return orders(mask_counts(failures(docs, id_col=id_col, text_col=text_col, part_col=part_col), labels))


def oracle() -> str:
    blanks = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{blanks}') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  len(words) < {MIN_WORDS} AS a, 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(text) AS c, regexp_matches(text, '{SYMBOLS}') AS d, coalesce(first_id < doc_id, false) AS e
  FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, good, toxic, [x.k FOR x IN [{{'k': 'A', 'v': a}}, {{'k': 'B', 'v': b}}, {{'k': 'C', 'v': c}}, {{'k': 'D', 'v': d}}, {{'k': 'E', 'v': e}}] IF x.v] AS fails FROM f),
h AS (SELECT part, fails, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM g GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT v.x || w.x || x.x || y.x || z.x AS filter_order FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5),
s AS (SELECT filter_order, i AS step, filter_order[i] AS letter, string_split(filter_order[1:i - 1], '') AS before FROM o, unnest([1, 2, 3, 4, 5]) AS t(i)),
r AS (SELECT part, filter_order, step, letter,
  sum(docs) FILTER (NOT list_has_any(fails, before) AND NOT list_contains(fails, letter)) AS kept,
  sum(docs) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, letter)) AS removed,
  sum(docs) FILTER (list_has_any(fails, before) AND list_contains(fails, letter)) AS redundant,
  sum(docs) FILTER (fails = [letter]) AS unique_fails,
  sum(good) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, letter)) AS good_lost,
  sum(toxic) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, letter)) AS toxic_lost
  FROM h, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley FROM r"""
