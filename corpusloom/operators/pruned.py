"""BM25 top-k that leaves alone the postings that cannot matter.

Postings are written by part (a hash of the term) and sorted by term and block, so a search reads the folders of the parts
that it asks for.  A block is the postings of one term in chunks of one class of length; its row in ``blocks`` says how
many there are, their greatest counts and their least length.  Saturation grows with the count and falls with the length, so these
bound each posting's share of a score whatever the average length has become since.

A search has three rounds.  The blocks of highest bound, which are those of rare words, give a first threshold: the k-th best
of what chunks have collected so far can only rise.  Terms whose bounds together stay below it cannot bring a chunk into
the result by themselves; the postings of all others are summed up.  Of the chunks found, those that could still
reach the threshold with all that the left-out terms may add are the candidates, and only theirs are looked up
among the postings of the left-out terms, which are the long ones.  Nothing is estimated: the result is that of scoring
every posting.

Edge cases: a query with fewer matches than ``k`` has no threshold, so all its postings count.  Queries without a word, or with
words that no chunk has, have no rows; repeated words count each; null texts have no words; ties are settled by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import stage
from . import ranking
from .ranking import LexicalIndex, query_items, top_k

PARTS = 64
FEW_TERMS = 10
SENT_BOUNDS = 1 << 18  # rows of bounds that are sent to the postings; more of them meet in a shuffle
SLACK = 1e-7  # more than rounding can take from a bound
POSTING = ["part", "term", "block"]


@dataclass(frozen=True)
class ClusteredIndex:
    """``postings``: part, term, block, chunk_id, tf_text, tf_head, n; ``blocks``: part, term, block, rows, max_text,
    max_head, min_n; ``terms`` and ``corpus`` as a LexicalIndex has them."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame
    parts: int = PARTS
    stemmed: bool = False


def term_part(term: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def length_class(n: Column) -> Column:
    """Half octaves of a chunk's length: some forty classes for lengths up to a million."""
    return F.floor(2 * F.log2(n + 1)).cast("int")


def write_clustered(index: LexicalIndex, path: str, *, parts: int = PARTS) -> ClusteredIndex:
    """Writes ``index`` clustered under ``path``.  A part that one common term fills is split over several tasks."""
    spark = index.postings.sparkSession
    kind = index.postings.schema["chunk_id"].dataType.simpleString()
    counted = index.counted if index.counted is not None else index.postings.join(index.lengths, "chunk_id")
    rows = counted.where("chunk_id is not null").select(term_part(F.col("term"), parts).alias("part"), "term", length_class(F.col("n")).alias("block"), "chunk_id", "tf_text", "tf_head", F.col("n").cast("long").alias("n"))
    by_part = lambda df, name: df.hint("rebalance", "part").sortWithinPartitions(*[c for c in (*POSTING, "chunk_id") if c in df.columns]).write.partitionBy("part").parquet(f"{path}/{name}")
    by_part(rows, "postings")
    facts = [F.count("*").alias("rows"), F.max("tf_text").alias("max_text"), F.max("tf_head").alias("max_head"), F.min("n").alias("min_n")]
    by_part(spark.read.schema(rows.schema).parquet(f"{path}/postings").groupBy(*POSTING).agg(*facts), "blocks")
    if index.counted is not None:  # the blocks, which are far fewer than the postings, know in how many chunks a term is
        n_docs = spark.read.schema("term string, rows bigint").parquet(f"{path}/blocks").groupBy("term").agg(F.sum("rows").alias("n_docs"))
        ranking.with_idf(n_docs, index.corpus).write.parquet(f"{path}/terms")
    else:
        index.terms.write.parquet(f"{path}/terms")
    index.corpus.write.parquet(f"{path}/corpus")
    return read_clustered(spark, path, id_type=kind, parts=parts, stemmed=index.stemmed)


def read_clustered(spark: SparkSession, path: str, *, id_type: str = "string", parts: int = PARTS, stemmed: bool = False) -> ClusteredIndex:
    """The index under ``path``, whose chunk ids are of ``id_type``."""
    kinds = {
        "postings": f"term string, block int, chunk_id {id_type}, tf_text bigint, tf_head bigint, n bigint, part int",
        "blocks": "term string, block int, rows bigint, max_text bigint, max_head bigint, min_n bigint, part int",
        "terms": "term string, n_docs bigint, idf double", "corpus": "chunks bigint, avg_len double",
    }
    return ClusteredIndex(*[spark.read.schema(kind).parquet(f"{path}/{name}") for name, kind in kinds.items()], parts=parts, stemmed=stemmed)


@dataclass(frozen=True)
class Rounds:
    """What a search decided: ``bounds`` (query_id, part, term, block, weight, rows, bound, first, below), the ``scores`` after the
    second round (query_id, chunk_id, block, score), the ``candidates`` among them, and the ``shares`` of the third."""

    bounds: DataFrame
    scores: DataFrame
    candidates: DataFrame
    shares: DataFrame


def _saturated(text: Column, head: Column, n: Column, average: Column, weights: tuple[float, float], k1: float, b: float) -> Column:
    tf = float(weights[0]) * text + float(weights[1]) * head
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / average))


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """``query_id, least``: the k-th best score of the queries that have as many."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("many")).where(F.col("many") == k).drop("many")


def _wanted(asked: DataFrame) -> Column:
    """What a reader can skip by: the parts asked for (at most as many numbers as there are parts) choose folders, and up to
    ``FEW_TERMS`` terms choose row groups, since files are sorted by term; Parquet takes longer lists as their span."""
    parts = [r[0] for r in asked.select("part").distinct().collect()]
    terms = [r[0] for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    chosen = F.col("part").isin(parts)
    return chosen if len(terms) > FEW_TERMS else chosen & F.col("term").isin(terms)


def rounds(index: ClusteredIndex, queries: DataFrame, k: int, *, id_col: str = "query_id", text_col: str = "question", weights: tuple[float, float] = (0.5, 1.0), k1: float = 1.2, b: float = 0.75, seed_rows: int | None = None) -> Rounds:
    """The three rounds of a search; ``seed_rows`` postings of each query, or the block that passes that number, make the
    first threshold."""
    seed_rows = seed_rows if seed_rows is not None else 20 * k
    items = query_items(queries, id_col=id_col, text_col=text_col, stem=index.stemmed)
    asked = items.groupBy("query_id", "term").agg(F.count("*").alias("times")).join(index.terms.select("term", "idf"), "term")
    asked = stage(asked.select("query_id", term_part(F.col("term"), index.parts).alias("part"), "term", (F.col("times") * F.col("idf")).alias("weight")), "asked")
    wanted = _wanted(asked)
    average = F.col("avg_len")
    blocks = index.blocks.where(wanted).crossJoin(F.broadcast(index.corpus.select("avg_len")))
    bounded = asked.join(blocks, ["part", "term"]).withColumn("bound", F.col("weight") * _saturated(F.col("max_text"), F.col("max_head"), F.col("min_n"), average, weights, k1, b))
    # Of a query's blocks: the postings in those of higher bound, and the bounds of lesser terms in the same class together.
    higher = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term", "block").rowsBetween(Window.unboundedPreceding, -1)
    lesser = Window.partitionBy("query_id", "block").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = bounded.withColumn("first", F.coalesce(F.sum("rows").over(higher), F.lit(0)) < seed_rows).withColumn("below", F.sum("bound").over(lesser))
    bounds = stage(bounds.select("query_id", *POSTING, "weight", "rows", "bound", "first", "below"), "bounds")
    postings = index.postings.where(wanted).crossJoin(F.broadcast(index.corpus.select("avg_len")))
    share = F.col("weight") * _saturated(F.col("tf_text"), F.col("tf_head"), F.col("n"), average, weights, k1, b)
    sent = F.broadcast if bounds.count() <= SENT_BOUNDS else lambda some: some
    summed = lambda some: postings.join(sent(some), POSTING).groupBy("query_id", "chunk_id", "block").agg(F.sum(share).alias("score"))
    columns = ["query_id", *POSTING, "weight"]

    first = stage(_kth(summed(bounds.where("first").select(columns)), k), "threshold")
    split = bounds.join(first, "query_id", "left")
    matters = F.col("least").isNull() | (F.col("below") >= F.col("least") - SLACK)
    scores = stage(summed(split.where(matters).select(columns)), "scores")
    later = split.where(~matters)
    rest = later.groupBy("query_id", "block").agg(F.sum("bound").alias("rest"))
    reach = scores.join(rest, ["query_id", "block"], "left").join(_kth(scores, k), "query_id", "left")
    candidates = stage(reach.where(F.col("least").isNull() | (F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("least") - SLACK)).select("query_id", "chunk_id", "block", "score"), "candidates")
    sought = candidates.select("query_id", "chunk_id", "block").join(later.select(columns), ["query_id", "block"])
    # Only the postings of left-out terms meet what is sought among them.
    long = postings.join(sent(later.select(POSTING).distinct()), POSTING, "left_semi")
    shares = sought.join(long, [*POSTING, "chunk_id"]).select("query_id", "chunk_id", share.alias("score"))
    return Rounds(bounds, scores, candidates, shares)


def pruned_search(index: ClusteredIndex, queries: DataFrame, k: int = 20, **options) -> DataFrame:
    """``query_id, chunk_id, score, rank`` as ``lexical_search`` gives them, without phrases."""
    found = rounds(index, queries, k, **options)
    total = found.candidates.select("query_id", "chunk_id", "score").unionByName(found.shares).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))
    return top_k(total, k)
