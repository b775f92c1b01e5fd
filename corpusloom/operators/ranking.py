"""Batched retrieval: BM25 over postings, reciprocal-rank fusion, trust order.

Everything works on a frame of queries; one query is a batch of one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stem as stemming
from ..functions.text import index_tokens, query_words
from ..staging import split_repeated, stage

# Provenance tiers from most to least trusted; what an unknown tier counts as.
TIERS = ("authored", "curated", "upstream", "untrusted", "unknown")
RRF_K = 60
IDF_FLOOR = 1e-6
SENT_TERMS = 1 << 18  # pairs of query and term that are sent to the texts; more of them meet postings in a join
SCORE_CELLS = 1 << 20  # scores that a task holds at a time
ROWS_AT_ONCE, KNOWN_TERMS = 1024, 1 << 17  # chunks that a task counts at a time; terms whose stems it remembers
CLOSE = 2e-9  # what rounding to nine digits may hide


def tier_rank(tier: Column) -> Column:
    """Place in TIERS; anything else ranks after them."""
    place = F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)
    return F.when(F.coalesce(place, F.lit(0)) > 0, (place - 1).cast("int")).otherwise(F.lit(len(TIERS)))


@dataclass(frozen=True)
class LexicalIndex:
    """Tables of an inverted index over two fields.

    ``postings``: chunk_id, term, tf_text, tf_head, pos_text, pos_head; ``lengths``: chunk_id, n; ``terms``: term, n_docs,
    idf; ``corpus``: one row with chunks and avg_len.
    """

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame
    stemmed: bool = False
    counted: DataFrame | None = None  # the postings with their chunk's length, n, from a build


def _idf(total: Column, having: Column) -> Column:
    return F.greatest(F.log((total - having + 0.5) / (having + 0.5)), F.lit(IDF_FLOOR))


def token_rows(chunks: DataFrame, id_col: str, text_col: str, headings_col: str | None) -> DataFrame:
    """``chunk_id, field, pos, term``: one row per token."""
    text = chunks.select(F.col(id_col).alias("chunk_id"), F.lit("text").alias("field"), F.posexplode(index_tokens(F.col(text_col))).alias("pos", "term"))
    if headings_col is None:
        return text
    head = chunks.select(F.col(id_col).alias("chunk_id"), F.lit("head").alias("field"), F.posexplode(index_tokens(F.col(headings_col))).alias("pos", "term"))
    return text.unionByName(head)


def _token_lists(chunks: DataFrame, id_col: str, text_col: str, headings_col: str | None) -> DataFrame:
    head = index_tokens(F.col(headings_col)) if headings_col else F.array().cast("array<string>")
    return chunks.select(F.col(id_col).alias("chunk_id"), index_tokens(F.col(text_col)).alias("text"), head.alias("head"))


def _postings_by_shuffle(chunks: DataFrame, id_col: str, text_col: str, headings_col: str | None, *, stem: bool = False, positions: bool = False) -> DataFrame:
    """Postings in one aggregation of the tokens, whichever rows a chunk's tokens are in; with ``stem``, the distinct terms go through Python."""
    tokens = token_rows(chunks, id_col, text_col, headings_col)
    # Sorted, since the order in which rows are collected differs from run to run.
    places = lambda field: F.array_sort(F.collect_list(F.when(F.col("field") == field, F.col("pos"))))
    count = lambda field: F.count_if(F.col("field") == field)
    extra = [places("text").alias("pos_text"), places("head").alias("pos_head")] if positions else []
    postings = tokens.groupBy("chunk_id", "term").agg(count("text").alias("tf_text"), count("head").alias("tf_head"), *extra)
    if not stem:
        return postings
    merged = [F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("pos_text", "pos_head")] if positions else []
    named = postings.join(stemming.normalised_vocabulary(postings), "term").groupBy("chunk_id", F.col("norm").alias("term"))
    return named.agg(F.sum("tf_text").alias("tf_text"), F.sum("tf_head").alias("tf_head"), *merged)


def _counted(chunks: DataFrame, id_col: str, text_col: str, headings_col: str | None, stem: bool, positions: bool) -> DataFrame:
    """Postings with ``n``, the chunk's length, and ``first``, true in one row a chunk, which has no term if the chunk has none.
    A chunk's tokens lie in one row, so they are counted there; only chunks whose id repeats, which are one, are shuffled."""
    alone, repeated = split_repeated(chunks, id_col)
    tokens = _token_lists(alone, id_col, text_col, headings_col)
    kind = tokens.schema["chunk_id"].dataType.simpleString()
    schema = f"chunk_id {kind}, term string, tf_text long, tf_head long, {'pos_text array<int>, pos_head array<int>, ' if positions else ''}n long, first boolean"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for part in (batch.slice(at, ROWS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, ROWS_AT_ONCE)):
            rows, columns = part.num_rows, (part.column(1), part.column(2))
            sizes = [pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
            words = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
            code, words = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
            if stem:
                if len(known) > KNOWN_TERMS:
                    known.clear()
                normal = pa.array(stemming.normalised(words.to_pylist(), known), pa.string()).dictionary_encode()
                code, words = normal.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code] if len(code) else code, normal.dictionary
            row = np.concatenate([np.repeat(np.arange(rows), s) for s in sizes])
            pos = np.concatenate([np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) for s in sizes])
            head = np.repeat([0, 1], [s.sum() for s in sizes])
            order = np.argsort(((row * len(words) + code) * 2) + head, kind="stable")  # places within a field stay in order
            key, head = (row * len(words) + code)[order], head[order]
            found, begin = np.unique(key, return_index=True)
            tf_head = np.bincount(np.repeat(np.arange(len(found)), np.diff([*begin, len(key)])), head, len(found)).astype(np.int64)
            tf_text = np.diff([*begin, len(key)]) - tf_head
            of, n = found // max(1, len(words)), sum(sizes)
            bare = np.nonzero(n == 0)[0]  # chunks without a token
            at = np.concatenate([of, bare])
            lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts), np.full(len(bare), counts.sum())]).astype(np.int32)), pa.array(values.astype(np.int32)))  # noqa: E731, B023
            places = [lists(tf_text, pos[order][head == 0]), lists(tf_head, pos[order][head == 1])] if positions else []
            term = pa.concat_arrays([words.take(pa.array(found % max(1, len(words)))), pa.nulls(len(bare), pa.string())])
            fill = lambda x: pa.array(np.concatenate([x, np.zeros(len(bare), np.int64)]))  # noqa: E731, B023
            first = np.concatenate([np.diff(of, prepend=-1) > 0, np.ones(len(bare), bool)])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), term, fill(tf_text), fill(tf_head), *places, pa.array(n[at]), pa.array(first)], names=[f.split()[0] for f in schema.split(", ")])

    counted = tokens.mapInArrow(count, schema)
    if repeated is None:
        return counted
    postings = _postings_by_shuffle(repeated, id_col, text_col, headings_col, stem=stem, positions=positions)
    # A row of its own tells the length here.
    lengths = _lengths(postings, repeated.select(F.col(id_col).alias("chunk_id"))).withColumn("first", F.lit(True))
    with_n = postings.join(lengths.select(F.col("chunk_id").alias("_id"), "n"), F.col("chunk_id").eqNullSafe(F.col("_id"))).drop("_id").withColumn("first", F.lit(False))
    return counted.unionByName(with_n).unionByName(lengths, allowMissingColumns=True)


def build_index(chunks: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text", headings_col: str | None = None, stem: bool = False, positions: bool = False, staged: bool = False) -> LexicalIndex:
    """Postings of each chunk where its text lies, without a shuffle.  ``staged`` writes the postings, so that all that is taken
    from them reads the texts once."""
    counted = _counted(chunks, id_col, text_col, headings_col, stem, positions)
    if staged:
        counted = stage(counted, "postings")
    postings = counted.where("term is not null").drop("first")
    index = _derived(postings.drop("n"), counted.where("first").select("chunk_id", "n"), stem)
    return replace(index, counted=postings)


def index_for(chunks: DataFrame, queries: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text", headings_col: str | None = None, query_text: str = "question") -> LexicalIndex:
    """An index of the terms that ``queries`` ask for, for a corpus that has none: the texts are read once, and a chunk's
    other tokens are one row before the shuffle, which counts towards its length alone."""
    asked = stage(query_items(queries, text_col=query_text).select("term", F.lit(True).alias("asked")).distinct(), "asked-terms")
    named = lambda field, column: F.transform(index_tokens(F.col(column)), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))
    empty = F.expr("cast(array() as array<struct<field:string,term:string>>)")
    fields = [("text", text_col), *([("head", headings_col)] if headings_col else [])]
    tokens = F.concat(*[F.coalesce(named(*f), empty) for f in fields])
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.explode_outer(tokens).alias("t")).select("chunk_id", "t.field", "t.term").join(asked, "term", "left")
    count = lambda field: F.count_if(F.col("field") == field)
    by_term = rows.groupBy("chunk_id", F.when(F.col("asked"), F.col("term")).alias("term")).agg(count("text").alias("tf_text"), count("head").alias("tf_head"))
    counts = stage(by_term, "term-counts")
    lengths = counts.groupBy("chunk_id").agg(F.sum(F.col("tf_text") + F.col("tf_head")).alias("n"))
    return _derived(counts.where("term is not null"), lengths, False)


def _lengths(postings: DataFrame, ids: DataFrame) -> DataFrame:
    sums = postings.groupBy("chunk_id").agg(F.sum(F.col("tf_text") + F.col("tf_head")).alias("n"))
    return ids.distinct().join(sums, "chunk_id", "left").select("chunk_id", F.coalesce("n", F.lit(0)).alias("n"))


def _derived(postings: DataFrame, lengths: DataFrame, stemmed: bool) -> LexicalIndex:
    corpus = corpus_row(lengths)
    return LexicalIndex(postings, lengths, with_idf(postings.groupBy("term").agg(F.count("*").alias("n_docs")), corpus), corpus, stemmed)


def corpus_row(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("chunks"), F.avg("n").alias("avg_len"))


def with_idf(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """``term, n_docs`` with the idf that the one row of ``corpus`` gives them."""
    return terms.crossJoin(F.broadcast(corpus)).select("term", "n_docs", _idf(F.col("chunks"), F.col("n_docs")).alias("idf"))


def changed_terms(terms: DataFrame, postings: DataFrame, dropped: DataFrame, fresh: DataFrame) -> DataFrame:
    """``term, n_docs`` after the chunks ``dropped`` left an index and the postings ``fresh`` came: of the postings of the
    index only those of dropped chunks are counted."""
    count = lambda rows, sign: rows.groupBy("term").agg((F.lit(sign) * F.count("*")).alias("n_docs"))
    less = count(postings.select("chunk_id", "term").join(dropped.select("chunk_id"), "chunk_id", "left_semi"), -1)
    parts = terms.select("term", "n_docs").unionByName(less).unionByName(count(fresh, 1))
    return parts.groupBy("term").agg(F.sum("n_docs").alias("n_docs")).where("n_docs > 0")


def query_items(queries: DataFrame, *, id_col: str = "query_id", text_col: str = "question", stem: bool = False) -> DataFrame:
    """``query_id, item, offset, term, tokens``: each kept word is an item, a phrase if it splits into several tokens."""
    kept = queries.select(F.col(id_col).alias("query_id"), F.posexplode(query_words(F.col(text_col))).alias("item", "word"))
    parts = kept.select("query_id", "item", index_tokens(F.col("word")).alias("parts"))
    rows = parts.select("query_id", "item", F.size("parts").alias("tokens"), F.posexplode("parts").alias("offset", "term"))
    if stem:
        vocabulary = stemming.normalised_vocabulary(rows)
        rows = rows.join(vocabulary, "term").select("query_id", "item", "tokens", "offset", F.col("norm").alias("term"))
    return rows


def _phrase_hits(items: DataFrame, index: LexicalIndex) -> DataFrame:
    """``query_id, item, chunk_id, tf_text, tf_head`` of phrases: tokens found at consecutive places of one field."""
    at = lambda field: F.transform(f"pos_{field}", lambda p: F.struct(F.lit(field).alias("field"), p.alias("pos")))
    places = items.join(index.postings, "term").select(
        "query_id", "item", "tokens", "offset", "chunk_id", F.explode(F.concat(at("text"), at("head"))).alias("p")
    )
    starts = places.groupBy("query_id", "item", "tokens", "chunk_id", "p.field", (F.col("p.pos") - F.col("offset")).alias("start")).agg(F.count("*").alias("n"))
    whole = starts.where("n = tokens")
    return whole.groupBy("query_id", "item", "chunk_id").agg(F.count_if(F.col("field") == "text").alias("tf_text"), F.count_if(F.col("field") == "head").alias("tf_head"))


def bm25_scores(
    index: LexicalIndex,
    queries: DataFrame,
    *,
    id_col: str = "query_id",
    text_col: str = "question",
    weights: tuple[float, float] = (0.5, 1.0),
    k1: float = 1.2,
    b: float = 0.75,
    phrases: bool = False,
) -> DataFrame:
    """``query_id, chunk_id, score`` of every match.  ``weights`` are of text and headings, applied before saturation.

    The query side is small, so the postings are read by a join on the terms asked for; repeated words count each.
    """
    items = query_items(queries, id_col=id_col, text_col=text_col, stem=index.stemmed)
    single = items.where("tokens = 1") if phrases else items
    asked = single.groupBy("query_id", "term").agg(F.count("*").alias("times")).join(index.terms.select("term", "idf"), "term")
    matched = asked.join(index.postings.select("term", "chunk_id", "tf_text", "tf_head"), "term")
    matched = matched.select("query_id", "chunk_id", "times", "idf", "tf_text", "tf_head")
    if phrases:
        found = _phrase_hits(items.where("tokens > 1"), index)
        having = found.groupBy("query_id", "item").agg(F.count("*").alias("n_docs"))
        phrase_idf = having.crossJoin(F.broadcast(index.corpus)).select("query_id", "item", _idf(F.col("chunks"), F.col("n_docs")).alias("idf"))
        matched = matched.unionByName(found.join(phrase_idf, ["query_id", "item"]).select("query_id", "chunk_id", F.lit(1).cast("long").alias("times"), "idf", "tf_text", "tf_head"))
    w_text, w_head = (float(w) for w in weights)
    tf = w_text * F.col("tf_text") + w_head * F.col("tf_head")
    norm = k1 * (1 - b + b * F.col("n") / F.col("avg_len"))
    scored = matched.join(index.lengths, "chunk_id").crossJoin(F.broadcast(index.corpus))
    part = F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + norm)
    return scored.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, *, digits: int = 9) -> DataFrame:
    """``query_id, chunk_id, score, rank``: best ``k`` by score (rounded, so that last bits don't decide), then id."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", digits).desc(), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_search(index: LexicalIndex, queries: DataFrame, k: int = 20, **options) -> DataFrame:
    return top_k(bm25_scores(index, queries, **options), k)


def _asked_counts(chunks: DataFrame, terms: pa.Array, id_col: str, text_col: str, headings_col: str | None) -> DataFrame:
    """``chunk_id, n, codes, tf_text, tf_head``: a row per chunk with its length and its counts of ``terms``, which codes number.
    Nothing is shuffled but chunks whose id repeats, which are one."""
    alone, repeated = split_repeated(chunks, id_col)
    tokens = _token_lists(alone, id_col, text_col, headings_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, total = [], np.zeros(batch.num_rows, np.int64)
            for column in (batch.column(1), batch.column(2)):
                total += pc.list_value_length(column).to_numpy(zero_copy_only=False)
                code = pc.fill_null(pc.index_in(column.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
                keys.append((pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64) * len(terms) + code)[code >= 0])
            found, place = np.unique(np.concatenate(keys), return_inverse=True)
            tf = [np.bincount(field, minlength=len(found)) for field in np.split(place, [len(keys[0])])]
            offsets = pa.array(np.searchsorted(found, np.arange(batch.num_rows + 1) * len(terms)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (found % max(1, len(terms)), *tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), *lists], names=["chunk_id", "n", "codes", "tf_text", "tf_head"])

    counted = tokens.mapInArrow(count, f"chunk_id {tokens.schema['chunk_id'].dataType.simpleString()}, n long, codes array<int>, tf_text array<int>, tf_head array<int>")
    if repeated is None:
        return counted
    postings = _postings_by_shuffle(repeated, id_col, text_col, headings_col)
    table = chunks.sparkSession.createDataFrame(list(zip(terms.to_pylist(), range(len(terms)), strict=True)), "term string, code int")
    parts = F.struct("code", F.col("tf_text").cast("int").alias("tf_text"), F.col("tf_head").cast("int").alias("tf_head"))
    lists = postings.join(F.broadcast(table), "term").groupBy(F.col("chunk_id").alias("_id")).agg(F.collect_list(parts).alias("p"))
    lengths = _lengths(postings, repeated.select(F.col(id_col).alias("chunk_id")))
    merged = lengths.join(lists, lengths["chunk_id"].eqNullSafe(lists["_id"]), "left")
    part = lambda c: F.coalesce(F.col(f"p.{c}"), F.array().cast("array<int>"))
    return counted.unionByName(merged.select("chunk_id", F.col("n").cast("long").alias("n"), part("code").alias("codes"), part("tf_text").alias("tf_text"), part("tf_head").alias("tf_head")))


def search_texts(
    chunks: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "chunk_id", text_col: str = "text", headings_col: str | None = None, query_text: str = "question",
    weights: tuple[float, float] = (0.5, 1.0), k1: float = 1.2, b: float = 0.75,
) -> DataFrame:
    """``query_id, chunk_id, score, rank`` as ``lexical_search`` over ``index_for`` gives them, for a corpus without an index.

    The texts are read once, for each chunk's counts of the terms asked for.  Those counts are not shuffled: queries go to where
    they lie, and of each task's scores only those leave it that can be among a query's ``k`` best.
    """
    asked = stage(query_items(queries, text_col=query_text).groupBy("query_id", "term").agg(F.count("*").alias("times")), "asked")
    many = asked.agg(F.count("*").alias("pairs"), F.count_distinct("query_id").alias("queries")).first()
    if k < 1 or many["pairs"] > SENT_TERMS or many["queries"] * k > SCORE_CELLS:
        index = index_for(chunks, queries, id_col=id_col, text_col=text_col, headings_col=headings_col, query_text=query_text)
        return lexical_search(index, queries, k, weights=weights, k1=k1, b=b)
    if not many["pairs"]:
        return chunks.sparkSession.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema[id_col].dataType.simpleString()}, score double, rank int")
    pairs = asked.toArrow().combine_chunks()  # at most SENT_TERMS rows
    coded = [pairs[c].combine_chunks().dictionary_encode("encode") for c in ("query_id", "term")]
    (names, query), (terms, code) = [(c.dictionary, c.indices.to_numpy(zero_copy_only=False).astype(np.int64)) for c in coded]
    counted = stage(_asked_counts(chunks, terms, id_col, text_col, headings_col), "asked-counts")
    corpus = corpus_row(counted).first()
    having = counted.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n_docs"))
    idf = np.zeros(len(terms))
    for row in having.select("code", _idf(F.lit(corpus["chunks"]), F.col("n_docs")).alias("idf")).collect():  # as many rows as terms asked for
        idf[row["code"]] = row["idf"]
    # By term: the queries that have it, and what it weighs there.
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(terms) + 1))
    query, weight = query[order], (pairs["times"].to_numpy() * idf[code])[order]
    average, (w_text, w_head) = float(corpus["avg_len"] or 0), (float(w) for w in weights)
    step = max(1, SCORE_CELLS // max(1, len(names)))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {counted.schema['chunk_id'].dataType.simpleString()}, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(len(names), -np.inf)
        for part in (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step)):
            row, length = pc.list_parent_indices(part.column(2)).to_numpy(zero_copy_only=False), part.column(1).to_numpy()
            term, text, head = (part.column(n).flatten().to_numpy() for n in (2, 3, 4))
            tf = w_text * text + w_head * head
            value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / average))
            # Each count meets all queries that have its term.
            times = starts[term + 1] - starts[term]
            pair = np.repeat(starts[term] - np.cumsum(times) + times, times) + np.arange(times.sum())
            cell, cells = query[pair] * part.num_rows + np.repeat(row, times), len(names) * part.num_rows
            scores = np.bincount(cell, weight[pair] * np.repeat(value, times), cells).astype(float)
            scores[np.bincount(cell, minlength=cells) == 0] = -np.inf  # a match may be worth nothing
            scores = scores.reshape(len(names), part.num_rows)
            if part.num_rows >= k:
                floor = np.maximum(floor, np.partition(scores, part.num_rows - k, axis=1)[:, part.num_rows - k] - CLOSE)
            i, j = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
            if len(i):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), part.column(0).take(pa.array(j)), pa.array(scores[i, j])], names=["query_id", "chunk_id", "score"])

    # A few rows a query: written, so that what joins them knows how few.
    return stage(top_k(counted.where("chunk_id is not null").mapInArrow(score, schema), k), "found")


def fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ``query_id, retriever, chunk_id, rank``: score, retrievers (sorted), ranks, fused_rank."""
    rows = rankings.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        F.array_sort(F.collect_list("retriever")).alias("retrievers"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("retriever", "rank")))).alias("ranks"),
    )
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.size("retrievers").desc(), "chunk_id")
    return rows.withColumn("fused_rank", F.row_number().over(order))


def hydrate(fused: DataFrame, chunks: DataFrame, k: int, *, prefer_trust: bool = False) -> DataFrame:
    """The best ``2k`` of each query joined to their chunks (ids without a chunk use up their place), the final ``k`` in
    order; ``prefer_trust`` lets the more trusted of equal scores go first."""
    head = fused.where(F.col("fused_rank") <= 2 * k).join(chunks, "chunk_id")
    keys = [F.round("score", 12).desc()]
    if prefer_trust:
        keys.append(tier_rank(F.col("trust")))
    order = Window.partitionBy("query_id").orderBy(*keys, "fused_rank")
    return head.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
