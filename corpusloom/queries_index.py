"""Further registered queries: an index through its life, hybrid search, candidates, the gate.  Importing it completes the
catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import queries_sections, queries_tables  # noqa: F401  complete the catalogue, too
from .functions import embed, identity, text
from .operators import chunking, dense, evaluation, ingest, pruned, ranking
from .plans import engine
from .plans.store import IndexStore
from .queries import (
    CHUNK_CITED_SQL, CHUNK_ID_SQL, EMBED_DIM, EMBED_SQL, FUSED_SQL, LANES_SQL, LEXICAL_CTES, REL, _corpus, _fused, _lexical, _markdown, _outcomes, _questions, _ranked_sql, _table, _vector_queries, chunks_sql, query,
)
from .queries_text import ORACLES, QUERIES
from .staging import shared_dir

__all__ = ["ORACLES", "QUERIES"]

# ------------------------------------------------------------------ an index through its life


@query(f"WITH RECURSIVE {chunks_sql()} SELECT {CHUNK_ID_SQL} AS chunk_id FROM chunked WHERE CAST(regexp_extract(rel, '[0-9]+') AS BIGINT) % 5 = 0")
def w02_dropped_chunks(spark, sf_dir):
    """The chunks that go with every fifth conversation."""
    chunks, number = chunking.chunks(_markdown(spark, sf_dir)), F.regexp_extract("rel", "[0-9]+", 0).cast("long")
    gone = _markdown(spark, sf_dir).where(number % 5 == 0).select("doc_id")
    return ingest.drop_documents(chunks, gone)[1]


TOKENS_SQL = r"len(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))"
SHOUTED_SQL = "CASE WHEN conv_id % 7 = 0 THEN translate(text, 'aeiou', 'AEIOU') ELSE text END"


@query(f"""WITH RECURSIVE {chunks_sql(SHOUTED_SQL, "conv_id % 5 != 0")} SELECT {CHUNK_ID_SQL} AS chunk_id, {CHUNK_CITED_SQL} AS citation, md5(piece) AS text_md5,
    {TOKENS_SQL.format("piece")} + {TOKENS_SQL.format("concat('Talk / ', title)")} AS n_tokens, TRUE AS has_vector FROM chunked""")
def s06_updated_index(spark, sf_dir):
    """The tables of an index of all conversations, after a second run in which every fifth is gone and every seventh is
    changed: chunks, their lengths, and whether each has a vector."""
    store, embedder = IndexStore(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"), embed.HashingEmbedder(64)
    number = F.regexp_extract("rel", "[0-9]+", 0).cast("long")
    documents = lambda rows: rows.select("doc_id", "rel", "trust", "text", identity.content_hash(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("size"))
    first = _markdown(spark, sf_dir)
    shouted = F.array_join(F.transform(F.split("text", "\n"), lambda line: F.when(F.startswith(line, F.lit("#")), line).otherwise(F.translate(line, "aeiou", "AEIOU"))), "\n")
    second = first.where(number % 5 != 0).withColumn("text", F.when(number % 7 == 0, shouted).otherwise(F.col("text")))
    engine.build(spark, store, documents(first), embedder)
    engine.build(spark, store, documents(second), embedder)
    kept = store.current()
    vectors = kept.table("vectors").groupBy("chunk_id").agg((F.count("*") == 1).alias("has_vector"))
    rows = kept.table("chunks").join(kept.table("lengths"), "chunk_id", "left").join(vectors, "chunk_id", "left")
    return rows.select("chunk_id", "citation", F.md5("text").alias("text_md5"), F.col("n").cast("long").alias("n_tokens"), F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


@query(ORACLES["k01_bm25_topk"])
def k01_bm25_pruned(spark, sf_dir):
    """The same ranking from clustered postings, of which a search reads what can matter."""
    corpus = _corpus(spark, sf_dir)
    index = pruned.write_clustered(ranking.build_index(corpus, staged=True), f"{shared_dir(spark)}/clustered-{uuid.uuid4().hex}")
    rows = pruned.pruned_search(index, _questions(spark, sf_dir), 10, weights=(1.0, 1.0))
    return rows.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(ORACLES["k02_cosine_topk"])
def k02_cosine_blocks(spark, sf_dir):
    """The same ranking from blocks around pivots, of which a query multiplies with those that can hold as good a vector."""
    rows, asked = _vector_queries(spark, sf_dir)
    index = dense.write_blocks(rows, f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}")
    return dense.block_search(index, asked, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


# ------------------------------------------------------------------ hybrid search

QUERY_EMBED_SQL = EMBED_SQL.replace("doc_id AS id", "item_id AS id").replace("FROM documents", "FROM benchmark").replace("tok AS", "qtok AS").replace("FROM tok", "FROM qtok").replace("h AS", "qh AS").replace("FROM h ", "FROM qh ").replace("s AS (", "qs AS (")
HYBRID_SQL = f"""{LEXICAL_CTES}, {_ranked_sql(50)}, {EMBED_SQL}, {QUERY_EMBED_SQL},
dw AS (SELECT id, bucket, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS w FROM s),
qw AS (SELECT id, bucket, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS w FROM qs),
dn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1), qn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
dots AS (SELECT qw.id AS query_id, dw.id AS chunk_id, sum(qw.w * dw.w) AS dot FROM qw JOIN dw USING (bucket) GROUP BY 1, 2),
cosines AS (SELECT qn.id AS query_id, dn.id AS chunk_id, coalesce(dot, 0) / (qn.norm * dn.norm) AS score FROM qn CROSS JOIN dn LEFT JOIN dots ON query_id = qn.id AND chunk_id = dn.id),
dense AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INT) AS rank FROM cosines QUALIFY rank <= 50),
both_ AS (SELECT query_id, chunk_id, rank, 'lexical' AS retriever FROM ranked UNION ALL SELECT query_id, chunk_id, rank, 'dense' FROM dense),
fused AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, string_agg(retriever, ',' ORDER BY retriever) AS retrievers, count(*) AS n FROM both_ GROUP BY 1, 2),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, n DESC, chunk_id) AS INT) AS fused_rank FROM fused)"""


@query(f"""WITH {HYBRID_SQL} SELECT query_id, chunk_id, {REL} AS citation, round(score, 6) AS score, retrievers, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS INT) AS rank
    FROM placed JOIN documents ON doc_id = chunk_id WHERE fused_rank <= 16 QUALIFY rank <= 8""")
def q03_hybrid_md5(spark, sf_dir):
    """Lexical and dense lanes of 50 each, fused, the best eight hydrated; vectors by MD5 instead of BLAKE2b."""
    corpus, asked = _corpus(spark, sf_dir), _questions(spark, sf_dir)
    embedder = embed.HashingEmbedder(EMBED_DIM, "md5")
    rows = embedder.encode(corpus, "chunk_id", "text").withColumnRenamed("id", "chunk_id")
    encoded = embedder.encode(asked, "query_id", "question").withColumnRenamed("id", "query_id")
    near = dense.dense_search(rows, encoded, 50).withColumn("retriever", F.lit("dense"))
    lanes = _lexical(spark, sf_dir, 50).withColumn("retriever", F.lit("lexical")).unionByName(near)
    hits = ranking.hydrate(ranking.fuse(lanes.select("query_id", "chunk_id", "rank", "retriever")), corpus, 8)
    return hits.select("query_id", "chunk_id", "citation", F.round("score", 6).alias("score"), F.array_join("retrievers", ",").alias("retrievers"), "rank")


@query(f"WITH {LEXICAL_CTES}, {_ranked_sql(50)} SELECT query_id, count(*) AS candidates, max(rank) AS last_rank FROM ranked GROUP BY 1")
def k06_candidate_cap(spark, sf_dir):
    """How many candidates the lexical lane hands to fusion: 50 at most."""
    return _lexical(spark, sf_dir, 50).groupBy("query_id").agg(F.count("*").alias("candidates"), F.max("rank").alias("last_rank"))


@query(f"""WITH {FUSED_SQL} SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS INT) AS rank
    FROM placed JOIN documents ON doc_id = chunk_id WHERE fused_rank <= 16 AND doc_id % 3 != 0 QUALIFY rank <= 8""")
def f15_stale_ids(spark, sf_dir):
    """Ids whose chunk is gone use up their place among the candidates and are left out."""
    hits = ranking.hydrate(_fused(spark, sf_dir), _corpus(spark, sf_dir).where("chunk_id % 3 != 0"), 8)
    return hits.select("query_id", "chunk_id", "rank")


# ------------------------------------------------------------------ evaluation and stored forms


@query(f"""WITH {LANES_SQL}, best AS (SELECT * FROM summary ORDER BY ndcg DESC, retriever LIMIT 1),
    floors AS (SELECT retriever, 'ndcg' AS metric, ndcg AS value, 0.9 AS floor FROM best UNION ALL SELECT retriever, 'hit', hit, 0.0 FROM best UNION ALL SELECT retriever, 'mrr', mrr, 0.95 FROM best)
    SELECT retriever, metric, round(value, 6) AS value, CAST(floor AS DOUBLE) AS floor FROM floors WHERE value < floor""")
def q13_gate_failures(spark, sf_dir):
    """The floors that the best retriever misses."""
    failed = evaluation.gate_failures(evaluation.summary(_outcomes(spark, sf_dir), 10), min_ndcg=0.9, min_mrr=0.95)
    return failed.select("retriever", "metric", F.round("value", 6).alias("value"), "floor")


@query("""SELECT vec_id, CASE WHEN label % 3 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN label % 3 = 0 THEN concat('Part ', CAST(label AS VARCHAR), ' > a "b"') ELSE '' END AS path FROM embeddings""")
def t25_heading_path(spark, sf_dir):
    """Heading paths kept as JSON: a list, a broken list, something else."""
    written = F.when(F.col("label") % 3 == 0, F.concat(F.lit('["Part '), F.col("label").cast("string"), F.lit('", "a \\"b\\""]'))).when(F.col("label") % 3 == 1, F.lit('["Part')).otherwise(F.lit('{"a": 1}'))
    path = text.heading_path(written)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.size(path).alias("n"), F.array_join(path, " > ").alias("path"))
