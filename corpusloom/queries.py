"""Registered queries of the retrieval engine over the driver's tables, with DuckDB SQL where SQL can say the same.

Roles: documents (or conversations, pages) are the corpus, benchmark the questions, embeddings the vectors.  A
document's path is ``source/doc_id.md`` and its root the source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import embed, identity, text
from .operators import answering, chunking, evaluation, ingest, ranking, vectors
from .operators.dense import dense_search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ corpus roles

REL = "concat(source, '/', CAST(doc_id AS VARCHAR), '.md')"
#: Trust rules in order; the SQL twin follows.
TRUST_RULES = (("src0/*", "authored"), ("src1*/*", "curated"), ("src2", "upstream"), ("*7.md", "untrusted"))
TRUST_SQL = (
    f"CASE WHEN starts_with({REL}, 'src0/') THEN 'authored' WHEN starts_with({REL}, 'src1') THEN 'curated' "
    f"WHEN source = 'src2' THEN 'upstream' WHEN {REL} LIKE '%7.md' THEN 'untrusted' ELSE 'unknown' END"
)
RANK_SQL = "CASE trust WHEN 'authored' THEN 0 WHEN 'curated' THEN 1 WHEN 'upstream' THEN 2 WHEN 'untrusted' THEN 3 WHEN 'unknown' THEN 4 ELSE 5 END"


def _rel() -> F.Column:
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: chunk_id is the document's number, headings its language."""
    docs = _table(spark, sf_dir, "documents").withColumn("rel", _rel())
    return docs.select(
        F.col("doc_id").alias("chunk_id"), "text", "rel", F.col("source").alias("doc_rel"), F.array("lang", "source").alias("heading_path"),
        F.lit(None).cast("string").alias("section_ref"), ingest.trust_tier(F.col("rel"), TRUST_RULES).alias("trust"), F.col("rel").alias("citation"),
    )


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return ranking.search_texts(_corpus(spark, sf_dir), _questions(spark, sf_dir), k, weights=(1.0, 1.0))


STOP_SQL = ", ".join(f"'{w}'" for w in text.STOPWORDS)
WORDS_CTE = f"""
asked AS (SELECT item_id AS query_id, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+') AS found FROM benchmark),
kept AS (SELECT query_id, found, list_filter(found, lambda w: length(w) >= 2 AND lower(w) NOT IN ({STOP_SQL})) AS telling FROM asked),
words AS (SELECT query_id, unnest(CASE WHEN len(telling) > 0 THEN telling ELSE found END) AS word,
    unnest(range(CAST(CASE WHEN len(telling) > 0 THEN len(telling) ELSE len(found) END AS BIGINT))) AS item FROM kept),
qterms AS (SELECT query_id, unnest(regexp_extract_all(lower(word), '[\\p{{L}}\\p{{N}}]+')) AS term FROM words)"""


def _postings_sql(chunks: str) -> str:
    """CTEs postings, lengths, corpus, terms over a relation (chunk_id, body, head)."""
    return f"""
toks AS (SELECT chunk_id, 'b' AS field, unnest(regexp_extract_all(lower(coalesce(body, '')), '[\\p{{L}}\\p{{N}}]+')) AS term FROM ({chunks})
    UNION ALL SELECT chunk_id, 'h', unnest(regexp_extract_all(lower(coalesce(head, '')), '[\\p{{L}}\\p{{N}}]+')) FROM ({chunks})),
postings AS (SELECT chunk_id, term, count(*) FILTER (field = 'b') AS tf_text, count(*) FILTER (field = 'h') AS tf_head FROM toks GROUP BY ALL),
lengths AS (SELECT c.chunk_id, coalesce(sum(tf_text + tf_head), 0) AS n FROM ({chunks}) c LEFT JOIN postings USING (chunk_id) GROUP BY 1),
corpus AS (SELECT count(*) AS chunks, avg(n) AS avg_len FROM lengths),
terms AS (SELECT term, count(*) AS n_docs, greatest(ln((any_value(chunks) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM postings, corpus GROUP BY 1)"""


def _scores_sql(w_text: float, w_head: float) -> str:
    tf = f"({w_text} * tf_text + {w_head} * tf_head)"
    return f"""
asked_terms AS (SELECT query_id, term, count(*) AS times FROM qterms GROUP BY ALL),
scores AS (SELECT query_id, chunk_id, sum(times * idf * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * n / avg_len))) AS score
    FROM asked_terms JOIN terms USING (term) JOIN postings USING (term) JOIN lengths USING (chunk_id), corpus GROUP BY 1, 2)"""


DOC_CHUNKS = "SELECT doc_id AS chunk_id, text AS body, CAST(NULL AS VARCHAR) AS head FROM documents"


def _ranked_sql(k: int) -> str:
    return f"""
ranked AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INT) AS rank
    FROM scores QUALIFY rank <= {k})"""


LEXICAL_CTES = f"{WORDS_CTE}, {_postings_sql(DOC_CHUNKS)}, {_scores_sql(1.0, 1.0)}"

# ------------------------------------------------------------------ scope, trust, identity, ingest


@query("SELECT source AS root, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def s02_scope_report(spark, sf_dir):
    files = _table(spark, sf_dir, "documents").select(F.col("source").alias("root"), F.octet_length("text").alias("length"))
    return ingest.scope_report(files)


FILE_REL = "concat(CASE lang WHEN 'de' THEN 'node_modules' WHEN 'fr' THEN 'drafts' ELSE source END, '/', CAST(doc_id AS VARCHAR), CASE WHEN source IN ('src3', 'src4') THEN '.txt' WHEN source = 'src5' THEN '.MD' ELSE '.md' END)"


@query(f"""SELECT doc_id, {FILE_REL} AS rel FROM documents WHERE lang NOT IN ('de', 'fr') AND source NOT IN ('src3', 'src4') AND n_chars <= 5000""")
def f01_f05_file_filters(spark, sf_dir):
    folder = F.when(F.col("lang") == "de", "node_modules").when(F.col("lang") == "fr", "drafts").otherwise(F.col("source"))
    suffix = F.when(F.col("source").isin("src3", "src4"), ".txt").when(F.col("source") == "src5", ".MD").otherwise(".md")
    files = _table(spark, sf_dir, "documents").select("doc_id", F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("rel"), "n_chars")
    return files.where(ingest.wanted(F.col("rel"), F.col("n_chars"), exclude=("drafts/*",), max_bytes=5000)).select("doc_id", "rel")


@query(f"SELECT doc_id, {REL} AS rel, {TRUST_SQL} AS trust FROM documents")
def f06_trust_assign(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", _rel().alias("rel"))
    return docs.withColumn("trust", ingest.trust_tier(F.col("rel"), TRUST_RULES))


@query(f"""SELECT doc_id, sha256(text) AS content_hash, substr(sha256({REL}), 1, 16) AS path_id,
    substr(sha256(concat(substr(sha256({REL}), 1, 16), ':0:0')), 1, 16) AS chunk_id FROM documents""")
def identity_hashes(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", identity.content_hash(F.col("text")).alias("content_hash"), identity.doc_id(_rel()).alias("path_id"))
    return docs.withColumn("chunk_id", identity.chunk_id(F.col("path_id"), F.lit(0), F.lit(0)))


KNOWN_SQL = "SELECT doc_id, sha256(concat(text, CASE WHEN quality = 0 THEN '#' ELSE '' END)) AS content_hash FROM documents JOIN labels USING (doc_id)"
FOUND_SQL = "SELECT doc_id, sha256(text) AS content_hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)"


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two states of one corpus: now without toxic documents; before, the labelled ones, poor ones in another version."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    found = docs.join(labels.where("toxic = 1"), "doc_id", "left_anti").select("doc_id", identity.content_hash(F.col("text")).alias("content_hash"))
    version = F.concat("text", F.when(F.col("quality") == 0, "#").otherwise(""))
    return found, docs.join(labels, "doc_id").select("doc_id", identity.content_hash(version).alias("content_hash"))


@query(f"""WITH f AS ({FOUND_SQL}), k AS ({KNOWN_SQL}) SELECT coalesce(f.doc_id, k.doc_id) AS doc_id, CASE WHEN k.doc_id IS NULL THEN 'added'
    WHEN f.doc_id IS NULL THEN 'removed' WHEN f.content_hash = k.content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM f FULL JOIN k ON f.doc_id = k.doc_id""")
def j01_ingest_plan(spark, sf_dir):
    return ingest.plan(*_snapshots(spark, sf_dir))


@query(f"SELECT doc_id FROM ({KNOWN_SQL}) WHERE doc_id NOT IN (SELECT doc_id FROM ({FOUND_SQL}))")
def j09_removed_docs(spark, sf_dir):
    return ingest.removed(*_snapshots(spark, sf_dir))


@query(f"""WITH f AS ({FOUND_SQL}), k AS ({KNOWN_SQL}) SELECT doc_id FROM f LEFT JOIN k USING (doc_id) WHERE k.content_hash IS DISTINCT FROM f.content_hash""")
def u02_work_set(spark, sf_dir):
    return ingest.work(ingest.plan(*_snapshots(spark, sf_dir)))


@query(f"""WITH f AS ({FOUND_SQL}), k AS ({KNOWN_SQL}), p AS (SELECT coalesce(f.doc_id, k.doc_id) AS doc_id, f.content_hash AS n, k.content_hash AS o FROM f FULL JOIN k ON f.doc_id = k.doc_id)
    SELECT doc_id, coalesce(n, o) AS content_hash FROM p WHERE n IS NOT NULL""")
def w01_replace_documents(spark, sf_dir):
    found, known = _snapshots(spark, sf_dir)
    planned = ingest.plan(found, known)
    drop = planned.where(F.col("status") != "unchanged")
    new = found.join(ingest.work(planned), "doc_id", "left_semi")
    return ingest.replace_documents(known, new, drop)


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_content_hash(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", identity.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


# ------------------------------------------------------------------ lexical index and search


@query(f"WITH {WORDS_CTE} SELECT query_id, CAST(item AS INT) AS item, word FROM words")
def t12_query_terms(spark, sf_dir):
    return _questions(spark, sf_dir).select("query_id", F.posexplode(text.query_words(F.col("question"))).alias("item", "word"))


@query(f"""WITH {WORDS_CTE} SELECT query_id, '"' || string_agg(word, '" OR "' ORDER BY item) || '"' AS expression FROM words GROUP BY 1""")
def t12_match_expression(spark, sf_dir):
    return _questions(spark, sf_dir).select("query_id", text.match_expression(F.col("question")).alias("expression")).where("expression != ''")


@query(f"WITH {_postings_sql(DOC_CHUNKS)} SELECT term, n_docs, round(idf, 6) AS idf FROM terms")
def a07_term_stats(spark, sf_dir):
    return ranking.build_index(_corpus(spark, sf_dir)).terms.select("term", "n_docs", F.round("idf", 6).alias("idf"))


@query(f"WITH {_postings_sql(DOC_CHUNKS)} SELECT chunk_id, CAST(n AS BIGINT) AS n FROM lengths")
def a07_doc_len(spark, sf_dir):
    return ranking.build_index(_corpus(spark, sf_dir)).lengths


@query(f"WITH {LEXICAL_CTES}, {_ranked_sql(10)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ranked")
def k01_bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


PAGE_CHUNKS = r"""SELECT page_id AS chunk_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS head,
    regexp_replace(regexp_extract(html, '<article>((?:.|\n)*)</article>', 1), '<[^>]*>', ' ', 'g') AS body FROM pages"""


def _pages(spark, sf_dir) -> DataFrame:
    body = F.regexp_replace(F.regexp_extract("html", r"<article>((?s:.)*)</article>", 1), "<[^>]*>", " ")
    return _table(spark, sf_dir, "pages").select(F.col("page_id").alias("chunk_id"), body.alias("text"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("headings"))


@query(f"WITH {WORDS_CTE}, {_postings_sql(PAGE_CHUNKS)}, {_scores_sql(0.5, 1.0)}, {_ranked_sql(10)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ranked")
def k01_bm25_two_field(spark, sf_dir):
    return ranking.search_texts(_pages(spark, sf_dir), _questions(spark, sf_dir), 10, headings_col="headings").select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query()
def k01_bm25_stemmed(spark, sf_dir):
    index = ranking.build_index(_pages(spark, sf_dir), headings_col="headings", stem=True, positions=True, staged=True)
    return ranking.lexical_search(index, _questions(spark, sf_dir), 10, phrases=True).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


# ------------------------------------------------------------------ vectors and dense search

EMBED_DIM = 512
EMBED_SQL = f"""
tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS token FROM documents),
h AS (SELECT id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS v, count(*) AS n FROM tok GROUP BY id, token),
s AS (SELECT id, CAST(v % {EMBED_DIM} AS INT) AS bucket, sum(CASE WHEN v >= 2147483648 THEN n ELSE -n END) AS v FROM h GROUP BY ALL HAVING sum(CASE WHEN v >= 2147483648 THEN n ELSE -n END) != 0)"""


@query(f"WITH {EMBED_SQL} SELECT id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS weight FROM s")
def t15_hash_embed_md5(spark, sf_dir):
    return embed.sparse_embedding(_table(spark, sf_dir, "documents"), "doc_id", "text", EMBED_DIM, "md5").select("id", "bucket", F.round("weight", 6).alias("weight"))


@query()
def t15_hash_embed_blake2b(spark, sf_dir):
    return embed.HashingEmbedder(EMBED_DIM).encode(_table(spark, sf_dir, "documents"), "doc_id", "text")


DOT_SQL = "list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: CAST(v.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE)))"
NORM_SQL = "sqrt(list_sum(list_transform({0}.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
COSINE_SQL = f"{DOT_SQL} / ({NORM_SQL.format('v')} * {NORM_SQL.format('q')})"


def _dense_sql(where: str = "TRUE") -> str:
    return f"""WITH scored AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {COSINE_SQL} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND {where})
    SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INT) AS rank FROM scored QUALIFY rank <= 10"""


def _vector_queries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the search's stated query set: ids divisible by 20."""
    table = _table(spark, sf_dir, "embeddings")
    return table.withColumnRenamed("vec_id", "chunk_id"), table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(_dense_sql())
def k02_cosine_topk(spark, sf_dir):
    rows, queries_ = _vector_queries(spark, sf_dir)
    return dense_search(rows, queries_, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(_dense_sql("v.label IN (1, 3, 5)"))
def f08_cosine_allow(spark, sf_dir):
    rows, queries_ = _vector_queries(spark, sf_dir)
    allow = rows.where(F.col("label").isin(1, 3, 5)).select("chunk_id")
    return dense_search(rows, queries_, 10, allow=allow).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("""SELECT vec_id, label, round(CAST(CASE WHEN label = 3 THEN -embedding[1] ELSE embedding[1] END AS DOUBLE), 6) AS first FROM embeddings
    UNION ALL SELECT -vec_id - 1, label, round(CAST(embedding[1] AS DOUBLE), 6) FROM embeddings WHERE label = 5""")
def w05_vector_upsert(spark, sf_dir):
    current = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    turned = current.where("label = 3").withColumn("embedding", F.transform("embedding", lambda x: -x))
    added = current.where("label = 5").withColumn("vec_id", -F.col("vec_id") - 1)
    merged = vectors.upsert(current, turned.unionByName(added), id_col="vec_id")
    return merged.select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("SELECT vec_id, label FROM embeddings WHERE label IS DISTINCT FROM 3")
def w06_vector_delete(spark, sf_dir):
    current = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return vectors.delete(current, current.where("label = 3"), id_col="vec_id")


@query("SELECT count(*) AS count, CAST(max(len(embedding)) AS INT) AS dim, CAST(sum(len(embedding) * 4) AS BIGINT) AS bytes FROM embeddings")
def a18_vector_stats(spark, sf_dir):
    return vectors.stats(_table(spark, sf_dir, "embeddings"))


# ------------------------------------------------------------------ fusion, hydration, context

SECOND_SQL = """
second AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n, chunk_id) AS INT) AS rank FROM scores JOIN lengths USING (chunk_id) QUALIFY rank <= 20)"""
FUSED_SQL = f"""{LEXICAL_CTES}, {_ranked_sql(20)}, {SECOND_SQL},
both_ AS (SELECT query_id, chunk_id, rank, 'lexical' AS retriever FROM ranked UNION ALL SELECT query_id, chunk_id, rank, 'short' FROM second),
fused AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, string_agg(retriever, ',' ORDER BY retriever) AS retrievers, count(*) AS n FROM both_ GROUP BY 1, 2),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, n DESC, chunk_id) AS INT) AS fused_rank FROM fused)"""


def _fused(spark, sf_dir) -> DataFrame:
    """The lexical ranking and a second one of the same matches, shortest document first."""
    index = ranking.index_for(_corpus(spark, sf_dir), _questions(spark, sf_dir))
    scores = ranking.bm25_scores(index, _questions(spark, sf_dir), weights=(1.0, 1.0))
    short = scores.join(index.lengths, "chunk_id").select("query_id", "chunk_id", (-F.col("n")).cast("double").alias("score"))
    rank = lambda s, name: ranking.top_k(s, 20).select("query_id", "chunk_id", "rank", F.lit(name).alias("retriever"))
    return ranking.fuse(rank(scores, "lexical").unionByName(rank(short, "short")))


@query(f"WITH {FUSED_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, retrievers, fused_rank FROM placed")
def a05_rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.array_join("retrievers", ",").alias("retrievers"), "fused_rank")


HYDRATED_SQL = f"""{FUSED_SQL}, docs AS (SELECT doc_id AS chunk_id, source, {REL} AS citation, {TRUST_SQL} AS trust, text FROM documents)"""


@query(f"""WITH {HYDRATED_SQL} SELECT query_id, chunk_id, citation, trust, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, {RANK_SQL}, fused_rank) AS INT) AS rank
    FROM placed JOIN docs USING (chunk_id) WHERE fused_rank <= 16 QUALIFY rank <= 8""")
def k05_rrf_trust_tiebreak(spark, sf_dir):
    return ranking.hydrate(_fused(spark, sf_dir), _corpus(spark, sf_dir), 8, prefer_trust=True).select("query_id", "chunk_id", "citation", "trust", "rank")


SNIPPET_BODY = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
SNIPPET_SQL = f"CASE WHEN length({SNIPPET_BODY}) > 160 THEN rtrim(substr({SNIPPET_BODY}, 1, 159)) || '…' ELSE {SNIPPET_BODY} END"


@query(f"""WITH {HYDRATED_SQL} SELECT query_id, chunk_id, citation, {SNIPPET_SQL} AS snippet, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS INT) AS rank
    FROM placed JOIN docs USING (chunk_id) WHERE fused_rank <= 16 QUALIFY rank <= 8""")
def j02_hydrate(spark, sf_dir):
    hits = ranking.hydrate(_fused(spark, sf_dir), _corpus(spark, sf_dir), 8)
    return hits.select("query_id", "chunk_id", "citation", text.snippet(F.col("text")).alias("snippet"), "rank")


@query(f"SELECT doc_id, {SNIPPET_SQL} AS snippet FROM documents")
def t18_snippet(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("""SELECT c.conv_id, c.turn, CASE WHEN p.text IS NOT NULL THEN p.text || chr(10) || chr(10) || c.text ELSE c.text END AS context
    FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def j03_parent_context(spark, sf_dir):
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", name(F.col("turn")).alias("chunk_id"), name(F.col("turn") - 1).alias("parent_chunk_id"))
    return answering.with_parents(turns, turns).select("conv_id", "turn", "context")


CITED_SQL = r"""WITH c AS (SELECT page_id, concat('pages/', CAST(page_id AS VARCHAR), '.md') AS rel, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages),
d AS (SELECT page_id, rel, trim(regexp_replace(regexp_replace(title, '\*\*|__|~~|\*|_|`', '', 'g'), '\s+', ' ', 'g')) AS h FROM c)
SELECT page_id, CASE WHEN h = '' THEN rel ELSE rel || ' > ' || CASE WHEN length(h) > 48 THEN rtrim(substr(h, 1, 47)) || '…' ELSE h END END || ' (1/2)' AS citation FROM d"""


@query(CITED_SQL)
def f13_citation(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("chunk_id", F.concat(F.lit("pages/"), F.col("chunk_id").cast("string"), F.lit(".md")).alias("rel"), "headings")
    cited = text.citation(F.col("rel"), F.lit(None).cast("string"), F.array(F.lit("pages"), F.col("headings")), F.lit(0), F.lit(2))
    return pages.select(F.col("chunk_id").alias("page_id"), cited.alias("citation"))


# ------------------------------------------------------------------ passages and answers

HITS_SQL = f"""{LEXICAL_CTES}, {_ranked_sql(5)}, docs AS (SELECT doc_id AS chunk_id, source, lang, {REL} AS citation, {TRUST_SQL} AS trust, text FROM documents),
hits AS (SELECT query_id, chunk_id, score, rank, citation, trust, text, source, lang FROM ranked JOIN docs USING (chunk_id))"""
BUDGET_SQL = f"""{HITS_SQL}, used AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS used, rank = min(rank) OVER (PARTITION BY query_id) AS first FROM hits),
passages AS (SELECT query_id, chunk_id, rank, 'P' || rank AS ref, citation, trust, CASE WHEN first THEN substr(text, 1, 6000) ELSE text END AS passage FROM used WHERE used <= 6000 OR first)"""


def _hits(spark, sf_dir) -> DataFrame:
    return _lexical(spark, sf_dir, 5).join(_corpus(spark, sf_dir), "chunk_id")


def _passages(spark, sf_dir) -> DataFrame:
    return answering.within_budget(_hits(spark, sf_dir), 6000, text_col="text")


@query(f"WITH {BUDGET_SQL} SELECT query_id, chunk_id, ref, length(passage) AS n_chars, md5(passage) AS passage_md5 FROM passages")
def n02_char_budget(spark, sf_dir):
    return _passages(spark, sf_dir).select("query_id", "chunk_id", "ref", F.length("passage").cast("long").alias("n_chars"), F.md5("passage").alias("passage_md5"))


@query(f"""WITH {BUDGET_SQL}, w AS (SELECT query_id, count(*) AS passages, count(*) FILTER (trust NOT IN ('authored', 'curated')) AS weak,
    coalesce(string_agg(DISTINCT trust, ', ' ORDER BY trust) FILTER (trust NOT IN ('authored', 'curated')), '') AS weak_tiers, count(*) FILTER ({RANK_SQL} > 1) AS withheld FROM passages GROUP BY 1)
    SELECT query_id, passages, weak, weak_tiers, withheld FROM w""")
def f09_trust_warnings(spark, sf_dir):
    return answering.trust_floor(_passages(spark, sf_dir), "curated")[1]


@query(f"WITH {BUDGET_SQL} SELECT query_id, chunk_id, ref, trust FROM passages WHERE {RANK_SQL} <= 1")
def f09_trust_floor(spark, sf_dir):
    return answering.trust_floor(_passages(spark, sf_dir), "curated")[0].select("query_id", "chunk_id", "ref", "trust")


SENTENCES_SQL = rf"""{BUDGET_SQL},
cut AS (SELECT query_id, rank, list_filter(string_split(regexp_replace(trim(regexp_replace(passage, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s != '') AS s FROM passages),
split AS (SELECT query_id, rank, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM cut),
qset AS (SELECT item_id AS query_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')), lambda w: length(w) > 2) AS terms FROM benchmark),
over AS (SELECT query_id, rank, sentence, pos, len(list_intersect(terms, list_distinct(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+')))) AS overlap FROM split JOIN qset USING (query_id)),
best AS (SELECT query_id, rank, sentence, CAST(overlap AS INT) AS overlap, CAST(row_number() OVER (PARTITION BY query_id, rank ORDER BY overlap DESC, pos) AS INT) AS sentence_rank FROM over QUALIFY sentence_rank <= 2)"""


@query(f"WITH {SENTENCES_SQL} SELECT query_id, rank, sentence, overlap, sentence_rank FROM best")
def n04_top_sentences(spark, sf_dir):
    return answering.best_sentences(_passages(spark, sf_dir), _questions(spark, sf_dir))


@query(f"""WITH {SENTENCES_SQL}, blocks AS (SELECT query_id, rank, citation || chr(10) || '  ' || string_agg(sentence, chr(10) || '  ' ORDER BY sentence_rank) AS block
        FROM passages JOIN best USING (query_id, rank) GROUP BY query_id, rank, citation),
    texts AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS body FROM blocks GROUP BY 1)
    SELECT item_id AS query_id, CASE WHEN body IS NULL THEN '{answering.NO_PASSAGE}' ELSE '{answering.LEAD}' || chr(10) || chr(10) || body END AS answer FROM benchmark LEFT JOIN texts ON query_id = item_id""")
def q06_extractive_answer(spark, sf_dir):
    return answering.extractive_answers(_passages(spark, sf_dir), _questions(spark, sf_dir)).select("query_id", "answer")


ANSWER_SQL = "'See ' || citation || ' and other/' || CAST(query_id AS VARCHAR) || '.md.'"


@query(f"""WITH {BUDGET_SQL}, top AS (SELECT query_id, max(CASE WHEN rank = 1 THEN citation END) AS citation FROM passages GROUP BY 1)
    SELECT query_id, citation AS supported, 'other/' || CAST(query_id AS VARCHAR) || '.md' AS unsupported, FALSE AS grounded FROM top""")
def t22_citation_check(spark, sf_dir):
    by_query = _passages(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "citation")))["citation"].alias("citations"))
    said = F.concat(F.lit("See "), F.col("citations")[0], F.lit(" and other/"), F.col("query_id").cast("string"), F.lit(".md."))
    checked = answering.check_citations(by_query.withColumn("answer", said))
    return checked.select("query_id", F.array_join("supported", "|").alias("supported"), F.array_join("unsupported", "|").alias("unsupported"), "grounded")


# ------------------------------------------------------------------ evaluation

TARGETS_SQL = """targets AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS doc, CAST(NULL AS VARCHAR) AS heading FROM benchmark
    UNION ALL SELECT item_id, 'src' || ((item_id + 1) % 20), 'EN' FROM benchmark)"""
LANES_SQL = f"""{LEXICAL_CTES}, {_ranked_sql(20)}, {SECOND_SQL}, {TARGETS_SQL},
lanes AS (SELECT query_id, chunk_id, rank, 'lexical' AS retriever FROM ranked UNION ALL SELECT query_id, chunk_id, rank, 'short' FROM second),
matched AS (SELECT l.query_id, l.retriever, l.chunk_id, l.rank, CASE WHEN t.heading IS NOT NULL THEN t.doc || ' > ' || t.heading ELSE t.doc END AS label
    FROM lanes l JOIN documents d ON d.doc_id = l.chunk_id JOIN targets t ON t.query_id = l.query_id AND t.doc = d.source
    WHERE t.heading IS NULL OR contains(lower(d.lang), lower(t.heading)) OR contains(lower(d.source), lower(t.heading))),
firsts AS (SELECT query_id, retriever, label, min(rank) AS rank FROM matched GROUP BY ALL),
outcomes AS (SELECT g.query_id, g.retriever, coalesce(p.positions, []) AS positions, coalesce(f.tp, []) AS tp, 2 AS total
    FROM (SELECT item_id AS query_id, unnest(['lexical', 'short']) AS retriever FROM benchmark) g
    LEFT JOIN (SELECT query_id, retriever, list_sort(list(DISTINCT rank)) AS positions FROM matched GROUP BY ALL) p USING (query_id, retriever)
    LEFT JOIN (SELECT query_id, retriever, list_sort(list(rank)) AS tp FROM firsts GROUP BY ALL) f USING (query_id, retriever)),
metrics AS (SELECT query_id, retriever, CAST(len(list_filter(positions, lambda p: p <= 10)) > 0 AS DOUBLE) AS hit, least(len(list_filter(tp, lambda p: p <= 10)), total) / total AS recall,
    len(list_filter(positions, lambda p: p <= 10)) / 10.0 AS precision, coalesce(1.0 / list_min(positions), 0.0) AS mrr,
    coalesce(list_sum(list_transform(list_filter(tp, lambda p: p <= 10)[1:total], lambda p: 1.0 / log2(p + 1.0))), 0.0) / (1.0 + 1.0 / log2(3.0)) AS ndcg FROM outcomes),
summary AS (SELECT retriever, count(*) AS questions, avg(hit) AS hit, avg(recall) AS recall, avg(precision) AS precision, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM metrics GROUP BY 1)"""


def _lanes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Ranked rows of two retrievers, and the targets of each question: a document, and a heading in another."""
    index = ranking.index_for(_corpus(spark, sf_dir), _questions(spark, sf_dir))
    scores = ranking.bm25_scores(index, _questions(spark, sf_dir), weights=(1.0, 1.0))
    short = scores.join(index.lengths, "chunk_id").select("query_id", "chunk_id", (-F.col("n")).cast("double").alias("score"))
    lanes = ranking.top_k(scores, 20).withColumn("retriever", F.lit("lexical")).unionByName(ranking.top_k(short, 20).withColumn("retriever", F.lit("short")))
    ranked = lanes.join(_corpus(spark, sf_dir).select("chunk_id", "doc_rel", "section_ref", "heading_path"), "chunk_id")
    number = lambda shift: F.concat(F.lit("src"), F.pmod(F.col("query_id") + shift, F.lit(20)).cast("string"))
    none = F.lit(None).cast("string")
    asked = _questions(spark, sf_dir)
    first = asked.select("query_id", number(0).alias("doc"), none.alias("section"), none.alias("heading"))
    return ranked, first.unionByName(asked.select("query_id", number(1).alias("doc"), none.alias("section"), F.lit("EN").alias("heading")))


def _outcomes(spark, sf_dir) -> DataFrame:
    ranked, targets = _lanes(spark, sf_dir)
    retrievers = spark.createDataFrame([("lexical",), ("short",)], "retriever string")
    return evaluation.outcomes(ranked, targets, _questions(spark, sf_dir), retrievers)


@query(f"WITH {LANES_SQL} SELECT query_id, retriever, chunk_id, rank, label FROM matched")
def j06_target_match(spark, sf_dir):
    return evaluation.matches(*_lanes(spark, sf_dir)).select("query_id", "retriever", "chunk_id", "rank", "label")


@query(f"WITH {LANES_SQL} SELECT query_id, retriever, label, rank FROM firsts")
def a14_first_rank_per_target(spark, sf_dir):
    return evaluation.first_ranks(evaluation.matches(*_lanes(spark, sf_dir)))


_M = ", ".join(f"round({m}, 6) AS {m}" for m in evaluation.METRICS)


def _rounded() -> list:
    return [F.round(m, 6).alias(m) for m in evaluation.METRICS]


@query(f"WITH {LANES_SQL} SELECT query_id, retriever, {_M} FROM metrics")
def a08_a12_metrics(spark, sf_dir):
    return evaluation.metrics(_outcomes(spark, sf_dir), 10).select("query_id", "retriever", *_rounded())


@query(f"WITH {LANES_SQL} SELECT retriever, questions, {_M} FROM summary")
def a13_summary_by_retriever(spark, sf_dir):
    return evaluation.summary(_outcomes(spark, sf_dir), 10).select("retriever", "questions", *_rounded())


@query(f"WITH {LANES_SQL} SELECT retriever, {_M} FROM summary ORDER BY ndcg DESC, retriever LIMIT 1")
def a16_best_retriever(spark, sf_dir):
    return evaluation.best_retriever(evaluation.summary(_outcomes(spark, sf_dir), 10)).select("retriever", *_rounded())


@query(f"""WITH {LANES_SQL}, m AS (SELECT retriever, CAST(row_number() OVER (PARTITION BY retriever ORDER BY query_id) AS INT) AS place, query_id FROM outcomes WHERE len(positions) = 0)
    SELECT * FROM m WHERE place <= 5""")
def a17_misses(spark, sf_dir):
    return evaluation.misses(_outcomes(spark, sf_dir))


# ------------------------------------------------------------------ reports and chunks


@query(f"SELECT {TRUST_SQL} AS trust, count(*) AS chunks FROM documents GROUP BY 1")
def a02_trust_counts(spark, sf_dir):
    return _corpus(spark, sf_dir).groupBy("trust").agg(F.count("*").alias("chunks"))


@query("""WITH s AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) AS place, count(*) OVER () AS total FROM documents)
    SELECT min(n) AS min_chars, max(CASE WHEN place = total // 2 + 1 THEN n END) AS median_chars, max(n) AS max_chars FROM s""")
def a03_chunk_sizes(spark, sf_dir):
    """The upper median comes from counts by length, so no task sorts all rows."""
    lengths = _table(spark, sf_dir, "documents").where("text is not null").groupBy(F.length("text").cast("long").alias("n")).agg(F.count("*").alias("c"))
    return upper_median(lengths)


def upper_median(lengths: DataFrame) -> DataFrame:
    """``min_chars, median_chars, max_chars`` of a histogram (n, c); the median is the upper of two middle values."""
    from pyspark.sql import Window

    at = Window.orderBy("n")
    summed = lengths.select("n", F.sum("c").over(at).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("total"))
    middle = F.min(F.when(F.col("upto") >= F.floor(F.col("total") / 2) + 1, F.col("n")))
    return summed.agg(F.min("n").alias("min_chars"), middle.alias("median_chars"), F.max("n").alias("max_chars"))


@query("""SELECT count(*) AS chunks, count(*) FILTER (turn > 0) AS parented, count(*) FILTER (turn > 0) * 100 // count(*) AS parented_percent FROM conversations""")
def a04_conditional_counts(spark, sf_dir):
    parented = F.count_if(F.col("turn") > 0)
    return _table(spark, sf_dir, "conversations").agg(F.count("*").alias("chunks"), parented.alias("parented"), F.floor(parented * 100 / F.count("*")).alias("parented_percent"))


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)
    SELECT doc_id FROM o WHERE place % greatest(n // 5, 1) = 0 AND place // greatest(n // 5, 1) < 5""")
def n06_systematic_sample(spark, sf_dir):
    """Every n-th row in id order, five in all: a report's sample."""
    return systematic_sample(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5)


def systematic_sample(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Rows at places 0, step, 2 * step, ... in order.  Places are counted per range of the order column and shifted by the
    counts of the ranges before, so only a small table of counts is ordered in one task."""
    from pyspark.sql import Window

    parts = rows.select(F.col(order)).distinct().agg(F.percentile_approx(order, F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(640)).alias("q"))
    placed = rows.crossJoin(F.broadcast(parts)).withColumn("range", F.size(F.filter(F.coalesce("q", F.array()), lambda b: b <= F.col(order)))).drop("q")
    counts = placed.groupBy("range").agg(F.count("*").alias("c"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift"), F.sum("c").over(Window.partitionBy()).alias("total"))
    step = F.greatest(F.floor(F.col("total") / size), F.lit(1))
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1).join(F.broadcast(shifts), "range").withColumn("at", F.col("at") + F.col("shift"))
    return numbered.where((F.col("at") % step == 0) & (F.col("at") / step < size)).select(*rows.columns)


def _markdown(spark, sf_dir) -> DataFrame:
    """Conversations as Markdown documents: one heading per turn."""
    turn = F.concat(F.lit("## "), (F.col("turn") + 1).cast("string"), F.lit(" "), F.col("role"), F.lit("\n\n"), F.col("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n\n")
    by_conversation = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(body.alias("body"))
    rel = F.concat(F.lit("talks/"), F.col("conv_id").cast("string"), F.lit(".md"))
    return by_conversation.select(identity.doc_id(rel).alias("doc_id"), rel.alias("rel"), F.lit("authored").alias("trust"), F.concat(F.lit("# Talk\n\n"), "body").alias("text"))


# Each conversation's turns in order, as the sections they become; nl counts a text's lines.
TURNS_SQL = r"""
turns AS (SELECT conv_id, concat('talks/', CAST(conv_id AS VARCHAR), '.md') AS rel, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal,
    concat(CAST(turn + 1 AS VARCHAR), ' ', role) AS title, length(text) - length(replace(text, chr(10), '')) + 1 AS nl, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS final FROM conversations),
spans AS (SELECT *, 3 + coalesce(sum(3 + nl) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_line FROM turns)"""


@query(f"""WITH {TURNS_SQL}
    SELECT DISTINCT substr(sha256(rel), 1, 16) AS doc_id, 0 AS ordinal, 1 AS level, 'Talk' AS title, CAST(NULL AS VARCHAR) AS section_ref, 1 AS start_line, 2 AS end_line, CAST(NULL AS INT) AS parent FROM turns
    UNION ALL SELECT substr(sha256(rel), 1, 16), CAST(ordinal AS INT), 2, title, CAST(turn + 1 AS VARCHAR), CAST(start_line AS INT),
        CAST(start_line + 1 + nl + CASE WHEN final THEN CASE WHEN ends_with(text, chr(10)) THEN -1 ELSE 0 END ELSE 1 END AS INT), 0 FROM spans""")
def t04_sections(spark, sf_dir):
    rows = chunking.section_rows(_markdown(spark, sf_dir))
    return rows.select("doc_id", "ordinal", "level", "title", "section_ref", "start_line", "end_line", "parent")


def windows_sql(source: str) -> str:
    """CTEs up to parts (id, number, a, piece) over a relation (id, body): paragraphs seated in windows one by one, longer
    ones cut one window after the other.  Needs WITH RECURSIVE."""
    size, least = chunking.MAX_CHARS, chunking.MAX_CHARS - chunking.OVERLAP
    fits = f"filled > 0 AND filled + 2 + length(para) <= {size}"
    seen = f"substr(w, a + {least} + 1, {chunking.OVERLAP})"
    last = lambda mark: f"CASE WHEN contains({seen}, {mark}) THEN a + {least} + length({seen}) - strpos(reverse({seen}), {mark}) END"
    end = f"CASE WHEN a + {size} >= length(w) THEN length(w) ELSE coalesce({last('chr(10)')}, {last(chr(39) + ' ' + chr(39))}, a + {size}) END"
    return rf"""
paras AS (SELECT id, unnest(p) AS para, unnest(range(len(p))) AS pos FROM (SELECT id, regexp_split_to_array(body, '\n\s*\n') AS p FROM {source} WHERE length(body) > {size})),
seats AS (SELECT id, pos, 1 AS number, length(para) AS filled FROM paras WHERE pos = 0 UNION ALL
    SELECT p.id, p.pos, CASE WHEN {fits} THEN number ELSE number + 1 END, CASE WHEN {fits} THEN filled + 2 + length(para) ELSE length(para) END FROM seats s JOIN paras p ON p.id = s.id AND p.pos = s.pos + 1),
wholes AS (SELECT id, number, string_agg(para, chr(10) || chr(10) ORDER BY pos) AS w, max(number) OVER (PARTITION BY id) AS final FROM seats JOIN paras USING (id, pos) GROUP BY id, number),
cuts AS (SELECT id, number, w, a, {end} AS b FROM (SELECT id, number, w, 0 AS a FROM wholes WHERE length(w) > {size}) UNION ALL
    SELECT id, number, w, a, {end} FROM (SELECT id, number, w, greatest(a + 1, b - {chunking.OVERLAP}) AS a FROM cuts WHERE b < length(w))),
parts AS (SELECT id, 0 AS number, 0 AS a, body AS piece FROM {source} WHERE length(body) <= {size}
    UNION ALL SELECT id, number, 0, w FROM wholes WHERE length(w) <= {size} AND w != '' AND (number < final OR trim(w, ' ' || chr(10)) != '')
    UNION ALL SELECT id, number, a, substr(w, a + 1, b - a) FROM cuts)"""


def chunks_sql(text_sql: str = "text", where: str = "TRUE") -> str:
    """CTEs up to chunked (rel, ordinal, turn, part, parts, piece) of the conversations as Markdown."""
    return rf"""{TURNS_SQL},
own AS (SELECT conv_id, ordinal, turn, rel, title, regexp_replace(regexp_replace({text_sql}, '^\s+', ''), '\s+$', '') AS body FROM turns WHERE {where}),
giving AS (SELECT rel, ordinal, turn, title, concat(conv_id, ':', ordinal) AS id, title || chr(10) || chr(10) || body AS body FROM own WHERE length(body) >= {chunking.MIN_CHARS}), {windows_sql("giving")},
counted AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY number, a) AS place, length(regexp_replace(regexp_replace(piece, '^\s+', ''), '\s+$', '')) >= {chunking.MIN_CHARS} AS enough FROM parts),
stay AS (SELECT * FROM counted WHERE enough OR n = 1 OR (place = 1 AND id NOT IN (SELECT id FROM counted WHERE enough))),
chunked AS (SELECT rel, ordinal, turn, title, piece, CAST(row_number() OVER (PARTITION BY id ORDER BY number, a) - 1 AS INT) AS part, CAST(count(*) OVER (PARTITION BY id) AS INT) AS parts FROM stay JOIN giving USING (id))"""


CHUNK_ID_SQL = "substr(sha256(concat(substr(sha256(rel), 1, 16), ':', CAST(ordinal AS VARCHAR), ':', CAST(part AS VARCHAR))), 1, 16)"
CHUNK_CITED_SQL = "rel || ' §' || CAST(turn + 1 AS VARCHAR) || CASE WHEN parts > 1 THEN ' (' || (part + 1) || '/' || parts || ')' ELSE '' END"


@query(f"""WITH RECURSIVE {chunks_sql()} SELECT {CHUNK_ID_SQL} AS chunk_id, {CHUNK_CITED_SQL} AS citation, CAST(ordinal AS INT) AS ordinal, part, parts, CAST(NULL AS VARCHAR) AS parent_chunk_id, length(piece) AS n_chars FROM chunked""")
def t09_chunks(spark, sf_dir):
    rows = chunking.chunks(_markdown(spark, sf_dir))
    return rows.select("chunk_id", "citation", "ordinal", "part", "parts", "parent_chunk_id", F.length("text").cast("long").alias("n_chars"))


@query(f"""WITH RECURSIVE bodies AS (SELECT doc_id AS id, coalesce(text, '') AS body FROM documents), {windows_sql("bodies")}
    SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY number, a) - 1 AS INT) AS part, md5(piece) AS window_md5 FROM parts""")
def t08_hard_window(spark, sf_dir):
    return chunking.window_rows(_table(spark, sf_dir, "documents")).select("doc_id", "part", F.md5("text").alias("window_md5"))
