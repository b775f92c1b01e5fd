"""Further registered queries: text functions, reports and hybrid search.  Importing it completes the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import embed, text
from .operators import answering, ranking
from .operators.dense import dense_search
from .queries import BUDGET_SQL, EMBED_DIM, ORACLES, QUERIES, REL, _corpus, _lexical, _pages, _passages, _questions, _rel, _table, query, s02_scope_report

__all__ = ["ORACLES", "QUERIES"]


@query(r"""WITH t AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS terms FROM documents)
    SELECT doc_id, len(terms) AS n_terms, md5(array_to_string(terms, ' ')) AS terms_md5 FROM t""")
def t20_term_set(spark, sf_dir):
    terms = F.array_sort(text.term_set(F.col("text")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(terms).cast("long").alias("n_terms"), F.md5(F.array_join(terms, " ")).alias("terms_md5"))


@query(r"""WITH c AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s != '') AS s FROM documents)
    SELECT doc_id, unnest(s) AS sentence, CAST(unnest(range(len(s))) AS INT) AS pos FROM c""")
def t19_sentences(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))


HEADING_SQL = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '\*\*|__|~~|\*|_|`', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, CASE WHEN length({HEADING_SQL}) > 48 THEN rtrim(substr({HEADING_SQL}, 1, 47)) || '…' ELSE {HEADING_SQL} END AS heading FROM pages")
def t06_clean_heading(spark, sf_dir):
    return _pages(spark, sf_dir).select(F.col("chunk_id").alias("page_id"), text.clean_heading(F.col("headings")).alias("heading"))


@query("""SELECT vec_id, CASE WHEN label < 7 THEN concat(CAST(label AS VARCHAR), '.', CAST(length(CAST(vec_id AS VARCHAR)) AS VARCHAR)) END AS section_ref FROM embeddings""")
def t05_section_ref(spark, sf_dir):
    """Titles made of each vector's label and the length of its number: with a full stop, without, or not numbered."""
    number = F.concat(F.col("label").cast("string"), F.lit("."), F.length(F.col("vec_id").cast("string")).cast("string"))
    ending = F.when(F.col("label") < 4, ". Title").when(F.col("label") < 7, " Title").otherwise("Title")
    return _table(spark, sf_dir, "embeddings").select("vec_id", text.section_ref(F.concat(number, ending)).alias("section_ref"))


@query(f"""WITH {BUDGET_SQL} SELECT query_id, rank, '<passage ref=' || ref || ' citation=''' || citation || ''' provenance=''' || trust || '''>' || chr(10) || trim(passage) || chr(10) || '</passage>' AS block FROM passages""")
def t23_format_passages(spark, sf_dir):
    return answering.formatted(_passages(spark, sf_dir))


@query()
def q03_hybrid_search(spark, sf_dir):
    """Lexical and dense lanes of 50 each, fused, the best eight hydrated."""
    corpus, asked = _corpus(spark, sf_dir), _questions(spark, sf_dir)
    embedder = embed.HashingEmbedder(EMBED_DIM)
    rows = embedder.encode(corpus, "chunk_id", "text").withColumnRenamed("id", "chunk_id")
    encoded = embedder.encode(asked, "query_id", "question").withColumnRenamed("id", "query_id")
    dense = dense_search(rows, encoded, 50).withColumn("retriever", F.lit("dense"))
    lanes = _lexical(spark, sf_dir, 50).withColumn("retriever", F.lit("lexical")).unionByName(dense)
    hits = ranking.hydrate(ranking.fuse(lanes.select("query_id", "chunk_id", "rank", "retriever")), corpus, 8)
    return hits.select("query_id", "chunk_id", "citation", F.round("score", 6).alias("score"), F.array_join("retrievers", ",").alias("retrievers"), "rank")


@query("SELECT count(DISTINCT source) AS roots, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents")
def a19_scope_totals(spark, sf_dir):
    return s02_scope_report(spark, sf_dir).agg(F.count("*").alias("roots"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


@query("SELECT count(DISTINCT conv_id) AS documents, count(*) AS chunks FROM conversations")
def a01_index_stats(spark, sf_dir):
    by_document = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return by_document.agg(F.count("*").alias("documents"), F.sum("n").alias("chunks"))


@query(f"SELECT doc_id, {REL} AS rel FROM documents WHERE {REL} LIKE '%/7.md' OR {REL} = 'src3/3.md'")
def f07_document_filter(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", _rel().alias("rel"))
    return docs.where((F.col("rel") == "src3/3.md") | F.col("rel").endswith("/7.md"))
