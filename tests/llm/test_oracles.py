"""The operators' SQL twins, on the smallest tables and on rows made to differ."""

import os

import duckdb
import parity
import pytest

from corpusloom.llm import embedding_dedup, queries, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert parity.compare(spark, parity.connect(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF) == ""


def test_links_same_as_sql(spark, tmp_path):
    rows = [(k, [1.0, 0.01 * (k // 2), 0.3 * (k % 2)], k % 2) for k in range(30)] + [(40, None, 0), (41, [0.0, 0.0, 0.0], 0), (42, [1.0, None, 0.0], 0), (43, [1.0, 0.0, 0.0], None), (44, [1.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = embedding_dedup.oracle()
    assert parity.compare(spark, parity.connect(str(tmp_path)), "links", lambda s, d: embedding_dedup.near_duplicates(s.read.parquet(f"{d}/embeddings.parquet")), sql, str(tmp_path)) == ""


def test_url_sql_on_odd_urls(spark, tmp_path):
    from test_operators import URLS

    spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert parity.compare(spark, parity.connect(str(tmp_path)), "urls", lambda s, d: url_filter.filter_urls(s.read.parquet(f"{d}/pages.parquet")), url_filter.oracle(), str(tmp_path)) == ""
    assert duckdb.__version__
