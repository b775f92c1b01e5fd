"""The pipeline's stages, one after the other, each against what it should have done to its input."""

import os
from collections import Counter

import pytest
from test_operators import base_spans, checked_packing, plain_components, plain_targets

import corpus_pipeline
from corpusloom.llm import queries
from corpusloom.llm.common import stage, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    out.append(docs)
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF), name)
        out.append(docs)
    return out


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_clean_documents_pass_the_quality_filter(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in steps[1].collect()}
    good, poor = [i for i, q in labels.items() if q], [i for i, q in labels.items() if not q]
    # Some fifty rows to learn from; larger tables are held to more in test_operators.
    assert sum(i in kept for i in good) >= 0.9 * len(good) and sum(i in kept for i in poor) <= 0.2 * len(poor)


def test_one_document_of_each_group_stays(steps):
    rows = sorted((r["doc_id"], r["text"]) for r in steps[1].collect())
    parts, _ = plain_components([t for _, t in rows], 5)
    assert sorted(r["doc_id"] for r in steps[2].collect()) == [rows[i][0] for i, p in enumerate(parts) if p == i]


def test_no_secret_is_left(steps):
    assert steps[3].count() == steps[2].count()
    assert not any(base_spans(r["text"]) for r in steps[3].collect())
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3].collect())


def test_mix_takes_by_source(steps):
    size = lambda t: len(t.encode().split())
    have, taken = Counter(), Counter()
    for rows, sums in ((steps[3], have), (steps[4], taken)):
        for r in rows.collect():
            sums[r["source"]] += size(r["text"])
    copies = Counter(r["doc_id"] for r in steps[4].collect())
    assert max(copies.values()) <= 3
    assert all(abs(taken[s] - t) <= max(40, 0.05 * t) for s, t in plain_targets(have).items())


def test_packed_result(steps):
    rows = steps[5].collect()
    checked_packing(rows, 2048)
    copies = Counter(r["doc_id"] for r in steps[4].collect())
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == copies


@pytest.fixture(scope="module")
def strange(spark):
    """Null, repeated and missing ids, null and empty texts, one very long text, repeated rows, clashing column names."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in table(spark, SF, "documents").orderBy("doc_id").limit(60).collect()]
    rows += [(None, rows[k][1], None, None, None) for k in range(5)] + [rows[7]] * 3 + [(1000, None, "en", "x", 0), (1001, "", "en", None, 0), (1002, " ".join(f"w{k % 5000}" for k in range(60_000)), "en", "x", None)]
    extra = ", row long, size int, score double, spans string, digest string"
    return spark.createDataFrame([(*r, k, 1, 0.5, "s", "d") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long" + extra)


def test_every_stage_takes_strange_rows(spark, strange):
    docs = stage(strange, "strange")
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = stage(function(spark, docs, SF), name)
        assert out.columns == docs.columns, name
        ids = Counter(r["doc_id"] for r in out.collect())
        if name == "near_dedup":
            assert all(n == 1 for i, n in ids.items() if i is not None)
            assert ids[None] == docs.where("doc_id is null").count()
        elif name == "secret_redaction":
            assert ids == Counter(r["doc_id"] for r in docs.collect())
        elif name == "source_mix":
            rows = Counter(r["row"] for r in out.collect())
            assert max(rows.values()) <= 3 and set(rows) <= {r["row"] for r in docs.collect()}
        docs = out
    name, function = corpus_pipeline.STAGES[-1]
    checked_packing(function(spark, docs, SF).collect(), 2048)


def test_every_stage_takes_an_empty_table(spark, strange):
    docs = strange.where("false")
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs, SF).count() == 0, name


def test_registered():
    assert [n.split("_")[0] for n in queries.queries() if n.startswith("op")] == [f"op{k}" for k in range(1, 13)]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
