"""The filter audit and language identification beside plain versions, on the smallest tables and on odd rows."""

import os
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import parity
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, filter_audit, language_id

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    many = " ".join(f"W{i}" for i in range(120))
    long = " ".join(f"w{i % 997} x{i}" for i in range(30_000))
    return [
        (1, None, None), (2, "", "en"), (3, many, "en"), (4, many, "de"), (5, many + " #", None), (6, long, "en"), (7, " \t\n\x0b ", "x"), (8, "a b word", "x"),
        (8, "a b word", "x"), (8, "another text of one id", "x"), (8, "a b word", "en"), (None, "no id", "x"), (None, "no id", "x"), (9, "no id", ""), (10, "AB " * 200, "x"),
        (11, " ".join(["AB"] * 20 + [f"v{i}" for i in range(80)]), "x"), (12, " ".join(["v0"] * 21 + [f"v{i}" for i in range(80)]), "x"), (13, "ÄÖÜ 😀", "x"),
    ]


def audit_rows(rows, labels):
    """The audit of (doc_id, text, lang) and (doc_id, quality, toxic) rows by going through all orders row by row."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = defaultdict(list)
    for i, text, lang in rows:
        text = text or ""
        words = WORDS.findall(text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i,
        }
        parts[lang or ""].append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        removed_ever = Counter()
        for order in permutations("ABCDE"):
            stay = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in stay if f in d[0]]
                stay_before, stay = len(stay), [d for d in stay if f not in d[0]]
                redundant = sum(f in d[0] for d in docs) - len(gone)
                removed_ever[f] += len(gone)
                assert stay_before == len(stay) + len(gone)
                out.append([part, "".join(order), step, len(stay), len(gone), redundant, sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f])
        for row in out:
            if row[0] == part:
                row[-1] = removed_ever[row[1][row[2] - 1]]
    return sorted(map(tuple, out))


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_of_odd_rows(spark):
    rows = odd_rows()
    labels = [(3, 1, 0), (3, 0, 1), (4, None, None), (8, 1, 1), (10, 1, None), (None, 1, 1), (99, 1, 1)]
    # Further columns with names that the operator uses inside.
    docs = spark.createDataFrame([(*r, "k", 5, 1, "p") for r in rows], "doc_id long, text string, lang string, key string, mask int, words int, parts string")
    known = spark.createDataFrame([(*r, "m") for r in labels], "doc_id long, quality int, toxic int, mask string")
    got = filter_audit.audit(docs, known)
    assert got.columns == list(AUDIT) or set(got.columns) == set(AUDIT)
    assert sorted(map(tuple, got.select(*AUDIT).collect())) == audit_rows(rows, labels)


@needs_tables
def test_audit_of_the_table(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    got = sorted(map(tuple, filter_audit.audit(docs, labels).select(*AUDIT).collect()))
    assert got == audit_rows(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(none, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).collect() == []


def test_audit_without_labels_and_with_text_ids(spark):
    docs = spark.createDataFrame([("b", "x", "l"), ("a", "x", "l")], "doc_id string, text string, lang string")
    got = filter_audit.audit(docs, spark.createDataFrame([], "doc_id string, quality int, toxic int")).where("filter_order = 'EABCD' and step = 1").first()
    assert (got["kept"], got["removed"], got["good_lost"], got["toxic_lost"]) == (1, 1, 0, 0)


def test_audit_of_a_hot_text(spark):
    """A text that a third of all rows share, and an id that many texts share."""
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("l").alias("lang"))
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(map(tuple, filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).select(*AUDIT).collect()))
    assert got == audit_rows(rows, [])


def test_audit_sql_on_odd_rows(spark, tmp_path):
    rows = [(i, t, lang) for i, t, lang in odd_rows() if i is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (3, 0, 1), (8, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = lambda s, d: filter_audit.audit(common.table(s, d, "documents"), common.table(s, d, "labels"))
    assert parity.compare(spark, parity.connect(str(tmp_path)), "audit", run, filter_audit.oracle(), str(tmp_path)) == ""


# ------------------------------------------------------------------ languages


def plain_grams(text):
    letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()
    out = Counter()
    for word in letters:
        padded = f" {word} "
        out.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
    return out


def plain_profile(counts, size):
    return {g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def plain_languages(rows, size=language_id.SIZE):
    sums = defaultdict(Counter)
    for i, text, lang in rows:
        if lang is not None and not held(i) and plain_grams(text):
            sums[lang].update(plain_grams(text))
    known = {lang: plain_profile(c, size) for lang, c in sorted(sums.items())}
    out = []
    for i, text, _ in rows:
        mine = plain_profile(plain_grams(text), size)
        if not mine or not known:
            out.append((i, held(i), "und", 0.0))
            continue
        distance = {lang: sum(abs(r - p[g]) if g in p else size for g, r in mine.items()) for lang, p in known.items()}
        best = min(sorted(distance), key=distance.get)
        out.append((i, held(i), best, 1 - distance[best] / (size * len(mine))))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in df.collect()), key=repr)


def same(got, want):
    return [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want, strict=True))


def language_rows():
    return [
        *odd_rows(), (20, "the cat the dog the house", "en"), (21, "der hund die katze das haus", "de"), (22, "12 34 !!", "en"), (23, "İstanbul ŞEHRİ", "tr"),
        (24, "𐐀𐐁 𐐂𐐃 ǅ", "dx"), (25, "中文 字", "zh"), (26, "the die", None), (27, "ðþ", None), (28, "été l'été", "fr"),
    ]


@pytest.mark.parametrize("size", [3, 50, 400])
def test_languages_of_odd_rows(spark, size):
    rows = language_rows()
    docs = spark.createDataFrame([(*r, 1, "a", 2.0) for r in rows], "doc_id long, text string, lang string, rank int, letters string, score double")
    got, want = found(language_id.identify(docs, size=size)), plain_languages(rows, size)
    # The lower case of one letter may be two characters in one library and one in another.
    assert same([g for g in got if g[0] != 23], [w for w in want if w[0] != 23])


@needs_tables
def test_languages_of_the_table(spark):
    docs = common.table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    got = found(language_id.identify(docs))
    assert same(got, plain_languages(rows))
    truth = {i: lang for i, _, lang in rows}
    unseen = [g for g in got if g[1]]
    assert sum(g[2] == truth[g[0]] for g in unseen) >= 0.97 * len(unseen)


def test_held_out_languages_are_not_read(spark):
    rows = [(i, f"alpha beta gamma {i}" if i % 2 else f"eins zwei drei {i}", "x" if i % 2 else "y") for i in range(60)]
    other = [(i, t, "z" if held(i) else lang) for i, t, lang in rows]
    a, b = (found(language_id.identify(spark.createDataFrame(r, "doc_id long, text string, lang string"))) for r in (rows, other))
    assert a == b and {g[2] for g in a} == {"x", "y"}


def test_nothing_to_learn_and_nothing_to_say(spark):
    schema = "doc_id long, text string, lang string"
    assert language_id.identify(spark.createDataFrame([], schema)).collect() == []
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(spark.createDataFrame([(1, "some words", None)], schema)).collect()] == [("und", 0.0)]


def test_too_many_languages_are_an_error(spark):
    rows = [(0, f"word{chr(97 + i)}", f"l{i}") for i in range(9)]
    with pytest.raises(ValueError, match="max_languages"):
        language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_languages=8)


def test_slices_and_flushes_count_the_same(spark, monkeypatch):
    text = language_id.np.random.default_rng(1).choice(list("abc déf"), 5000)
    letters = " " + " ".join("".join(text).split()) + " "
    whole = language_id.gram_counts(letters)
    monkeypatch.setattr(language_id, "SLICE", 17)
    sliced = language_id.gram_counts(letters)
    assert (whole[0] == sliced[0]).all() and (whole[1] == sliced[1]).all()
    assert {language_id.gram_text(int(g)): int(n) for g, n in zip(*whole, strict=True)} == plain_grams(letters)
    docs = spark.createDataFrame([(f"l{i % 3}", f"some {i} words ab{chr(97 + i % 26)}") for i in range(200)], "lang string, text string")
    rows = [sorted(map(tuple, language_id.profiles(docs, flush=f).collect())) for f in (1 << 20, 10)]
    assert rows[0] == rows[1] and rows[0]


def test_language_sql_on_odd_rows(spark, tmp_path):
    rows = [r for r in language_rows() if r[0] != 23]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda s, d: language_id.identify(common.table(s, d, "documents"))
    assert parity.compare(spark, parity.connect(str(tmp_path)), "languages", run, language_id.oracle(), str(tmp_path)) == ""
