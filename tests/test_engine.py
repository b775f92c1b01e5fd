"""Scope, configuration, index life cycle and command line, over small trees of files."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.errors import ConfigError, ScopeError
from corpusloom.functions.embed import HashingEmbedder
from corpusloom.operators import ingest
from corpusloom.plans import engine
from corpusloom.plans.store import IndexStore
from corpusloom.sources.config import catalogue, resolve, trust_rules
from corpusloom.sources.documents import discover
from corpusloom.sources.scope import ScopePolicy

LONG = "This is a sentence about the deviation of a compass, long enough for a chunk."


def tree(base, files):
    for name, body in files.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)


@pytest.fixture
def corpus(tmp_path):
    tree(tmp_path / "notes", {
        "map.md": f"# Map\n\n{LONG}\n\n## 5.3 Deviation\n\nThe deviation table belongs to one vessel only and to no other ship.", "deep dir/nested.md": f"# Nested\n\n{LONG}",
        "notes.txt": "x", "node_modules/pkg/README.md": "x", ".env": "x", "token.json": "x", "clone/.git/HEAD": "x", "clone/README.md": "x", "LOUD.MD": f"# Loud\n\n{LONG}", "big.md": "y" * 5000,
    })
    tree(tmp_path / "private", {"secret.md": "x"})
    (tmp_path / "notes/link.md").symlink_to(tmp_path / "private/secret.md")
    return tmp_path


def names(policy):
    return [rel for _, _, rel in policy.listing()]


def test_scope_denies_by_default(corpus):
    policy = ScopePolicy((corpus / "notes",), max_file_bytes=4000)
    assert names(policy) == ["LOUD.MD", "deep dir/nested.md", "map.md"]
    assert "clone/README.md" in names(ScopePolicy((corpus / "notes",), allow_repos=("clone",)))
    assert "clone/README.md" in names(ScopePolicy((corpus / "notes",), skip_nested_repos=False))
    assert "link.md" in names(ScopePolicy((corpus / "notes",), follow_symlinks=True))
    assert "deep dir/nested.md" not in names(ScopePolicy((corpus / "notes",), exclude=("deep*/*",)))
    assert names(ScopePolicy((corpus / "notes",), suffixes=(".MD",))) == []
    with pytest.raises(ScopeError):
        ScopePolicy(())


def test_scope_report_and_several_roots(corpus):
    report = ScopePolicy((corpus / "notes", corpus / "missing", corpus / "notes/map.md")).describe()
    assert report.file_count == 4 and [why for _, why in report.skipped] == ["does not exist", "not a directory"]
    policy = ScopePolicy((corpus / "notes", corpus / "private", corpus / "notes/deep dir"))
    assert "private/secret.md" in names(policy) and names(policy).count("notes/deep dir/nested.md") == 1


def test_documents(spark, corpus):
    policy = ScopePolicy((corpus / "notes",), max_file_bytes=4000)
    (corpus / "notes/map.md").write_bytes(b"# Caf\xc3\xa9 \xff\n")
    rows = {r["rel"]: r for r in discover(spark, policy, [("deep dir/*", "curated"), ("*.md", "upstream")]).collect()}
    assert {k: r["trust"] for k, r in rows.items()} == {"map.md": "upstream", "deep dir/nested.md": "curated", "LOUD.MD": "unknown"}
    assert rows["map.md"]["text"] == "# Café �\n" and len(rows["map.md"]["doc_id"]) == 16
    assert discover(spark, ScopePolicy((corpus / "missing",))).count() == 0


def test_globs(spark):
    rows = spark.createDataFrame([("a/b/c.md",), ("x.pem",), ("dist/y.md",), ("a/distant.md",)], "rel string")
    got = lambda p: [r[0] for r in rows.select(ingest.matches_glob(F.col("rel"), p)).collect()]
    assert got("a/*.md") == [True, False, False, True] and got("dist") == [False, False, True, False] and got("[xy].*") == [False, True, True, False]


def test_ingest_plan(spark):
    side = lambda rows: spark.createDataFrame(rows, "doc_id string, content_hash string")
    plan = ingest.plan(side([("a", "1"), ("b", "2"), ("c", "3")]), side([("b", "2"), ("c", "0"), ("d", "4")]))
    assert {r["doc_id"]: r["status"] for r in plan.collect()} == {"a": "added", "b": "unchanged", "c": "changed", "d": "removed"}
    assert ingest.plan(side([]), side([])).count() == 0


CONFIG = """
scope:
  default_profile: wide
  defaults: {{exclude: [drafts], suffixes: [md], max_file_bytes: 4000}}
  profiles:
    narrow: {{roots: [notes], exclude: deep dir}}
    wide: {{roots: notes, trust: {{default: authored}}}}
trust: {{rules: [{{match: '*.md', trust: Curated}}, {{match: '', trust: authored}}, {{match: x, trust: nope}}]}}
index: {{path: ./index}}
embeddings: {{provider: hashing, dim: {dim}}}
retrieval: {{candidates: 20}}
"""


def test_config(corpus):
    (corpus / "config.yaml").write_text(CONFIG.format(dim=64))
    known = catalogue(start=corpus)
    narrow, wide = resolve(known, "narrow"), resolve(known)
    assert tuple(known.profiles) == ("narrow", "wide") and wide.profile == known.default == "wide"
    assert narrow.scope.exclude == ("drafts", "deep dir") and narrow.scope.suffixes == (".md",)
    assert narrow.trust == ([("*.md", "curated")], "unknown") and wide.trust == ([], "authored")
    assert narrow.index_dir == corpus / "index/narrow" and wide.retrieval == {"candidates": 20}
    with pytest.raises(ConfigError, match="no profile"):
        resolve(known, "other")
    (corpus / "config.local.yaml").write_text("scope: {roots: [notes]}")
    assert tuple(catalogue(start=corpus).profiles) == ("default",)
    for body, words in (("scope: [1]", "mapping"), ("[1]", "top level"), ("a: [", "YAML"), ("scope: {}", "Nothing"), ("scope: {roots: [a], default_profile: b}", "not defined")):
        (corpus / "config.local.yaml").write_text(body)
        with pytest.raises(ConfigError, match=words):
            catalogue(start=corpus)
    with pytest.raises(ConfigError, match="not found"):
        catalogue(corpus / "none.yaml")
    with pytest.raises(ConfigError, match="no configuration"):
        catalogue(start=corpus / "notes")
    assert trust_rules(None) == ([], "unknown")


def test_index_life_cycle(spark, corpus):
    store, embedder = IndexStore(spark, str(corpus / "ix")), HashingEmbedder(64)
    documents = lambda: discover(spark, ScopePolicy((corpus / "notes",), max_file_bytes=4000))
    dry = engine.build(spark, store, documents(), embedder, dry_run=True)
    assert dry.added == 3 and store.current() is None
    first = engine.build(spark, store, documents(), embedder)
    assert (first.added, first.chunks_written, first.embedded) == (3, 4, 4)
    again = engine.build(spark, store, documents(), embedder)
    assert (again.unchanged, again.chunks_written, again.embedded) == (3, 0, 0)
    (corpus / "notes/map.md").write_text(f"# Map\n\nA whole new text about lighthouses and their lamps, nothing else.\n\n{LONG}")
    (corpus / "notes/LOUD.MD").unlink()
    third = engine.build(spark, store, documents(), embedder)
    assert (third.changed, third.removed, third.unchanged, third.embedded) == (1, 1, 1, 1)
    snapshot = store.current()
    ids = {r[0] for r in snapshot.table("chunks").select("chunk_id").collect()}
    for name in ("postings", "lengths", "vectors"):
        assert {r[0] for r in snapshot.table(name).select("chunk_id").collect()} == ids
    retriever = engine.Retriever(snapshot, embedder)
    asked = engine.question_frame(spark, ["lighthouse lamps", "", "zebra"])
    hits = retriever.search(asked, 5).collect()
    assert min((h["rank"], h["doc_rel"]) for h in hits if h["query_id"] == "q1")[1] == "map.md"
    assert not [h for h in hits if h["query_id"] == "q2"] and not [h for h in retriever.lexical(asked).collect() if h["query_id"] == "q3"]
    assert not engine.Retriever(snapshot, HashingEmbedder(32)).has_dense
    engine.build(spark, store, documents(), None)
    assert not engine.Retriever(store.current(), embedder).has_dense
    full = engine.build(spark, store, documents(), HashingEmbedder(32))
    assert full.embedded == 2 and full.unchanged == 2
    assert engine.build(spark, store, documents(), embedder, rebuild=True, dry_run=True).added == 2 and store.current().signature == "hashing:32"


def test_segments_equal_a_rebuilt_index(spark, tmp_path):
    """Runs that add, change, drop and bring back documents leave what one run over the last state writes."""
    store, fresh = IndexStore(spark, str(tmp_path / "ix")), IndexStore(spark, str(tmp_path / "fresh"))
    embedder = HashingEmbedder(16)

    def documents(texts):
        rows = [(f"d{k:02}", f"d{k:02}.md", t, str(hash(t)), "unknown", len(t)) for k, t in texts.items()]
        return spark.createDataFrame(rows, "doc_id string, rel string, text string, content_hash string, trust string, size long")

    first = {k: f"# Part {k}\n\n{LONG} It is number {k} of {k * k}." for k in range(40)}
    changed = {k: t.replace("compass", "sextant") if k == 3 else t for k, t in first.items() if k != 5}
    states = [first, first | {99: f"# New\n\n{LONG}"}, changed, changed | {5: first[5]}]
    segments = []
    for texts in states:
        engine.build(spark, store, documents(texts), embedder)
        segments.append([n for n, _ in store.current().meta["segments"]])
    assert segments == [[1], [1, 2], [1, 3], [1, 4]]  # a small segment goes into the next, the large one stays
    number = store.current().meta["snapshot"]
    assert engine.build(spark, store, documents(states[-1]), embedder).unchanged == 40 and store.current().meta["snapshot"] == number
    engine.build(spark, fresh, documents(states[-1]), embedder)
    both = store.current(), fresh.current()
    for name in ("documents", "chunks", "postings", "lengths", "terms", "corpus", "vectors"):
        got, want = (sorted(map(str, s.table(name).drop("indexed_at").toPandas().to_dict("records"))) for s in both)
        assert got == want, name
    assert sorted(p.name for p in (tmp_path / "ix").iterdir() if p.is_dir()) == [f"snapshot={n}" for n in (1, 3, 4)]
    engine.build(spark, store, documents(states[-1]), None)
    assert len(store.current().meta["segments"]) == 1 and store.current().table("vectors").isEmpty() and store.current().table("chunks").count() == 40


def test_command_line(spark, corpus, capsys):
    (corpus / "config.yaml").write_text(CONFIG.format(dim=64))
    (corpus / "questions.yaml").write_text("- {id: dev, question: deviation table of a vessel, relevant: [{doc: map.md, section: '5.3'}]}")
    run = lambda *a: (cli.main([a[0], "-c", str(corpus / "config.yaml"), *a[1:]]), capsys.readouterr())
    assert cli.main([]) == 2 and capsys.readouterr()
    assert run("scope", "--list-profiles")[1].out == "narrow\nwide  (default)\n"
    assert "     3  files" in run("scope", "--files")[1].out
    code, said = run("search", "deviation")
    assert code == 1 and "empty" in said.err
    assert run("index", "-p", "other")[0] == 1
    assert "dry run" in run("index", "--dry-run")[1].out
    assert "     4  chunks embedded" in run("index")[1].out
    assert "§5.3" in run("search", "deviation", "table", "--why", "--snippets")[1].out
    assert run("search", "deviation", "--dense")[0] == 0 and run("search", "deviation", "--lexical")[0] == 0
    assert "chunks" in run("chunks")[1].out and run("chunks", "--doc", "nope.md")[0] == 1
    code, said = run("eval", "-k", "5", "--save", str(corpus / "run.json"), "--per-question")
    assert code == 0 and "lexical" in said.out and json.loads((corpus / "run.json").read_text())["k"] == 5
    code, loaded = run("eval", "--load", str(corpus / "run.json"))
    assert code == 0 and [line for line in loaded.out.splitlines() if line.startswith("  lexical")] == [line for line in said.out.splitlines() if line.startswith("  lexical ")]
    assert run("eval", "--load", str(corpus / "run.json"), "--min-ndcg", "1.1")[0] == 1
    code, said = run("ask", "Which", "deviation", "table?", "--show-passages")
    assert code == 0 and "Sources:" in said.out and "P1" in said.out
    assert run("ask", "x", "--trust-floor", "golden")[0] == 1
    assert "vectors: 4 x 64" in run("stats")[1].out


def test_watch(spark, corpus):
    from corpusloom.streaming.watch import watch

    inbox = corpus / "inbox"
    tree(inbox, {"a.md": f"# A\n\n{LONG}", "skip.txt": "x"})
    store = IndexStore(spark, str(corpus / "watched"))
    stream = watch(spark, str(inbox), store, HashingEmbedder(16), str(corpus / "seen"))
    try:
        stream.processAllAvailable()
        tree(inbox, {"sub/b.md": f"# B\n\n{LONG}"})
        stream.processAllAvailable()
    finally:
        stream.stop()
    assert sorted(r["rel"] for r in store.current().table("documents").collect()) == ["a.md", "sub/b.md"]
    assert store.current().table("chunks").count() == 2
