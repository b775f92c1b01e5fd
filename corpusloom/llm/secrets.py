"""Secret scan: fixed patterns plus sliding-window entropy, all in DataFrame functions.

Entropy is measured in windows over what is left of a long run outside the patterns' spans and outside what is allowed.
An allowed pattern that is a part of a run (``example``) clears the path segment around it, up to the next slashes; one
that is bound to both ends clears the whole.  What is left shorter than a window is not measured.

All steps take time in proportion to the text: positions are running sums, and what the patterns found is hidden from the
candidates by moving its characters to a private plane (U+F0020 to U+F007E, which a text is taken not to use).

Edge cases: a null or empty text has no spans (``base_sha256`` is the hash of an empty string); very long texts and runs
are measured whole.
Rows are judged one by one, so ties and repeated rows repeat their result; other input columns
are ignored.  Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# The base patterns, the guard that a text must pass first, and which group has to be how long.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GUARD = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: What looks random to the measure but is known to be harmless.
ALLOW = (
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[=_+/-]+$",
    r"(?i)example|placeholder|changeme|dummy|sample|lorem",
    r"^[A-Za-z]+([_/-][A-Za-z]+)*$",
    r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
)
#: Printable ASCII, and where it is moved to hide it; a hidden character counts in a pattern like the one it was.
PRINTABLE = "".join(map(chr, range(0x20, 0x7F)))
HIDDEN = "".join(chr(0xF0000 + ord(c)) for c in PRINTABLE)
VEIL = f"[{HIDDEN[0]}-{HIDDEN[-1]}]"
VEILED_HEX = "[0-9a-f{}-{}{}-{}]{{16,}}".format(*(chr(0xF0000 + ord(c)) for c in "09af"))
VEILED_ACCESS = "".join(f"[{c}{chr(0xF0000 + ord(c))}]" for c in "AKIA") + "[A-Z0-9{}-{}{}-{}]{{14,}}".format(*(chr(0xF0000 + ord(c)) for c in "AZ09"))
KINDS = ("assign", "access", "hex", "entropy")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(items: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """For each item what ``step(state, item)`` has come to before it, from 0.  Arrays grow within blocks and then by
    blocks, so the time is in proportion to the items."""
    none = F.expr("cast(array() as array<int>)")

    def within(at: Column, part: Column) -> Column:
        grow = lambda state, x: F.struct(step(state["at"], x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), grow)

    def whole(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_) / block).cast("int") - 1, F.lit(0)))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("out"))

        def put(state: Column, i: Column) -> Column:
            done = within(state["at"], F.slice(all_, i * block + 1, F.lit(block)))
            return _bind(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(d["out"])).alias("out")))

        return F.aggregate(numbers, start, put, lambda state: F.flatten(state["out"]))

    return _bind(items, whole)


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with the text before and after each: array<struct<gap, m, next>>."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = _bind(pieces, lambda p: F.zip_with(F.zip_with(p, found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m"))), F.slice(p, 2, F.size(p)), lambda x, n: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), n.alias("next"))))
    return F.filter(pairs, lambda x: x["m"].isNotNull())


def _placed(matches: Column, kind: int, more: Callable[[Column], list[Column]] = lambda x: []) -> Column:
    """array<struct<s, k, e, m, ...>>: gaps and matches add up to the positions."""

    def place(x: Column, at: Column) -> Column:
        begin = at + F.length(x["gap"])
        return F.struct(begin.alias("s"), F.lit(kind).alias("k"), (begin + F.length(x["m"])).alias("e"), x["m"].alias("m"), *more(x))

    return _bind(matches, lambda all_: F.zip_with(all_, _running(all_, lambda at, x: at + F.length(x["gap"]) + F.length(x["m"])), place))


def _spans(text: Column, guard: Column, pattern: str, kind: int) -> Column:
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int,m:string>>)")
    return F.when(guard, _placed(_matches(text, pattern), kind)).otherwise(none)


def _replaced(text: Column, guard: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """``text`` with each match m replaced by ``new(m)``."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.array_join(F.zip_with(pieces, found, lambda gap, m: F.concat(gap, F.when(m.isNotNull(), new(m)).otherwise(F.lit("")))), "")
    return F.when(guard, joined).otherwise(text)


def _hidden(m: Column) -> Column:
    return F.translate(m, PRINTABLE, HIDDEN)


def _window_hits(candidate: Column, window: int, hex_bits: float, mixed_bits: float) -> Column:
    """struct<first, last>: starts of the first and last window over the class's threshold, or nulls.

    The counts by character change by one character in and one out per step, and so does the sum of
    c*log2(c), from which the entropy is log2(w) - sum / w.
    """
    bits_each = (window + 1).bit_length()
    per_long = 62 // bits_each
    longs = len(ALPHABET) // per_long + 1

    def located(ch: Column) -> Column:
        """Where the count of a character is: the long, and its lowest bit."""
        code = F.instr(F.lit(ALPHABET), ch)
        return F.struct(F.floor(code / per_long).cast("int").alias("w"), (code % per_long * bits_each).cast("int").alias("b"))

    # Each character beside the one that leaves the window when it enters.
    codes = F.transform(F.split(candidate, ""), located)
    first_out = F.array_repeat(F.struct(F.lit(0).alias("w"), F.lit(0).alias("b")), window)
    steps = _bind(codes, lambda all_: F.slice(F.zip_with(all_, F.concat(first_out, all_), lambda c, o: F.struct(c.alias("in"), o.alias("out"))), F.lit(1), F.size(all_)))
    plogp = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    bits = F.when(candidate.rlike("^[0-9A-Fa-f]+$"), F.lit(hex_bits)).otherwise(F.lit(mixed_bits))
    zero = F.struct(
        F.array_repeat(F.lit(0).cast("long"), longs).alias("n"), F.lit(0.0).alias("s"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )
    shift = lambda name, value, by: F.call_function(name, value, by)
    count = lambda n, at: shift("shiftright", F.element_at(n, at["w"] + 1), at["b"]).bitwiseAND(F.lit((1 << bits_each) - 1)).cast("int")
    one = lambda at, j: F.when(j == at["w"], shift("shiftleft", F.lit(1).cast("long"), at["b"])).otherwise(F.lit(0).cast("long"))
    term = lambda c: F.element_at(plogp, c + 1)

    def put(state: Column, item: Column) -> Column:
        full, entering, leaving = item["i"] >= window, item["in"], item["out"]
        begin = item["i"] - (window - 1)

        def change(v: Column) -> Column:
            s = state["s"] - term(v["have"]) + term(v["have"] + 1) + F.when(full, term(v["gone"] - 1) - term(v["gone"])).otherwise(0.0)
            return _bind(s, lambda s: judged(s, F.transform(state["n"], lambda c, j: c + one(entering, j) - F.when(full, one(leaving, j)).otherwise(F.lit(0).cast("long")))))

        def judged(s: Column, n: Column) -> Column:
            hit = (begin >= 0) & (s / window <= item["limit"])
            return F.struct(
                n.alias("n"), s.alias("s"),
                F.when(hit, F.coalesce(state["first"], begin)).otherwise(state["first"]).alias("first"),
                F.when(hit, begin).otherwise(state["last"]).alias("last"),
            )

        counts = F.struct(count(state["n"], entering).alias("have"), (count(state["n"], leaving) + (entering == leaving).cast("int")).alias("gone"))
        return _bind(counts, change)

    def judge(limit: Column) -> Column:
        numbered = F.transform(steps, lambda x, i: F.struct(i.alias("i"), x["in"].alias("in"), x["out"].alias("out"), limit.alias("limit")))
        return F.aggregate(numbered, zero, put, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return _bind(F.lit(math.log2(window)) - bits, judge)


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_value: int = 12,
    window: int = 20,
    hex_bits: float = 3.0,
    mixed_bits: float = 3.8,
    allow: Sequence[str] = ALLOW,
) -> DataFrame:
    """``doc_id, text, spans`` with spans an array of ``(s, k, e, m)`` by start, then kind; k indexes KINDS."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    text = F.col("text")
    assign = _spans(text, text.rlike(ASSIGN_GUARD), ASSIGN, 0)
    value = lambda x: F.regexp_extract(x["m"], ASSIGN, 2)
    likes = lambda m: F.reduce(F.array(*[F.lit(p) for p in allow]), F.lit(False), lambda a, p: a | F.regexp_like(m, p)) if allow else F.lit(False)
    segments = r"(?<![^/])[^/]*(?:%s)[^/]*" % "|".join(f"(?:{p})" for p in allow)
    run = r"[A-Za-z0-9+/_=-]{%d,}" % window
    ends = F.lit("=_+/-")
    first = base.select(
        "doc_id", "text",
        F.array_sort(F.concat(
            F.filter(assign, lambda x: F.length(value(x)) >= min_value),
            _spans(text, F.contains(text, F.lit("AKIA")), ACCESS, 1),
            _spans(text, text.rlike(HEX), HEX, 2),
        )).alias("base"),
        text.rlike(run).alias("has_runs"),
    )
    some = F.size("base") > 0
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= min_value
    veiled = _replaced(text, some & text.rlike(ASSIGN_GUARD), ASSIGN, lambda m: F.when(long_value(m), _hidden(m)).otherwise(m))
    veiled = _replaced(veiled, some & F.contains(text, F.lit("AKIA")), VEILED_ACCESS, _hidden)
    veiled = _replaced(veiled, some & text.rlike(HEX), VEILED_HEX, _hidden)
    at_edge = lambda x: [(F.right(x["gap"], F.lit(1)).rlike(VEIL) | F.left(x["next"], F.lit(1)).rlike(VEIL)).alias("cut")]
    first = first.select("doc_id", "text", "base", "has_runs", F.when(F.col("has_runs"), veiled).alias("veiled"))
    first = first.select("doc_id", "text", "base", F.when(F.col("has_runs"), _placed(_matches(F.col("veiled"), run), 3, at_edge)).alias("cand"))

    def allowed_apart(x: Column) -> Column:
        """What is left of run x outside the segments that hold something allowed, in pieces of a window at least."""
        core = F.when(x["cut"], F.trim(x["m"], ends)).otherwise(x["m"])
        lead = F.when(x["cut"], F.length(x["m"]) - F.length(F.ltrim(x["m"], ends))).otherwise(F.lit(0))
        blank = _replaced(core, F.lit(True), segments, lambda m: F.repeat(F.lit(" "), F.length(m)))
        blank = F.concat(F.left(x["m"], lead), blank, F.right(x["m"], F.length(x["m"]) - lead - F.length(core)))
        pieces = F.filter(_placed(_matches(blank, run), 3), lambda y: ~likes(F.trim(y["m"], ends)))
        moved = F.transform(pieces, lambda y: F.struct((y["s"] + x["s"]).alias("s"), y["k"].alias("k"), y["m"].alias("m")))
        return F.when(likes(core), moved).otherwise(F.array(F.struct(x["s"].alias("s"), x["k"].alias("k"), x["m"].alias("m"))))

    def entropy(x: Column) -> Column:
        w = _window_hits(x["m"], window, hex_bits, mixed_bits)
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["m"].alias("m"), w.alias("w"))

    def cut(x: Column) -> Column:
        begin, end = x["s"] + x["w"]["first"], x["s"] + x["w"]["last"] + window
        return F.struct(begin.alias("s"), x["k"].alias("k"), end.alias("e"), F.substring(x["m"], x["w"]["first"] + 1, end - begin).alias("m"))

    runs = F.flatten(F.transform("cand", allowed_apart)) if allow else F.transform("cand", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["m"].alias("m")))
    first = first.select("doc_id", "text", "base", F.when(F.size("cand") > 0, runs).alias("cand"))
    added = F.when(F.size("cand") > 0, F.transform(F.filter(F.transform("cand", entropy), lambda x: x["w"]["first"].isNotNull()), cut))
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int,m:string>>)")
    return first.select("doc_id", "text", "base", F.array_sort(F.concat("base", F.coalesce(added, none))).alias("spans"))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_digest(docs: DataFrame, **options) -> DataFrame:
    """The registered query's columns: counts by kind, hash of the base spans, all spans."""
    found = scan_secrets(docs, **options)
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), count(3).alias("n_entropy"),
    )


def redact(docs: DataFrame, *, mark: str = "[SECRET]", text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; spans that overlap are replaced by one.

    All columns of ``docs`` stay; a null text stays null.
    """
    payload = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # The scan reads two columns by name; the rest of the row travels in one struct beside them.
    keyed = docs.select(payload.alias("doc_id"), F.col(text_col).alias("text"))
    found = scan_secrets(keyed, id_col="doc_id", text_col="text", **options)
    # A span that begins before the end of those before it only lengthens the gap's start.
    upto = _bind(F.col("spans"), lambda all_: F.zip_with(all_, _running(all_, lambda at, x: F.greatest(at, x["e"])), lambda x, at: F.struct(x["s"].alias("s"), at.alias("at"))))
    apart = F.filter(upto, lambda x: x["s"] >= x["at"])
    part = lambda chars, begin, end: F.array_join(F.slice(chars, begin + 1, F.greatest(end - begin, F.lit(0))), "")
    head = lambda chars: F.array_join(F.transform(apart, lambda x: F.concat(part(chars, x["at"], x["s"]), F.lit(mark))), "")
    tail = lambda chars: part(chars, F.array_max(F.transform("spans", lambda x: x["e"])), F.size(chars))
    clean = _bind(F.split(F.col("text"), ""), lambda chars: F.concat(head(chars), tail(chars)))
    new = F.when(F.size("spans") > 0, clean).otherwise(F.col("doc_id")[text_col])
    return found.select("doc_id", new.alias("new_text")).select(
        *[F.col("new_text").alias(text_col) if c == text_col else F.col("doc_id")[c].alias(c) for c in docs.columns]
    )


def oracle(min_value: int = 12) -> str:
    """The base spans in DuckDB SQL: matches and the text between them add up to the positions."""
    assign = r"(?:password|passwd|secret|token|api_?key)"
    patterns = ((rf"""(?i:{assign})["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""), ACCESS, HEX)
    value = rf"""regexp_extract(m, '(?i:{assign})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)"""
    found = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, t, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gaps FROM texts" for k, p in enumerate(patterns))
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
rows AS (SELECT doc_id, k, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM found WHERE len(ms) > 0),
placed AS (SELECT doc_id, k, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM rows),
spans AS (SELECT doc_id, k, e - length(m) AS s, e FROM placed WHERE k != 0 OR length({value}) >= {min_value}),
joined AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM texts LEFT JOIN joined USING (doc_id)"""
