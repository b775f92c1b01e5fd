"""Document fingerprints: an order-independent, additive multiset hash, all in DataFrame functions.

A text's paragraphs are the pieces between newlines.  Two vectors are summed over them:

* ``digest``: eight lanes modulo 2**32, each a seeded 64-bit hash half of the whole paragraph.  Texts with
  the same multiset of paragraphs have the same digest, whatever their order.
* ``sketch``: 128 lanes modulo 2**32.  Each paragraph is cut into slices of up to ``slice_chars`` code points (half as many
  in paragraphs of less than ``5 * slice_chars``); a lane counts the slices whose hash has a certain bit.  Taken as signs,
  lanes are random projections of the slice counts, so inner products estimate how much two texts share.

Likeness is an estimate: with 128 lanes its standard error is about 0.09 for texts that share little.  Slices start at
each paragraph's start, so an insertion changes all slices after it in its paragraph, and a text of one paragraph of one
or two slices can get a likeness near 0 to an edit that keeps three quarters of it.

Both are sums, so inserting or deleting a paragraph adds or subtracts its own vectors.

Edge cases: null texts count as empty; an empty text has one empty paragraph and no slices.  The order is by id (null
first), then by a hash of the text; rows that repeat an id and its text repeat their result, with the next other row as
their next.  An empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty

DIGEST_LANES, SKETCH_LANES = 8, 128
LOW32 = 0xFFFFFFFF
PAIR = 0x0000000100000001


def _hashes(paragraph: Column, piece: Column, place: Column) -> list[Column]:
    """Of a slice's row: ``g0``, ... for the digest, 0 but in a paragraph's first row; ``h0``, ... for the sketch, or null."""
    first = place.isNull() | (place == 0)
    whole = [F.when(first, F.xxhash64(paragraph, F.lit(seed))).otherwise(F.lit(0)).alias(f"g{seed}") for seed in range(DIGEST_LANES // 2)]
    return [*whole, *[F.when(piece.isNotNull(), F.xxhash64(piece, F.lit(seed))).alias(f"h{seed}") for seed in range(SKETCH_LANES // 64)]]


def _lane_sums() -> list[Column]:
    """Sums of the lanes; of the sketch's, two 32-bit lanes are packed in a long."""
    sums = []
    for seed in range(DIGEST_LANES // 2):
        sums.append(F.sum(F.col(f"g{seed}").bitwiseAND(F.lit(LOW32))).alias(f"d{2 * seed}"))
        sums.append(F.sum(F.shiftrightunsigned(f"g{seed}", 32)).alias(f"d{2 * seed + 1}"))
    for bit in range(SKETCH_LANES // 2):
        packed = F.shiftrightunsigned(f"h{bit // 32}", bit % 32).bitwiseAND(F.lit(PAIR))
        sums.append(F.coalesce(F.sum(packed), F.lit(0)).alias(f"s{bit}"))
    sums.append(F.count("h0").alias("slices"))
    return sums


def fingerprints(texts: DataFrame, keys: list[str], text_col: str, slice_chars: int = 32) -> DataFrame:
    """``keys, digest array<long>, sketch array<int>, slices`` of each row of ``texts``; keys must be unique."""
    cut = lambda n: F.regexp_extract_all("paragraph", F.lit(r"[^\n]{1,%d}" % n), F.lit(0))
    pieces = F.when(F.length("paragraph") < 5 * slice_chars, cut(max(1, slice_chars // 2))).otherwise(cut(slice_chars))
    rows = (
        texts.select(*keys, F.explode(F.split(F.col(text_col), "\n", -1)).alias("paragraph"))
        .select(*keys, "paragraph", F.posexplode_outer(pieces).alias("place", "piece"))
        .select(*keys, *_hashes(F.col("paragraph"), F.col("piece"), F.col("place")))
        .groupBy(*keys)
        .agg(*_lane_sums())
    )
    digest = F.array(*[F.pmod(F.col(f"d{i}"), F.lit(1 << 32)) for i in range(DIGEST_LANES)])
    half = SKETCH_LANES // 2
    as_int = lambda c: F.when(c > LOW32 // 2, c - (1 << 32)).otherwise(c).cast("int")  # noqa: E731  the same 32 bits
    low = [F.col(f"s{i}").bitwiseAND(F.lit(LOW32)) for i in range(half)]
    high = [F.shiftrightunsigned(f"s{i}", 32) for i in range(half)]
    return rows.select(*keys, digest.alias("digest"), F.transform(F.array(*low, *high), as_int).alias("sketch"), "slices")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The digest or sketch after adding (sign 1) or removing (sign -1) a part's vector."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x.cast("long") + sign * y, F.lit(1 << 32)))


def likeness(sketch_a: Column, n_a: Column, sketch_b: Column, n_b: Column) -> Column:
    """Estimate of 2<a,b> / (|a|^2 + |b|^2) over slice counts, cut to 0..1; 1 for equal sketches."""
    signs = lambda s, n: F.transform(s, lambda c: 2 * c.cast("double") - n)
    a, b = signs(sketch_a, n_a), signs(sketch_b, n_b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = dot(a, a) + dot(b, b)
    return F.when(norm > 0, F.least(F.greatest(2 * dot(a, b) / norm, F.lit(0.0)), F.lit(1.0))).otherwise((n_a == n_b).cast("double"))


def as_hex(digest: Column, sketch: Column) -> Column:
    words = F.concat(digest, F.transform(sketch, lambda x: x.cast("long").bitwiseAND(F.lit(LOW32))))
    lanes = F.transform(words, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    return F.array_join(lanes, "")


def _order(keys: DataFrame, rows: int) -> DataFrame:
    """``k, h, doc_id, n`` with ``next_k, next_h``: the next by id, then hash of the text; the first after the last.

    Keys are dealt into ranges of the id, as many as their number asks for, at most 4096; ids that take several ranges'
    share, and nulls, are dealt out further by the top byte of the hash.  Only keys are sorted, no texts.
    """
    parts = max(2, min(4096, rows // 50_000))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = keys.agg(F.percentile_approx("doc_id", shares, F.lit(10 * parts)).alias("q")).first()["q"] or []
    bounds, hot = sorted(set(found)), [b for b, times in Counter(found).items() if times > 1]
    top = F.shiftright("h", 56) + 128
    crowded = F.col("doc_id").isin(hot) if hot else F.lit(False)
    place = F.when(F.col("doc_id").isNull(), top - 512).otherwise(_bucket(F.col("doc_id"), bounds) * 512 + F.when(crowded, top).otherwise(F.lit(256)))
    placed = keys.select("k", "h", "doc_id", "n", place.alias("place"), F.struct("doc_id", "h", "k").alias("key"))
    everything = Window.orderBy("place")  # a row for each range and top byte
    firsts = placed.groupBy("place").agg(F.min("key").alias("first"))
    begin = F.first("first").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("place", F.coalesce(F.lead("first").over(everything), begin).alias("after"))
    order = Window.partitionBy("place").orderBy("key")
    led = placed.withColumn("lead", F.lead("key").over(order)).join(F.broadcast(firsts), "place")
    after = F.coalesce("lead", "after")
    return led.select("k", "h", "doc_id", "n", after["k"].alias("next_k"), after["h"].alias("next_h"))


def _bucket(id_col: Column, bounds: list[int], fan: int = 64) -> Column:
    """How many bounds are <= id, found through a two-level list."""
    if not bounds:
        return F.lit(0)
    groups = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
    below = lambda arr: F.size(F.filter(arr, lambda b: b <= id_col))
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    top = below(heads)
    return F.coalesce(F.when(top > 0, (top - 1) * fan + below(F.element_at(fine, top))).otherwise(F.lit(0)), F.lit(0))


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edit_share: int = 4, slice_chars: int = 32) -> DataFrame:
    """Fingerprints of each text and of its edit by the next document in ascending id, with their likeness.

    The order is found from ids, hashes and lengths alone.  Texts are shuffled once, by two hashes of id and text; of a next
    text only the part that the edit takes is sent on, and of fingerprints the sketches.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    key = [F.xxhash64("doc_id", "text").alias("k"), F.xxhash64("text").alias("h")]
    texts = named.select(*key, "text")
    keys = stage(named.select(*key, "doc_id", F.length("text").alias("n")).distinct(), "fp-keys")
    order = stage(_order(keys, keys.count()), "fp-order")

    # Both joins take the texts by the same key and columns, so that they share one exchange.
    taken = F.floor(F.col("n") / edit_share).cast("int")
    sent = order.select("next_k", "next_h", F.col("k").alias("to_k"), F.col("h").alias("to_h"), "doc_id", "n")
    heads = texts.join(sent, (texts["k"] == sent["next_k"]) & (texts["h"] == sent["next_h"]))
    heads = heads.select("to_k", "to_h", "next_k", "next_h", "doc_id", "n", F.substring("text", F.lit(1), taken).alias("head")).dropDuplicates(["to_k", "to_h"])
    edited = texts.join(heads, (texts["k"] == heads["to_k"]) & (texts["h"] == heads["to_h"]))
    whole = F.concat(F.substring("text", F.lit(1), F.col("n") - taken), "head")
    # Rows that repeat an id and its text have a number to be told apart by.
    by = ["k", "h", "row", "doc_id", "n", "next_k", "next_h"]
    edited = edited.select("k", "h", F.monotonically_increasing_id().alias("row"), *by[3:], "text", whole.alias("edited"))
    bodies = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))
    rows = edited.select(*by, F.sha2("edited", 256).alias("edited_sha256"), F.explode(bodies).alias("v"))
    by.append("edited_sha256")
    prints = fingerprints(rows.select(*by, "v.which", "v.body"), [*by, "which"], "body", slice_chars)
    vector = F.struct("digest", "sketch", "slices")
    both = prints.groupBy(*by).agg(F.max(F.when(F.col("which") == 0, vector)).alias("own"), F.max(F.when(F.col("which") == 1, vector)).alias("edit"))
    done = stage(both, "fp-prints")
    theirs = done.select(F.col("k").alias("their_k"), F.col("h").alias("their_h"), F.struct("own.sketch", "own.slices").alias("next")).dropDuplicates(["their_k", "their_h"])
    beside = done.join(theirs, (F.col("next_k") == F.col("their_k")) & (F.col("next_h") == F.col("their_h")))
    like = lambda a, b: likeness(F.col(f"{a}.sketch"), F.col(f"{a}.slices"), F.col(f"{b}.sketch"), F.col(f"{b}.slices"))
    return beside.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", as_hex(F.col("own.digest"), F.col("own.sketch")).alias("fingerprint"),
        as_hex(F.col("edit.digest"), F.col("edit.sketch")).alias("edited_fingerprint"), like("own", "edit").alias("near_edited"), like("own", "next").alias("near_next"),
    )


def oracle() -> str:
    """Lengths and edits in DuckDB SQL, for ids that are not repeated."""
    return """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
led AS (SELECT doc_id, t, length(t) // 4 AS cut, coalesce(lead(t) OVER (ORDER BY doc_id), first(t) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS following FROM texts)
SELECT doc_id, length(t) AS n_chars, sha256(concat(substr(t, 1, length(t) - cut), substr(following, 1, cut))) AS edited_sha256 FROM led"""
