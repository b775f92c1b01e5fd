"""Column functions over text.  All are built-in expressions; word classes are Unicode, as patterns spell out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that a query drops unless it has nothing else.
STOPWORDS = (
    "a", "about", "again", "all", "am", "an", "and", "any", "are", "at", "be", "been", "being", "both", "but", "by", "can", "did", "do",
    "does", "doing", "done", "each", "few", "for", "from", "had", "has", "have", "having", "how", "i", "if", "in", "into", "is", "it",
    "its", "just", "me", "more", "most", "my", "no", "nor", "not", "now", "of", "on", "only", "or", "other", "our", "over", "own", "same",
    "should", "so", "some", "such", "than", "that", "the", "then", "these", "this", "those", "to", "too", "under", "very", "was", "we",
    "were", "what", "when", "where", "which", "who", "whom", "whose", "why", "will", "with", "you", "your",
)
# Shortest query term kept; length of a citation segment; markup and notes cut from headings.
MIN_TERM = 2
SEGMENT = 48
INLINE_MARKUP = r"\*\*|__|~~|\*|_|`"
DATED_NOTE = r"(?i)\s*\([^)]*\b(?:added|flattened|deferred|revised|resolved|updated)\b[^)]*\)\s*$"
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+\S.*$"
CITED_PATH = r"[\p{L}\p{N}_./\-]+\.(?:md|markdown)(?:\s+§[\d.]+)?"
# A token of the index; a word of a query (which may hold several tokens).
TOKEN = r"[\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}_]+"


def words(c: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def index_tokens(c: Column) -> Column:
    """Lower-cased letter and digit runs, in order, repeats kept; null text has none."""
    return words(F.lower(F.coalesce(c, F.lit(""))))


def query_words(c: Column) -> Column:
    """Words of two characters or more that are no stopwords; all words if none is left.  Repeats are kept."""
    found = words(F.coalesce(c, F.lit("")), WORD)
    telling = F.filter(found, lambda w: (F.length(w) >= MIN_TERM) & ~F.lower(w).isin(*STOPWORDS))
    return F.when(F.size(telling) > 0, telling).otherwise(found)


def match_expression(c: Column) -> Column:
    """The words quoted and joined by OR, as full-text engines spell a safe query; empty for a blank query."""
    return F.array_join(F.transform(query_words(c), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def snippet(c: Column, width: int = 160) -> Column:
    body = flat(c)
    return F.when(F.length(body) > width, F.concat(F.rtrim(F.substring(body, 1, width - 1)), F.lit("…"))).otherwise(body)


def section_ref(title: Column) -> Column:
    found = F.regexp_extract(title, NUMBERED, 1)
    return F.when(found != "", found)


def clean_heading(title: Column) -> Column:
    body = flat(F.regexp_replace(F.regexp_replace(title, INLINE_MARKUP, ""), DATED_NOTE, ""))
    return F.when(F.length(body) > SEGMENT, F.concat(F.rtrim(F.substring(body, 1, SEGMENT - 1)), F.lit("…"))).otherwise(body)


def citation(rel: Column, ref: Column, path: Column, part: Column, parts: Column) -> Column:
    """``rel §ref``, else ``rel > headings below the first``, else ``rel``; `` (part/parts)`` if the section was split."""
    inner = F.filter(F.transform(F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), clean_heading), lambda h: h != "")
    base = F.when(ref.isNotNull(), F.concat(rel, F.lit(" §"), ref)).when(F.size(inner) > 0, F.concat(rel, F.lit(" > "), F.array_join(inner, " > "))).otherwise(rel)
    return F.when(parts > 1, F.concat(base, F.lit(" ("), (part + 1).cast("string"), F.lit("/"), parts.cast("string"), F.lit(")"))).otherwise(base)


def heading_path(c: Column) -> Column:
    """A heading path from its JSON; empty if that is null, broken or no list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def sentences(c: Column) -> Column:
    return F.filter(F.split(flat(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def term_set(c: Column, longer_than: int = 0) -> Column:
    found = F.array_distinct(words(F.lower(c), WORD))
    return F.filter(found, lambda w: F.length(w) > longer_than) if longer_than else found


def cited_paths(c: Column) -> Column:
    """What looks like a citation in a text, in order, repeats dropped, closing punctuation cut."""
    return F.array_distinct(F.transform(words(c, CITED_PATH), lambda w: F.regexp_replace(w, r"[.,;:]+$", "")))
