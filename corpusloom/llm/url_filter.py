"""URL filter: host/path rules first, then a weighted vocabulary matched by Aho-Corasick.

Edge cases: a null URL or one without ``://`` has an empty host and path, matches no rule and is
judged by the vocabulary alone (null: no hits, so ``allow``).  Rows are judged independently, so
repeated rows repeat their verdict, an empty table gives an empty result, and other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower

# The default vocabulary.
STRICT_TERMS = (
    "casino", "porn", "xxx", "viagra", "cialis", "escort", "hentai", "phishing", "malware", "warez",
)
SOFT_TERMS = (
    "cheap", "pills", "spam", "farm", "free", "bonus", "deal", "deals", "win", "winner", "prize", "loan", "loans",
    "bet", "bets", "betting", "ads", "track", "poker", "slots", "adult", "dating", "sex", "replica", "discount", "download", "crack", "torrent",
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules of the registered query.
DEFAULT_RULES = (
    Rule("allow", "org"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


class Vocabulary:
    """Aho-Corasick over all terms; a hit counts only where no letter or digit adjoins it."""

    def __init__(self, strict: Sequence[str], soft: Sequence[str]):
        self.automaton = ahocorasick.Automaton()
        for term in soft:
            self.automaton.add_word(term, (term, False))
        for term in strict:
            self.automaton.add_word(term, (term, True))
        self.empty = len(self.automaton) == 0
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        strict: set[str] = set()
        soft: set[str] = set()
        if self.empty:
            return strict, soft
        for end, (term, is_strict) in self.automaton.iter(url):
            start = end - len(term) + 1
            if (start and _inside(url[start - 1])) or (end + 1 < len(url) and _inside(url[end + 1])):
                continue
            (strict if is_strict else soft).add(term)
        return strict, soft


def _inside(ch: str) -> bool:
    return "a" <= ch <= "z" or "0" <= ch <= "9"


class RuleBook:
    """Rules by host; a URL asks for each suffix of its host, so cost does not grow with the rules."""

    def __init__(self, rules: Sequence[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in rules:
            self.by_host.setdefault(rule.host, []).append(rule)
        for own in self.by_host.values():
            own.sort(key=lambda r: -len(r.path))

    def best(self, host: str, path: str) -> Rule | None:
        """The longest fitting rule (host and path together; the longer host on a tie)."""
        found, at = None, 0
        while at >= 0:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule.path):
                    if found is None or len(rule.text) > len(found.text):
                        found = rule
                    break
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return found


def filter_urls(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[Rule] = DEFAULT_RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    min_soft: int = 2,
) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict, n_strict, n_soft``.

    Rules and vocabulary are parameters held in each worker (they don't grow with the pages); the
    plan is a single pass over two columns without a shuffle.
    """
    rest = F.expr(f"substring({url_col}, instr({url_col}, '://') + 3)")
    has = F.instr(url_col, "://") > 0
    parsed = pages.select(
        F.col(id_col).alias("page_id"),
        F.when(has, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("").alias("host"),
        F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("").alias("path"),
        ascii_lower(F.coalesce(F.col(url_col), F.lit(""))).alias("url"),
    )
    rules, strict, soft = tuple(rules), tuple(strict), tuple(soft)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, words = RuleBook(rules), Vocabulary(strict, soft)
        for batch in batches:
            rule_text, verdicts, n_strict, n_soft = [], [], [], []
            for host, path, url in zip(batch["host"], batch["path"], batch["url"], strict=True):
                rule = book.best(host, path)
                hard, mild = words.hits(url)
                rule_text.append(rule.text if rule else None)
                bad = bool(hard) or len(mild) >= min_soft
                verdicts.append(rule.verdict if rule else "block" if bad else "allow")
                n_strict.append(len(hard))
                n_soft.append(len(mild))
            yield batch[["page_id", "host", "path"]].assign(rule=rule_text, verdict=verdicts, n_strict=n_strict, n_soft=n_soft)

    kind = parsed.schema["page_id"].dataType.simpleString()
    return parsed.mapInPandas(judge, f"page_id {kind}, host string, path string, rule string, verdict string, n_strict long, n_soft long")


def oracle(rules: Sequence[Rule] = DEFAULT_RULES, strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, min_soft: int = 2) -> str:
    """The same in DuckDB SQL, for the default parameters."""

    def count(terms: Sequence[str]) -> str:
        return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in terms)

    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host)))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.text}'" for f, r in zip(fits, ordered, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in ordered)
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
q AS (SELECT page_id, u, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r AS (SELECT *, {rule} AS rule, {count(strict)} AS n_strict, {count(soft)} AS n_soft FROM q)
SELECT page_id, host, path, rule, {verdict} WHEN n_strict > 0 OR n_soft >= {min_soft} THEN 'block' ELSE 'allow' END AS verdict,
    n_strict, n_soft FROM r"""
