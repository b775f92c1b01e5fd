"""The sections of Markdown documents in SQL functions: ``chunking.section_rows`` without Python workers.

A text becomes an array of lines.  Fenced code is found by one pattern over the joined lines, whose back-references tie a closing
fence to the one that it closes; what lies between matches is the rest, so each line is known to be code or not.
Headings are told by a line and its successor, as one letter a line; of underlined ones in a row every second is the
underline of the one before, which a replacement of pairs settles.  A fold over the headings keeps the last heading of each
of the six levels, that is, those which a section lies under; it goes block by block, since it copies its list for each
heading.  Nothing is shuffled, and the work is in proportion to the text.

Edge cases: a null or blank text has no sections; front matter that is never closed is text, and a fence that is never closed
reaches to the end; ``min_chars`` counts a section's own text without surrounding blanks.  Rows with repeated or null ids
each have sections of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import section_ref
from .chunking import MIN_CHARS

# What ends a line, besides a pair of return and line end, and the other blanks.
LINE_END = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
BLANK = r"[\t\x1f\x20\xa0  -   　]"
FENCED = rf"(?m)^{BLANK}{{0,3}}((`|~)\2{{2,}}+)[^\n]*$[\s\S]*?(?:^{BLANK}{{0,3}}\1\2*+{BLANK}*$|\z)"
ATX = rf"^(#{{1,6}}){BLANK}+(.*?){BLANK}*#*{BLANK}*$"
UNDERLINE = rf"^(?:=+|-{{2,}}){BLANK}*$"
NO_UNDERLINE = rf"^{BLANK}*(?:[-*+>]{BLANK}|\p{{Nd}}+[.)]{BLANK}|#|\||$)"
SPACE = BLANK[:-1] + r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(SPACE, c))
LEVELS = 6
BLOCK = 128


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _stripped(expression: str) -> str:
    """Without surrounding blanks; trimmed from both ends, since a pattern would go through the whole text."""
    return f"trim(BOTH '{''.join(f'\\u{ord(c):04x}' for c in SPACES)}' FROM {expression})"


def _once(sql: str) -> str:
    """``sql`` with the columns of earlier steps as fields of one variable: else the optimizer may put what makes a column
    into a function over elements, to be made again for each of them."""
    names = sorted(set(re.findall(r"(?<![A-Za-z0-9_.])_[a-z]+", sql)))
    fields = ", ".join(f"'{n[1:]}', {n}" for n in names)
    body = re.sub(r"(?<![A-Za-z0-9_.])_([a-z]+)", r"v.\1", sql)
    return f"transform(array(named_struct({fields})), v -> {body})[0]" if names else sql


def _with_sections(documents: DataFrame, text_col: str = "text", *, min_chars: int = MIN_CHARS) -> DataFrame:
    """``documents`` with ``sections``, an array of (ordinal, level, title, body, start_line, end_line, above); ``above`` lists
    (ordinal, title, gives) of the headings over a section, outermost first; ``gives`` is whether their own text is
    long enough for a chunk."""
    step = documents
    last_empty = lambda a: f"if(size({a}) > 0 AND element_at({a}, -1) = '', slice({a}, 1, size({a}) - 1), {a})"
    add = lambda **columns: columns.items()
    steps = [
        *add(_all=f"split(replace(coalesce(`{text_col}`, ''), '\r\n', '\n'), {_quoted(LINE_END)})"),
        *add(_all=last_empty("_all")),
        # The line that closes the front matter, counted from 1; 0 without one.
        *add(_cut=f"if(size(_all) > 0 AND {_stripped('_all[0]')} = '---', coalesce(array_position(transform(slice(_all, 2, size(_all)), x -> {_stripped('x')} IN ('---', '...')), true), 0), 0)"),
        *add(_cut="if(_cut > 0, int(_cut) + 1, 0)"),
        *add(_lines=f"if(_cut > 0, {last_empty('slice(_all, _cut + 1, size(_all))')}, _all)"),
        *add(_joined="array_join(_lines, '\n')"),
        *add(_inside=f"regexp_extract_all(_joined, {_quoted(FENCED)}, 0)", _outside=f"split(_joined, {_quoted(FENCED)}, -1)"),
        # Between two matches lie whole lines, and a line end on either side.
        *add(_code="""flatten(transform(_outside, (part, i) -> concat(
            transform(slice(split(part, '\n', -1), if(i > 0, 2, 1), greatest(size(split(part, '\n', -1)) - if(i > 0, 1, 0) - if(i < size(_inside), 1, 0), 0)), x -> false),
            if(i < size(_inside), transform(split(_inside[i], '\n', -1), x -> true), cast(array() as array<boolean>)))))"""),
        *add(_kinds=f"""split(regexp_replace(array_join(transform(_lines, (line, i) -> CASE WHEN _code[i] THEN '.'
            WHEN startswith(line, '#') AND {_stripped(f"regexp_extract(line, {_quoted(ATX)}, 2)")} != '' THEN 'a'
            WHEN i + 1 < size(_lines) AND NOT get(_code, i + 1) AND (startswith(get(_lines, i + 1), '=') OR startswith(get(_lines, i + 1), '--')) AND get(_lines, i + 1) RLIKE {_quoted(UNDERLINE)} AND NOT line RLIKE {_quoted(NO_UNDERLINE)} THEN 'u' ELSE '.' END), ''), 'uu', 'u.'), '')"""),
        *add(_heads="filter(sequence(0, size(_lines)), i -> get(_kinds, i) IN ('a', 'u'))"),
        *add(_ends="concat(_heads, array(size(_lines)))"),
        # Headings become a mark that no line holds, underlines a blank line: between the marks are the sections' own texts.
        *add(_texts="""split(array_join(transform(_lines, (line, i) -> CASE WHEN _kinds[i] IN ('a', 'u') THEN '\r' WHEN get(_kinds, i - 1) = 'u' THEN '' ELSE line END), '\n'), '\r', -1)"""),
        *add(_before=f"{_stripped('_texts[0]')} != ''"),
        *add(_found=f"""transform(_heads, (at, n) -> named_struct('ordinal', n + if(_before, 1, 0),
            'level', if(_kinds[at] = 'a', length(regexp_extract(_lines[at], {_quoted(ATX)}, 1)), if(startswith(_lines[at + 1], '='), 1, 2)),
            'title', {_stripped(f"if(_kinds[at] = 'a', regexp_extract(_lines[at], {_quoted(ATX)}, 2), _lines[at])")},
            'body', trim('\n' FROM _texts[n + 1]), 'start_line', _cut + at + 1, 'end_line', _cut + _ends[n + 1]))"""),
    ]
    heading = "struct<ordinal:int,title:string,gives:boolean>"
    row = f"struct<ordinal:int,level:int,title:string,body:string,start_line:int,end_line:int,above:array<{heading}>>"
    none, gives = f"array_repeat(cast(null as {heading}), {LEVELS})", f"length({_stripped('h.body')}) >= {min_chars}"
    same = ", ".join(f"'{c}', h.{c}" for c in ("ordinal", "level", "title", "body", "start_line", "end_line"))
    steps += [
        # In each block: the last heading of each level that none above it has ended, and the least level so far.
        *add(_blocks=f"""transform(sequence(0, (size(_found) - 1) div {BLOCK}), b -> aggregate(slice(_found, b * {BLOCK} + 1, {BLOCK}),
            named_struct('last', {none}, 'least', {LEVELS + 1}, 'out', cast(array() as array<{row[:-1]},under:int>>)), (s, h) -> named_struct(
            'last', transform(s.last, (x, l) -> CASE WHEN l + 1 < h.level THEN x WHEN l + 1 = h.level THEN named_struct('ordinal', h.ordinal, 'title', h.title, 'gives', {gives}) END),
            'least', least(s.least, h.level),
            'out', array_append(s.out, named_struct({same}, 'above', filter(s.last, (x, l) -> l + 1 < h.level AND x IS NOT NULL), 'under', least(s.least, h.level))))))"""),
        # What the blocks before left open.
        *add(_open=f"""aggregate(_blocks, named_struct('last', {none}, 'out', cast(array() as array<array<{heading}>>)), (s, b) -> named_struct(
            'last', transform(s.last, (x, l) -> CASE WHEN b.last[l] IS NOT NULL THEN b.last[l] WHEN l + 1 < b.least THEN x END), 'out', array_append(s.out, s.last)), s -> s.out)"""),
    ]
    for name, sql in steps:
        step = step.withColumn(name, F.expr(_once(sql)))
    first = f"""if(_before, array(cast(named_struct('ordinal', 0, 'level', 0, 'title', '', 'body', trim('\n' FROM _texts[0]),
        'start_line', _cut + 1, 'end_line', _cut + _ends[0], 'above', cast(array() as array<{heading}>)) as {row})), cast(array() as array<{row}>))"""
    rest = f"""flatten(transform(_blocks, (b, j) -> transform(b.out, h -> named_struct({same},
        'above', concat(filter(_open[j], (x, l) -> l + 1 < h.under AND x IS NOT NULL), h.above)))))"""
    return step.withColumn("sections", F.concat(F.expr(first), F.expr(_once(rest)))).select(*[F.col(f"`{c}`") for c in documents.columns], "sections")


def section_rows(documents: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows as ``chunking.section_rows`` makes them, from ``doc_id, text``, and ``giving``: the ordinal of the nearest section above
    whose own text gives a chunk."""
    rows = _with_sections(documents.select("doc_id", "text"), min_chars=min_chars).select("doc_id", F.inline_outer("sections")).where("ordinal is not null")
    ordinals = F.col("above.ordinal")
    return rows.select(
        "doc_id", "ordinal", "level", "title", section_ref(F.col("title")).alias("section_ref"), "body", "start_line", "end_line",
        F.when(F.col("level") > 0, F.concat(F.col("above.title"), F.array("title"))).otherwise(F.array().cast("array<string>")).alias("path"),
        F.get(F.reverse(ordinals), F.lit(0)).alias("parent"), F.get(F.reverse(F.expr("filter(above, x -> x.gives)").getField("ordinal")), F.lit(0)).alias("giving"),
    )
