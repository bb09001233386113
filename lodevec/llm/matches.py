"""Matches of a pattern with their places, in SQL functions alone."""

from __future__ import annotations


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_sql(text: str, pattern: str, kind: int, keep: str = "true", group: int = 0) -> str:
    """SQL for array<struct<s, k, e, v>>: code-point start, kind, end (exclusive) and group of each match of a Java
    pattern that fulfils keep, SQL over x.hit (the match) and x.part (the group).

    A text is its matches and the gaps between them, so a match starts where all gaps and matches before it end. Texts
    without a match are only searched once.
    """
    p = sql_text(pattern)
    empty = "cast(array() as array<struct<s:int,k:int,e:int,v:string>>)"
    zipped = f"zip_with(split({text}, {p}, -1), arrays_zip(regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group})), (g, m) -> named_struct('gap', g, 'hit', m['0'], 'part', m['1']))"
    added = f"array(named_struct('s', a.at + length(x.gap), 'k', {kind}, 'e', a.at + length(x.gap) + length(x.hit), 'v', x.part))"
    step = f"named_struct('at', a.at + length(x.gap) + coalesce(length(x.hit), 0), 'out', if(x.hit is not null and ({keep}), concat(a.out, {added}), a.out))"
    return f"if({text} rlike {p}, aggregate({zipped}, named_struct('at', 0, 'out', {empty}), (a, x) -> {step}, a -> a.out), {empty})"
