"""Tokens of SQL texts: words, quotes, comments at any depth. Nothing is parsed; each text is scanned once, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"\w$\u0080-\U0010ffff"
_COMMON = rf"(?P<line>--[^\n\r]*)|(?P<block>/\*)|(?P<stray>\*/)|(?P<name>\"(?:[^\"]|\"\")*+(?:\"|\Z))|(?P<text>'(?:[^']|'')*+(?:'|\Z))|(?P<word>[A-Za-z_\u0080-\U0010ffff][{_PART}]*)|(?P<space>\s+)|(?P<sign>.)"
_POSTGRES = rf"(?P<escaped>(?<![{_PART}])[eE]'(?:[^'\\]|\\.|'')*+(?:'|\\?\Z))|(?P<dollar>(?<![{_PART}])\$(?:[A-Za-z_\u0080-\U0010ffff][A-Za-z0-9_\u0080-\U0010ffff]*)?\$)"
_ORACLE = rf"(?P<bracket>(?<![{_PART}])[nN]?[qQ]'(?=.))"
_SCAN = {mode: re.compile(f"{first}|{_COMMON}", re.DOTALL | re.ASCII) for mode, first in (("postgres", _POSTGRES), ("oracle", _ORACLE))}
_COMMENT = re.compile(r"/\*|\*/")
_CLOSES = {"[": "]", "(": ")", "{": "}", "<": ">"}


def tokens(sql: str, mode: str = "postgres") -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each token: word, name (in double quotes), quote, comment, broken (a comment that is never closed,
    that nests where the dialect has none, or a closing mark without one), space, or the sign itself. Block comments nest to any
    depth; a quote that is never closed reaches the end."""
    scan, at = _SCAN[mode].match, 0
    while at < len(sql):
        found = scan(sql, at)
        kind, end = found.lastgroup, found.end()
        if kind == "block":
            depth, nested = 1, False
            while depth and (mark := _COMMENT.search(sql, end)):
                depth += 1 if mark.group() == "/*" else -1
                nested, end = nested or depth > 1, mark.end()
            kind = "broken" if depth or nested and mode == "oracle" else "comment"
            end = len(sql) if depth else end
        elif kind in ("dollar", "bracket"):
            closing = found.group() if kind == "dollar" else _CLOSES.get(sql[end], sql[end]) + "'"
            close = sql.find(closing, end + (kind == "bracket"))
            kind, end = "quote", len(sql) if close < 0 else close + len(closing)
        elif kind in ("text", "escaped"):
            kind = "quote"
        elif kind == "line":
            kind = "comment"
        elif kind == "stray":
            kind = "broken"
        elif kind == "sign":
            kind = found.group()
        yield kind, at, end
        at = end


#: What a block of statements begins with; its semicolons end nothing.
_BLOCK = re.compile(r"(?:DECLARE|BEGIN|CREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:NON)?EDITIONABLE\s+)?(?:PROCEDURE|FUNCTION|PACKAGE|TRIGGER|TYPE))\b", re.IGNORECASE)


def split(script: str | None, mode: str = "postgres") -> list[str]:
    """The statements of a script; pieces of white space and comments alone aren't any."""
    out, start, live, block = [], 0, False, None

    def cut(end: int) -> None:
        if live:
            out.append(script[start:end].strip())

    for kind, at, end in tokens(script or "", mode):
        if kind in ("space", "comment"):
            continue
        if mode == "oracle" and kind == "/" and not script[script.rfind("\n", 0, at) + 1 : at].strip(" \t\r") and re.match(r"[ \t]*(?:[\r\n]|\Z)", script[end:]):
            cut(at)
            start, live, block = end, False, None
            continue
        if block is None:
            block = mode == "oracle" and _BLOCK.match(script, at) is not None
        if kind == ";" and not block:
            cut(at)
            start, live, block = end, False, None
        else:
            live = True
    cut(len(script or ""))
    return out


def blank(sql: str | None, mode: str = "postgres", keep_names: bool = False) -> str | None:
    """The text with comments as a space and quotes as ''; quoted names as x, or, if asked for, as they are."""
    if sql is None:
        return None
    told = {"comment": " ", "broken": " ", "quote": "''"} | ({} if keep_names else {"name": "x"})
    return "".join(told.get(kind, sql[a:b]) for kind, a, b in tokens(sql, mode))


def ends_open(sql: str) -> bool:
    """Whether the text's last token is a semicolon of its own."""
    last = ""
    for kind, _, _ in tokens(sql):
        last = kind if kind != "space" else last
    return last == ";"


def split_column(script: Column, mode: str) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: split(x, mode)), "array<string>")(script)


def blank_column(sql: Column, mode: str, keep_names: bool) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: blank(x, mode, keep_names)), "string")(sql)


def ends_open_column(sql: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: None if pd.isna(x) else ends_open(x)), "boolean")(sql)
