"""Repair of nearly valid JSON: native steps first, a character scan only for rows that still fail."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _scan(text: str) -> str:
    """Close open strings and brackets, quote bare keys, drop comments and trailing commas."""
    out: list[str] = []
    stack: list[str] = []
    quote = ""
    k = 0
    while k < len(text):
        c = text[k]
        if quote:
            if c == "\\" and k + 1 < len(text):
                out.append(text[k : k + 2])
                k += 2
                continue
            if c == quote:
                out.append('"')
                quote = ""
            elif c == "\n":
                out.append("\\n")
            elif c == '"':
                out.append('\\"')
            else:
                out.append(c)
        elif c in "\"'":
            quote = c
            out.append('"')
        elif text.startswith("//", k) or c == "#":
            k = text.find("\n", k)
            if k < 0:
                break
            continue
        elif text.startswith("/*", k):
            end = text.find("*/", k)
            if end < 0:
                break
            k = end + 1
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            out.append(c)
        elif c in "}]":
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            if stack and stack[-1] == c:
                stack.pop()
                out.append(c)
        elif c.isalpha() or c == "_":
            end = k
            while end < len(text) and (text[end].isalnum() or text[end] in "_-$"):
                end += 1
            word = text[k:end]
            rest = text[end:].lstrip()
            plain = {"True": "true", "False": "false", "None": "null"}.get(word, word)
            out.append(json.dumps(word) if rest.startswith(":") else plain)
            k = end
            continue
        else:
            out.append(c)
        k += 1
    if quote:
        out.append('"')
    while out and (out[-1].isspace() or out[-1] in ",:"):
        out.pop()
    return "".join(out) + "".join(reversed(stack))


@F.pandas_udf(StringType())
def _scanned(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _scan(t))


def unfenced(text: Column) -> Column:
    """What stands inside a Markdown fence, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)```(?:[a-zA-Z]*)\s*\n(.*?)```", 1)
    return F.when(inner != "", inner).otherwise(text)


def first_object(text: Column) -> Column:
    """From the first opening bracket to the last closing one."""
    return F.regexp_extract(text, r"(?s)([\{\[].*[\}\]])", 1)


def punctuated(text: Column) -> Column:
    """Full-width punctuation and curly quotes as ASCII."""
    return F.translate(text, "：，“”‘’｛｝［］", ":,\"\"''{}[]")


def without_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",(\s*[\}\]])", "$1")


def valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tried(done: Column | None, text: Column, fenced: Column | None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((none if done is None else done).alias("done"), text.alias("opened"), (none if fenced is None else fenced).alias("fenced"))


def attempts(text: Column) -> Column:
    """(done, opened, ...): the first of the native repairs, in order, that parses, or else what the character scan is to read.

    Each repair is a step of its own over the one before; functions of functions would hide a variable from a Python function over the result.
    """

    def step(so_far: Column, rest: Callable[[Column], Column]) -> Column:
        return once(so_far, lambda s: F.when(s["done"].isNotNull(), s).when(valid(s["opened"]), _tried(s["opened"], F.lit(None).cast("string"), None)).otherwise(rest(s)))

    out = step(_tried(None, text, None), lambda s: _tried(None, F.trim(unfenced(s["opened"])), None))
    out = step(out, lambda s: _tried(None, first_object(s["opened"]), s["opened"]))
    for repair in (punctuated, without_commas):
        out = step(out, lambda s, repair=repair: _tried(None, repair(s["opened"]), s["fenced"]))
    return step(out, lambda s: _tried(None, F.regexp_extract(punctuated(s["fenced"]), r"(?s)([\{\[].*)", 1), None))


def finished(tried: Column) -> Column:
    """What ``attempts`` found, or what the scan makes of the rest if that parses; where ``tried`` is a column of a table, only the rest is sent to Python."""
    return F.coalesce(tried["done"], once(_scanned(tried["opened"]), lambda last: F.when(valid(last), last)))


def repaired(text: Column) -> Column:
    """The first of the repairs, in order, that parses; null if none does."""
    return finished(attempts(text))
