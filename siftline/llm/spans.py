"""Regex spans as Column expressions: code-point offsets without Python.

``split`` gives the text between matches and ``regexp_extract_all`` the matches,
so running lengths are the offsets. Patterns are possessive single-class runs,
so no text makes the matcher recurse or take quadratic time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,left:string,left2:string,right:string,value:string>>"
#: Rank of spans of no kind.
OTHER = 9
#: Arrays up to this length are summed in one fold; longer ones in blocks of the root of their length.
_ONE_FOLD = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold(values: Column, begin: Column, join: Callable[[Column, Column], Column]) -> Column:
    start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, start, step, lambda acc: acc["out"])


def running(values: Column, zero: int, join: Callable[[Column, Column], Column]) -> Column:
    """What an associative ``join`` makes of the values before each element. Appending copies, so long arrays are folded in blocks."""
    total = lambda part: F.aggregate(part, F.lit(zero), join)

    def blocks(all_: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / width).cast("int")), lambda k: F.slice(all_, k * width + 1, width))
        return let(cut, lambda parts: F.flatten(F.zip_with(parts, _fold(F.transform(parts, total), F.lit(zero), join), lambda part, begin: _fold(part, begin, join))))

    return let(values, lambda all_: F.when(F.size(all_) <= _ONE_FOLD, _fold(all_, F.lit(zero), join)).otherwise(blocks(all_)))


def add(a: Column, b: Column) -> Column:
    return a + b


def most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def uncovered(spans: Column, by: Column) -> Column:
    """Those of ``spans`` that overlap none of ``by``; one sweep over both in either direction."""
    far = 1 << 30

    def sweep(all_: Column) -> Column:
        last = F.size(all_) - 1
        ends = running(F.transform(all_, lambda x: F.when(x["rank"] < OTHER, x["end"]).otherwise(0)), 0, most)
        begins = running(F.transform(F.reverse(all_), lambda x: F.when(x["rank"] < OTHER, x["start"]).otherwise(far)), far, least)
        free = lambda i, e, b: let(F.get(all_, i), lambda x: (x["rank"] == OTHER) & (F.get(e, i) <= x["start"]) & (F.get(b, last - i) >= x["end"]))
        return let(ends, lambda e: let(begins, lambda b: F.transform(F.filter(F.sequence(F.lit(0), last), lambda i: free(i, e, b)), lambda i: F.get(all_, i))))

    return F.when((F.size(spans) == 0) | (F.size(by) == 0), spans).otherwise(let(F.array_sort(F.concat(by, spans)), sweep))


def match_spans(text: Column, pattern: str, kind: str, rank: int, accept: Callable[[Column], Column], restore: Callable[[Column], Column] | None = None, context: bool = False) -> Column:
    """Spans of the leftmost non-overlapping matches that ``accept`` holds for.

    With ``context``, ``left`` is the word before the match, ``left2`` that and
    the one before it, ``right`` the word after it, all lower-cased and within
    48 characters, else null. ``restore`` makes the value of a match of masked text.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    word = F.lit(None).cast("string")

    def spans(all_: Column, at: Column) -> Column:
        def one(i: Column) -> Column:
            x = F.get(all_, i)
            begin = F.get(at, i) + F.length(x["gap"])
            size = F.length(x["hit"])
            value = restore(x["hit"]) if restore else x["hit"]
            around = (left_word(x["gap"]), left_words(x["gap"]), right_word(F.get(all_, i + 1)["gap"])) if context else (word, word, word)
            return F.struct(
                begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (begin + size).alias("end"),
                around[0].alias("left"), around[1].alias("left2"), around[2].alias("right"), value.alias("value"),
            )

        wanted = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: let(F.get(all_, i)["hit"], lambda hit: hit.isNotNull() & accept(hit)))
        return F.transform(wanted, one)

    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))
    return let(parts, lambda all_: let(running(F.transform(all_, size), 0, add), lambda at: spans(all_, at)))


def _some(found: Column) -> Column:
    return F.lower(F.nullif(found, F.lit("")))


def left_word(gap: Column) -> Column:
    return _some(F.regexp_extract(F.right(gap, F.lit(48)), r"([\p{L}_]+)[^\p{L}\p{N}]{0,6}$", 1))


def left_words(gap: Column) -> Column:
    return _some(F.regexp_extract(F.right(gap, F.lit(48)), r"([\p{L}_]+[^\p{L}\p{N}]{1,3}[\p{L}_]+)[^\p{L}\p{N}]{0,6}$", 1))


def right_word(gap: Column) -> Column:
    return _some(F.regexp_extract(F.left(gap, F.lit(48)), r"^[^\p{L}\p{N}]{0,6}([\p{L}_]+)", 1))


def none() -> Column:
    return F.array().cast(SPAN)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, by start, then rank, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by its first kind in brackets.

    A span is dropped where an earlier one reaches over its start; what is left
    are runs, each ending where its longest span ends.
    """
    return let(F.array_sort(spans), lambda s: let(_reach(s), lambda r: _replaced(text, s, r)))


def _reach(spans: Column) -> Column:
    """Furthest end before each span, and last that of all."""
    return let(F.transform(spans, lambda x: x["end"]), lambda ends: F.concat(running(ends, 0, most), F.array(F.array_max(ends))))


def _replaced(text: Column, spans: Column, reach: Column) -> Column:
    fresh = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] >= F.get(reach, i))

    def piece(i: Column) -> Column:
        s, begin = F.get(spans, i), F.get(reach, i)
        return F.concat(F.substring(text, begin + 1, s["start"] - begin), F.lit("["), F.upper(s["kind"]), F.lit("]"))

    return F.concat(F.array_join(F.transform(fresh, piece), ""), F.substring(text, F.get(reach, F.size(spans)) + 1, F.length(text)))
