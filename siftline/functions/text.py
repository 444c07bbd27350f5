"""Text normalisers and extractors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed: the three replacements that the semantic hash depends on.
def normalize_code(element: Column) -> Column:
    """Whitespace, quotes, separators, variables and literals made alike, lower-cased."""
    t = F.trim(F.regexp_replace(F.coalesce(element, F.lit("")), r"\s+", " "))
    t = F.replace(F.replace(t, F.lit('"'), F.lit("'")), F.lit("\\"), F.lit("/"))
    t = F.regexp_replace(t, r"\$\{?[a-zA-Z_][a-zA-Z0-9_]*\}?", r"\$X")
    t = F.regexp_replace(t, r"\{\{[a-zA-Z_][a-zA-Z0-9_]*\}\}", "{{X}}")
    return F.lower(F.regexp_replace(t, r"'[^']*'", "'X'"))


def normalize_function(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"^(self|this|cls)\.", "")


def normalize_path(path: Column) -> Column:
    slashed = F.replace(F.trim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    return F.lower(F.regexp_replace(slashed, r"^(\./|/)+", ""))


def identifiers(text: Column, pattern: str) -> Column:
    """Distinct upper-cased matches, such as CVE or CWE ids, in order of first sight."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.upper(text), F.lit(pattern), F.lit(0)), lambda x: x))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def last_parts(path: Column, n: int = 2) -> Column:
    return F.substring_index(path, "/", -n)


def route_path(path: Column) -> Column:
    """``:id`` and ``<conv:id>`` as ``{id}``."""
    return F.regexp_replace(F.regexp_replace(path, r"<(?:[a-z]+:)?([A-Za-z_]\w*)>", "{$1}"), r":([A-Za-z_]\w*)", "{$1}")


def humanised(identifier: Column) -> Column:
    """The last dotted part as words with capitals."""
    return F.initcap(F.translate(F.substring_index(identifier, ".", -1), "-_", "  "))


def line_window(text: Column, line: Column, around: int) -> Column:
    """The lines around a line number, clamped to the text."""
    lines = F.split(text, "\n")
    first = F.greatest(F.lit(1), line - around)
    return F.array_join(F.slice(lines, first, line + around - first + 1), "\n")


def terms(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


# Fixed order of what a message names: a variable, a quoted name, a called function.
MESSAGE_NAMES = (r"(?i)\bvariable\s+['`\"]?([A-Za-z_][A-Za-z0-9_.]*)", r"[`'\"]([A-Za-z_][A-Za-z0-9_.]*)[`'\"]", r"\b([A-Za-z_][A-Za-z0-9_.]*)\(")


def mined_name(message: Column) -> Column:
    """The first name that a message holds, by the patterns in order; null if there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(message, p, 1), F.lit("")) for p in MESSAGE_NAMES])


def running_total(values: Column) -> Column:
    """Sum of the elements before each one of an array of integers.

    A fold that appends copies what it has, so the array is folded in blocks of
    the root of its length: a long one costs n to the power 1.5, not 2.
    """
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)

    def before(part: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def blocks(all_: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(all_))).cast("int"), F.lit(1))
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / width).cast("int")), lambda k: F.slice(all_, k * width + 1, width))
        return F.get(F.transform(F.array(parts), lambda p: F.flatten(F.zip_with(p, before(F.transform(p, total), F.lit(0)), before))), F.lit(0))

    return F.get(F.transform(F.array(values), blocks), F.lit(0))
