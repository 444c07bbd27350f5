"""Version order and ranges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(version: Column, parts: int = 4) -> Column:
    """Numeric parts padded with zeros; null where a part is no number.

    Leading ``v`` and operators go, as does all from the first ``-`` or ``+``.
    Empty versions and ``*`` are 0.0.0.
    """
    clean = F.split_part(F.split_part(F.regexp_replace(F.trim(version), "^[vV=~><^]+", ""), F.lit("-"), F.lit(1)), F.lit("+"), F.lit(1))
    clean = F.when(clean.isin("", "*"), "0.0.0").otherwise(clean)
    numbers = F.transform(F.split(clean, r"\."), lambda x: x.try_cast("int"))
    padded = F.slice(F.concat(numbers, F.array_repeat(F.lit(0), parts)), 1, parts)
    return F.when(~F.exists(padded, lambda x: x.isNull()), padded)


def version_place(key: Column, parts: int = 4) -> Column:
    """A double that never falls as the version key rises; keys that differ late may share one."""
    # a sum beyond 53 bits is rounded to steps that no later part reaches, so order is kept
    return F.aggregate(key, F.lit(0.0), lambda total, n: total * 2.0**31 + n)


def range_bounds(spec: Column) -> Column:
    """struct(min, min_in, max, max_in, exact) of a comma list of >=, >, <=, <, = constraints."""
    grab = lambda op: F.nullif(F.regexp_extract(F.regexp_replace(spec, r"\s+", ""), rf"(?:^|,){op}v?(\d+\.\d+(?:\.\d+)?)(?=,|$)", 1), F.lit(""))
    ge, gt, le, lt, eq = grab(">="), grab(">"), grab("<="), grab("<"), grab("=?")
    return F.struct(
        version_key(F.coalesce(ge, gt)).alias("min"), ge.isNotNull().alias("min_in"), version_key(F.coalesce(le, lt)).alias("max"), le.isNotNull().alias("max_in"), version_key(eq).alias("exact")
    )


def in_range(version: Column, spec: Column) -> Column:
    """Whether a version lies in a range; false where either does not parse."""
    v, r = version_key(version), range_bounds(spec)
    low = F.when(r["min"].isNull(), True).when(r["min_in"], v >= r["min"]).otherwise(v > r["min"])
    high = F.when(r["max"].isNull(), True).when(r["max_in"], v <= r["max"]).otherwise(v < r["max"])
    known = r["min"].isNotNull() | r["max"].isNotNull()
    return F.coalesce(F.when(r["exact"].isNotNull(), v == r["exact"]).otherwise(known & low & high), F.lit(False))


def affected(version: Column, ranges: Column, patched: Column) -> Column:
    """Whether any range holds, unless some patched version is not above the version."""
    v = version_key(version)
    fixed = F.coalesce(F.exists(patched, lambda p: version_key(p) <= v), F.lit(False))
    return ~fixed & F.coalesce(F.exists(ranges, lambda r: in_range(version, r)), F.lit(False))


def skip_reason(version: Column, confidence: Column) -> Column:
    """Why a dependency is not looked up, in order; null if it is."""
    return F.when(version.isNull(), "no version").when(version == "*", "any version").when(version.contains("${"), "unresolved variable").when(confidence < 0.5, "low confidence")


def compared(a: Column, b: Column) -> Column:
    """1, 0 or -1 as the first version is above, like or below the second; null where one does not parse."""
    x, y = version_key(a), version_key(b)
    return F.when(x > y, 1).when(x < y, -1).when(x == y, 0)
