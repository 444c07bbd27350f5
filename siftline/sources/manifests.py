"""Dependency manifests and git output as rows, one per line or entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def requirements(files: DataFrame) -> DataFrame:
    """(path, name, operator, version, extras) of requirement lines."""
    line = F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""), F.lit(" \t\r"))
    rows = files.select("path", F.explode(F.split("content", "\n")).alias("line")).select("path", line.alias("line")).where("line <> '' and not startswith(line, '-')")
    rx = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[([^\]]*)\])?\s*(?:(===?|>=|<=|~=|!=|>|<)\s*([^\s,;]+))?"
    part = lambda k: F.nullif(F.regexp_extract("line", rx, k), F.lit(""))
    return rows.where(part(1).isNotNull()).select("path", F.replace(F.lower(part(1)), F.lit("_"), F.lit("-")).alias("name"), part(3).alias("operator"), part(4).alias("version"), part(2).alias("extras"))


def npm_manifest(files: DataFrame) -> DataFrame:
    """(path, name, version, is_dev, is_optional) of a package manifest's dependency maps."""
    maps = {"dependencies": (False, False), "devDependencies": (True, False), "peerDependencies": (False, False), "optionalDependencies": (False, True)}
    schema = ", ".join(f"{k} MAP<STRING,STRING>" for k in maps)
    m = files.select("path", F.from_json("content", schema).alias("m"))
    out = None
    for name, (dev, optional) in maps.items():
        part = m.select("path", F.explode(F.col(f"m.{name}")).alias("name", "version"), F.lit(dev).alias("is_dev"), F.lit(optional).alias("is_optional"))
        out = part if out is None else out.unionByName(part)
    return out


def go_modules(files: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """(path, name, version, is_direct, confidence) of go.mod requirements; versions of go.sum take precedence."""
    rx = r"^(?:require\s+)?([A-Za-z0-9._~/-]+\.[A-Za-z0-9._~/-]+)\s+(v[^\s]+)(\s*//\s*indirect)?\s*$"
    rows = files.select("path", F.explode(F.split("content", "\n")).alias("line")).select("path", F.trim("line", F.lit(" \t\r")).alias("line")).where(F.regexp_like("line", F.lit(rx)))
    found = rows.select("path", F.regexp_extract("line", rx, 1).alias("name"), F.regexp_extract("line", rx, 2).alias("version"), (F.regexp_extract("line", rx, 3) == "").alias("is_direct"))
    if sums is None:
        return found.withColumn("confidence", F.lit(0.5))
    known = sums.select("name", F.col("version").alias("_sum")).dropDuplicates(["name"])
    out = found.join(known, "name", "left")
    return out.select("path", "name", F.coalesce("_sum", "version").alias("version"), "is_direct", F.when(F.col("_sum").isNotNull(), 1.0).otherwise(0.5).alias("confidence"))


def maven(files: DataFrame) -> DataFrame:
    """(path, name, version) of POM dependencies, with ``${property}`` replaced where it is defined."""
    block = F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    names = F.regexp_extract_all("content", F.lit(r"<([A-Za-z0-9._-]+)>[^<]*</\1>"), F.lit(1))
    values = F.regexp_extract_all("content", F.lit(r"<([A-Za-z0-9._-]+)>([^<]*)</\1>"), F.lit(2))
    pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x: F.endswith(x["k"], F.lit("version")))
    rows = files.select("path", pairs.alias("props"), F.explode(block).alias("d"))
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("d", rf"<{t}>([^<]*)</{t}>", 1)), F.lit(""))
    ref = F.regexp_extract(tag("version"), r"^\$\{([^}]+)\}$", 1)
    return rows.select("path", F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("name"), F.when(ref != "", F.coalesce(F.get(F.filter("props", lambda x: x["k"] == ref), F.lit(0))["v"], tag("version"))).otherwise(tag("version")).alias("version"))


def git_changes(text: DataFrame, column: str = "line") -> DataFrame:
    """(path, change, old_path, additions, deletions) of raw and numstat lines, joined by path."""
    raw = r"^:\d+ \d+ \S+ \S+ ([AMDRCT])\d*\t([^\t]+)(?:\t([^\t]+))?$"
    num = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "modified"}.items() for x in kv]), F.regexp_extract(column, raw, 1))
    third = F.nullif(F.regexp_extract(column, raw, 3), F.lit(""))
    second = F.regexp_extract(column, raw, 2)
    status = text.where(F.regexp_like(column, F.lit(raw))).select(F.coalesce(third, second).alias("path"), kind.alias("change"), F.when(third.isNotNull(), second).alias("old_path"))
    count = lambda k: F.coalesce(F.regexp_extract(column, num, k).try_cast("int"), F.lit(0))
    stat = text.where(F.regexp_like(column, F.lit(num))).select(F.regexp_extract(column, num, 3).alias("path"), count(1).alias("additions"), count(2).alias("deletions"))
    return status.join(stat, "path", "left")


def gradle(files: DataFrame) -> DataFrame:
    """(path, scope, name, version) of Gradle dependency lines, Groovy or Kotlin."""
    rx = r"^\s*(api|implementation|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor|kapt|compile)[\s(]+['\"]([^:'\"]+:[^:'\"]+)(?::([^'\"]+))?['\"]"
    rows = files.select("path", F.explode(F.split("content", "\n")).alias("line")).where(F.regexp_like("line", F.lit(rx)))
    return rows.select("path", F.regexp_extract("line", rx, 1).alias("scope"), F.regexp_extract("line", rx, 2).alias("name"), F.nullif(F.regexp_extract("line", rx, 3), F.lit("")).alias("version"))


def go_directives(files: DataFrame) -> DataFrame:
    """(path, module, go_version): the first of either directive of a go.mod."""
    first = lambda rx: F.nullif(F.regexp_extract("content", rx, 1), F.lit(""))
    return files.select("path", first(r"(?m)^module\s+(\S+)").alias("module"), first(r"(?m)^go\s+(\S+)").alias("go_version"))
