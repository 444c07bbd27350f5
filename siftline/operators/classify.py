"""Ordered classifications of text and project facts, and small row decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed tables: first hit wins.
HEALTH = (
    ("missing_dependency", r"(?i)(could not resolve|no matching distribution|module not found|cannot find package)"),
    ("missing_tool", r"(?i)(command not found|no such file or directory|is not recognized)"),
    ("compile_error", r"(?i)(compilation failed|syntax ?error|cannot find symbol|undefined:)"),
    ("out_of_memory", r"(?i)(out ?of ?memory|heap space|killed)"),
    ("timeout", r"(?i)(timed? ?out|deadline exceeded)"),
    ("permission", r"(?i)(permission denied|access is denied)"),
)
BUILD_FILES = (("pom.xml", "maven"), ("build.gradle", "gradle"), ("build.gradle.kts", "gradle"), ("go.mod", "go"), ("package.json", "npm"), ("pyproject.toml", "python"), ("setup.py", "python"), ("Makefile", "make"))
SENSITIVE = r"(?i)(password|passwd|secret|token|api[_-]?key|credential|private[_-]?key)"
PLACEHOLDER = r"(?i)(^\$\{|^<.*>$|changeme|example|placeholder|your[_-]|xxx|todo)"
DANGEROUS = {"xss": ("<", ">", '"', "'", "&"), "sqli": ("'", '"', ";", "-", "\\"), "cmdi": (";", "|", "&", "$", "`", ">", "<")}


def first_match(text: Column, table: tuple[tuple[str, str], ...], default: str) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(table):
        out = F.when(F.regexp_like(text, F.lit(pattern)), name).otherwise(out)
    return F.coalesce(out, F.lit(default))


def build_system(files: DataFrame, project: str = "project", name: str = "name") -> DataFrame:
    """Per project the build system whose file ranks first."""
    rank = F.lit(None).cast("int")
    for k, (file, _) in reversed(list(enumerate(BUILD_FILES))):
        rank = F.when(F.col(name) == file, k).otherwise(rank)
    best = files.groupBy(project).agg(F.min(rank).alias("r"))
    names = F.array(*[F.lit(s) for _, s in BUILD_FILES])
    return best.select(project, F.coalesce(F.get(names, F.col("r")), F.lit("unknown")).alias("build_system"))


def sensitive(key: Column, value: Column) -> Column:
    """A key that names a secret with a value that looks like one."""
    shaped = F.regexp_like(value, F.lit(r"^[A-Za-z0-9+/_=.-]{8,}$"))
    return F.coalesce(F.regexp_like(key, F.lit(SENSITIVE)) & shaped & ~F.regexp_like(value, F.lit(PLACEHOLDER)), F.lit(False))


def coverage(escaped: Column, kind: str) -> Column:
    """Share of a kind's dangerous characters that are escaped."""
    chars = DANGEROUS[kind]
    return F.round(F.size(F.array_intersect(escaped, F.array(*map(F.lit, chars)))) / len(chars), 6)


def correlation_confidence(weighted: Column, sources: Column, rules: Column, consistent: Column, complete: Column) -> Column:
    """Weighted confidence raised by sources, rules and a complete path, lowered by contradiction; clamped at each step."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    x = clamp(weighted + F.when(sources >= 3, 0.1).when(sources >= 2, 0.05).otherwise(0.0))
    x = clamp(x + rules * 0.05)
    x = clamp(x - F.when(consistent, 0.0).otherwise(0.15))
    return clamp(x + F.when(complete, 0.1).otherwise(0.0))


def diminishing(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Whether a round brings little: below one, under a tenth of the round before, or half of it on the way down."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(value).over(w)
    low = (F.col(value) < 1) | (F.col(value) < before * 0.1) | (F.col(value) < before * 0.5)
    return df.withColumn("diminishing", F.coalesce(before.isNotNull() & low, F.lit(False)))


def group_limits(targets: DataFrame, level: str = "level") -> DataFrame:
    """Targets, parallelism and a timeout within [60, 1800] for each priority level."""
    g = targets.groupBy(level).agg(F.count("*").alias("targets"))
    width = F.when(F.col(level) == "critical", 4).when(F.col(level) == "high", 3).when(F.col(level) == "medium", 2).otherwise(1)
    return g.select(level, "targets", width.alias("parallel"), F.least(F.lit(1800), F.greatest(F.lit(60), F.col("targets") * 30)).cast("bigint").alias("timeout_s"))


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, target) of imports whose dotted name is the path of a file, with or without its last part."""
    full = F.concat(F.replace(F.col("name"), F.lit("."), F.lit("/")), F.lit(".py"))
    short = F.concat(F.replace(F.substring_index("name", ".", -1), F.lit("."), F.lit("/")), F.lit(".py"))
    tried = imports.select("path", "name", F.posexplode(F.array_distinct(F.array(full, short))).alias("rank", "target"))
    found = tried.join(files.select(F.col("path").alias("target")), "target")
    return found.groupBy("path", "name").agg(F.min_by("target", "rank").alias("target"))
