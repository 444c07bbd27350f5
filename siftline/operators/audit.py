"""Rounds, candidates, merges and clean-ups of an audit session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dims import ENGINE_MERGE_WEIGHT, EXPLOITABILITY_LEVEL, lookup, severity_rank


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def next_round(df: DataFrame) -> DataFrame:
    """Candidates that go on: medium or high confidence, or severe."""
    return df.where((confidence_band(F.col("confidence")) != "low") | F.col("severity").isin("critical", "high"))


def round_metrics(df: DataFrame, key: str = "round") -> DataFrame:
    """Candidates by confidence band, their mean and tokens for each round."""
    band = confidence_band(F.col("confidence"))
    return df.groupBy(key).agg(
        F.count("*").alias("n"), *[F.count_if(band == b).alias(b) for b in ("high", "medium", "low")], F.round(F.avg("confidence"), 6).alias("mean"), F.sum("tokens").cast("bigint").alias("tokens")
    )


def termination(max_rounds: int = 4, high_ratio: float = 0.8) -> Column:
    """Why the audit ends after a round, in order; null if it goes on. From columns round, n, high and tokens."""
    ratio = F.try_divide(F.col("high"), F.col("n"))
    return F.when(F.col("round") >= max_rounds, "max_rounds").when(F.col("n") == 0, "no_candidates").when(ratio >= high_ratio, "confidence_threshold").when(F.col("tokens") > 100_000, "resources")


def merge_rank(prefix: str = "") -> Column:
    """Order of two findings of one group: score, engine, exploitability, severity."""
    c = lambda n: F.col(prefix + n)
    return F.struct(F.coalesce(c("final_score"), F.lit(0.0)), lookup(F.lower(c("source")), ENGINE_MERGE_WEIGHT, 0.5), lookup(F.lower(c("exploitability")), EXPLOITABILITY_LEVEL, 0), -severity_rank(c("severity")))


def framework_confidence(hits: DataFrame, least: float = 0.5) -> DataFrame:
    """Summed weight of each framework's hits, capped at one, those of ``least`` or more."""
    return hits.groupBy("framework").agg(F.round(F.least(F.lit(1.0), F.sum("weight")), 6).alias("confidence")).where(F.col("confidence") >= least)


def changed_paths(changes: DataFrame) -> DataFrame:
    """Distinct new and old paths of a change set."""
    return changes.select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct()


def cleaned_range(version: Column) -> Column:
    """Caret and tilde versions as ranges, ``x`` as zero; others unchanged."""
    text = F.regexp_replace(F.trim(version), r"(?<=\.)[xX*]", "0")
    body = F.regexp_replace(text, r"^[\^~]", "")
    part = lambda k: F.get(F.split(body, r"\."), F.lit(k)).try_cast("int")
    major, minor = part(0), F.coalesce(part(1), F.lit(0))
    tilde = F.concat(F.lit(">="), body, F.lit(",<"), major.cast("string"), F.lit("."), (minor + 1).cast("string"), F.lit(".0"))
    caret = F.concat(F.lit(">="), body, F.lit(",<"), F.when(major > 0, F.concat((major + 1).cast("string"), F.lit(".0.0"))).otherwise(F.concat(F.lit("0."), (minor + 1).cast("string"), F.lit(".0"))))
    return F.when(text.startswith("^"), caret).when(text.startswith("~"), tilde).otherwise(text)


def weakness(rule: Column, tags: Column) -> Column:
    """CWE of a tag, else of the rule id, as ``CWE-n``."""
    tag = F.get(F.filter(tags, lambda t: F.regexp_like(F.lower(t), F.lit(r"cwe[-/]\d+"))), F.lit(0))
    number = F.coalesce(F.nullif(F.regexp_extract(F.lower(tag), r"cwe[-/](\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(F.lower(rule), r"cwe[-_/]?(\d+)", 1), F.lit("")))
    return F.concat(F.lit("CWE-"), number.cast("int").cast("string"))


def merged_changes(staged: DataFrame, unstaged: DataFrame) -> DataFrame:
    """(path, changes, first_seen) of staged and unstaged changes: one union and one aggregation instead of an outer join."""
    both = staged.select("path", F.lit(True).alias("staged")).unionByName(unstaged.select("path", F.lit(False).alias("staged")))
    return both.groupBy("path").agg(F.count("*").alias("changes"), F.when(F.bool_or("staged"), "staged").otherwise("unstaged").alias("first_seen"))


def coverage_counts(groups: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """``groups`` with the distinct items of each part that it has; 0 where it has none."""
    for name, df in parts.items():
        n = df.groupBy(key).agg(F.countDistinct("item").alias(name))
        groups = groups.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return groups
