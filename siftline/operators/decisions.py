"""Scores and decision tables as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dims import ENGINE_SCORE_WEIGHT, EXPLOITABILITY_SCORE, SEVERITY_SCORE, STATUS_LEVEL, lookup, severity_rank

# Fixed weights of the final score and its defaults for unknown parts.
SEVERITY_PART, EXPLOITABILITY_PART, CONFIDENCE_PART = 0.4, 0.4, 0.2
DEFAULT_SEVERITY, DEFAULT_EXPLOITABILITY, DEFAULT_CONFIDENCE, DEFAULT_ENGINE = 0.5, 0.5, 0.7, 1.0


def final_score() -> Column:
    severity = lookup(F.lower("severity"), SEVERITY_SCORE, DEFAULT_SEVERITY)
    exploitability = lookup(F.lower("exploitability"), EXPLOITABILITY_SCORE, DEFAULT_EXPLOITABILITY)
    confidence = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))), F.lit(DEFAULT_CONFIDENCE))
    engine = lookup(F.lower("source"), ENGINE_SCORE_WEIGHT, DEFAULT_ENGINE)
    return F.round((severity * SEVERITY_PART + exploitability * EXPLOITABILITY_PART + confidence * CONFIDENCE_PART) * engine, 6)


def _words(column: str) -> Column:
    return F.lower(F.trim(F.col(column)))


def final_status() -> Column:
    """Exploitability decides; confirmed ones need high severity to count as exploitable."""
    e, high = _words("exploitability"), F.col("severity").isin("high", "critical")
    return (
        F.when(e.isin("not_exploitable", "not exploitable", "safe"), "not_exploitable")
        .when(e.isin("exploitable", "confirmed") & high, "exploitable")
        .otherwise("conditional")
    )


def override_applied() -> Column:
    e, high = _words("exploitability"), F.col("severity").isin("high", "critical")
    return F.coalesce(e.isin("not_exploitable", "not exploitable", "safe") | (high & e.isin("unlikely", "exploitable", "confirmed", "likely")), F.lit(False))


def status_conflict() -> Column:
    """Not exploitable, yet finally exploitable."""
    return F.coalesce((_words("exploitability") == "not_exploitable") & (F.col("final_status") == "exploitable"), F.lit(False))


def row_conflicts(df: DataFrame) -> DataFrame:
    """(id, rule) of every row-level consistency rule that a finding breaks."""
    e, s = _words("exploitability"), _words("final_status")
    one = (e.isin("not_exploitable", "safe") & (s != "not_exploitable")) | (e.isin("exploitable", "confirmed") & (s == "not_exploitable"))
    low = (s == "exploitable") & (severity_rank(F.col("severity")) > 2)
    warn = (s == "informational") & (severity_rank(F.col("severity")) <= 1)
    found = F.array_compact(F.array(F.when(one, "rule_1_mismatch"), F.when(low, "rule_2_severity"), F.when(warn, "rule_5_warning")))
    return df.select("id", F.explode(found).alias("rule"))


def group_conflicts(df: DataFrame, key: str = "logical_id") -> DataFrame:
    """Per logical vulnerability: contradicting statuses, engines in disagreement, and too wide a range of levels."""
    status = _words("final_status")
    level = lookup(status, STATUS_LEVEL)
    engines = df.groupBy(key, "source").agg(
        F.min_by(level, "input_seq").alias("first_level"), F.min(level).alias("low"), F.max(level).alias("high"), F.bool_or(status == "exploitable").alias("yes"), F.bool_or(status == "not_exploitable").alias("no"), F.count("*").alias("n")
    )
    groups = engines.groupBy(key).agg(
        F.bool_or("yes").alias("yes"), F.bool_or("no").alias("no"), F.min("first_level").alias("first_low"), F.max("first_level").alias("first_high"), F.count("*").alias("engines"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("findings")
    )
    return groups.select(
        key, "findings", "engines", (F.col("yes") & F.col("no")).alias("rule_2_conflict"), ((F.col("first_high") > 2) & (F.col("first_low") < 2) & (F.col("engines") > 1)).alias("rule_3_conflict"), (F.col("high") - F.col("low") >= 2).alias("rule_4_conflict")
    )


def derived_status(score: Column, confidence: Column) -> Column:
    return (
        F.when(confidence < 0.2, "needs_review").when(score >= 0.6, "exploitable").when(score <= 0.3, "not_exploitable").when(score >= 0.45, "conditional").otherwise("unlikely")
    )


def fused(scores: list[Column], weights: list[float], strategy: str = "weighted") -> Column:
    """Several dimension scores, nulls missing, as one: weighted mean, least or greatest; 0.5 where all are missing."""
    if strategy == "conservative":
        return F.coalesce(F.array_min(F.array(*scores)), F.lit(0.5))
    if strategy == "optimistic":
        return F.coalesce(F.array_max(F.array(*scores)), F.lit(0.5))
    total = sum(F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in zip(scores, weights))
    value = sum(F.coalesce(s * w, F.lit(0.0)) for s, w in zip(scores, weights))
    return F.coalesce(F.try_divide(value, total), F.lit(0.5))


def cvss_severity(score: Column) -> Column:
    return F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score > 0, "low").otherwise("info")


def audit_level(score: Column) -> Column:
    return F.when(score >= 0.8, "critical").when(score >= 0.6, "high").when(score >= 0.4, "medium").when(score >= 0.2, "low").otherwise("skip")


def evidence_summary(df: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Mean, weighted mean, consistency and status of each candidate's evidence."""
    groups = df.groupBy(key).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.sum(F.col("confidence") * F.col("weight")).alias("cw"), F.sum("weight").alias("w"), F.bool_or("is_false_positive").alias("fp"),
        F.bool_or((F.col("confidence") >= 0.8) & ~F.col("is_false_positive")).alias("strong"), F.bool_or(F.col("evidence_type") == "sanitizer_detected").alias("sanitized"),
    )
    weighted = F.round(F.coalesce(F.try_divide("cw", "w"), F.col("mean")), 6)
    status = (
        F.when(F.col("fp"), "false_positive").when(F.col("sanitized"), "not_exploitable").when(weighted >= 0.85, "confirmed").when(weighted >= 0.6, "likely").when(weighted <= 0.25, "not_exploitable").otherwise("needs_review")
    )
    return groups.select(key, "n", F.round("mean", 6).alias("mean_confidence"), weighted.alias("weighted_confidence"), (~(F.col("fp") & F.col("strong"))).alias("consistent"), status.alias("status"))


# Fixed correlation rules in order: id, least sources, required sources, required evidence types, status.
CORRELATION_RULES = (
    ("multi-source-confirmation", 2, (), (), "confirmed"),
    ("codeql-agent-deep-confirm", 1, ("codeql", "agent"), ("dataflow_path", "agent_analysis"), "confirmed"),
    ("sanitizer-detected", 1, (), ("sanitizer_detected",), "not_exploitable"),
    ("cve-pattern-match", 1, (), ("cve_match",), "likely"),
    ("agent-false-positive", 1, ("agent",), (), "false_positive"),
)


def correlate(evidence: DataFrame, key: str = "candidate_id", rules: tuple[tuple, ...] = CORRELATION_RULES) -> DataFrame:
    """Status of the last rule that a candidate's sources and evidence types satisfy; null if none does."""
    sets = evidence.groupBy(key).agg(F.collect_set("source").alias("sources"), F.collect_set("evidence_type").alias("types"))
    matched = []
    for name, least, sources, types, status in rules:
        has = F.size("sources") >= least
        for required, column in ((sources, "sources"), (types, "types")):
            for x in required:
                has = has & F.array_contains(column, x)
        matched.append(F.when(has, F.struct(F.lit(name).alias("rule"), F.lit(status).alias("status"))))
    found = F.array_compact(F.array(*matched))
    return sets.select(key, F.size(found).cast("bigint").alias("rules"), F.try_element_at(found, F.lit(-1))["rule"].alias("rule"), F.try_element_at(found, F.lit(-1))["status"].alias("status"))
