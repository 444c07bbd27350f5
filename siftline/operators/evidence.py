"""Evidence, dimension scores, exploitability and candidate stages of an audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import confidence_band
from .dims import lookup

# Fixed values that scores and statuses depend on.
SURFACE_WEIGHT = {"HTTP": 1.0, "API": 1.0, "WEB": 1.0, "CLI": 0.7, "DAEMON": 0.6, "LIBRARY": 0.3, "UNKNOWN": 0.5}
ENTRY_SCORE = {"HTTP": 1.0, "CLI": 0.8, "UNKNOWN": 0.6}
ENTRY_CONFIDENCE = {"HTTP": 0.95, "CLI": 0.85, "UNKNOWN": 0.5}
SANITIZED_SCORE = {"full": 0.0, "partial": 0.2}
SANITIZED_CONFIDENCE = {"full": 0.9, "partial": 0.7}
BAND_CONFIDENCE = {"high": 0.9, "medium": 0.6, "low": 0.3}
SEVERITY_BAND = {"critical": "high", "high": "high", "medium": "medium", "low": "low", "info": "low"}
SOURCE_WEIGHT = {"semgrep": 0.6, "codeql": 0.9, "agent": 0.8}
SOURCE_TYPE = {"semgrep": "pattern_match", "codeql": "dataflow_path", "agent": "agent_analysis"}
ATTACK_WORDS = {"user_controlled": 0.15, "no sanitization": 0.1, "direct input": 0.1, "prepared statement": -0.2, "parameterized": -0.2, "sanitize": -0.15, "validate": -0.1, "escape": -0.1}
SEVERE_TYPES = ("sql_injection", "command_injection", "code_injection", "rce")
KNOWN_SANITIZERS = ("escape", "sanitize", "quote", "bleach", "encode", "htmlspecialchars", "parameterize")


def _clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def _pair(score: Column, confidence: Column) -> Column:
    return F.struct(F.round(score, 6).alias("score"), F.round(confidence, 6).alias("confidence"))


def dataflow_score(known: Column, source: Column, sink: Column, sanitized: Column, effect: Column, length: Column) -> Column:
    """(score, confidence) of a data flow: sanitised flows by effect, whole ones fall by length, half ones are 0.5."""
    whole = F.greatest(F.lit(0.5), 1 - length * 0.05) * 0.9
    score = F.when(~known, 0.1).when(sanitized, lookup(effect, SANITIZED_SCORE, 0.3)).when(source & sink, whole).when(source | sink, 0.5).otherwise(0.2)
    sure = F.when(~known, 0.2).when(sanitized, lookup(effect, SANITIZED_CONFIDENCE, 0.5)).when(source & sink, 0.8).when(source | sink, 0.5).otherwise(0.3)
    return _pair(score, sure)


def taint_score(known: Column, exploitable: Column, sanitized: Column, reachable: Column, guard: Column, length: Column, confidence: Column) -> Column:
    """(score, confidence) of a taint trace; ``guard`` is the confidence of its effective sanitizer, null if there is none."""
    score = F.when(~known, 0.0).when(exploitable, F.greatest(F.lit(0.8), 1 - length * 0.02) * 0.95).when(sanitized, F.when(guard.isNull(), 0.1).when(guard > 0.8, 0.0).otherwise(0.2)).when(reachable, 0.6).otherwise(0.0)
    sure = F.when(~known, 0.0).when(~exploitable & ~sanitized & reachable, confidence * 0.8).otherwise(confidence)
    return _pair(score, sure)


def reach_score(known: Column, is_entry: Column, kind: Column, callers: Column) -> Column:
    """(score, confidence) by the call chain: entry points by kind, else by callers."""
    name = F.coalesce(kind, F.lit("UNKNOWN"))
    score = F.when(~known, 0.2).when(is_entry, lookup(name, ENTRY_SCORE, 0.7)).when(callers > 0, F.least(F.lit(0.7), 0.3 + callers * 0.1)).otherwise(0.1)
    return _pair(score, F.when(~known, 0.3).when(is_entry, lookup(name, ENTRY_CONFIDENCE, 0.6)).when(callers > 0, 0.7).otherwise(0.6))


def surface_score(kind: Column) -> Column:
    """(score, confidence) of an entry point type."""
    name = F.upper(kind)
    sure = F.when(kind.isNull(), 0.3).when(name == "UNKNOWN", 0.5).when(name.isin(*SURFACE_WEIGHT), 0.9).otherwise(0.5)
    return _pair(lookup(name, SURFACE_WEIGHT, 0.5), sure)


def exploitability(flow: Column, source: Column, sink: Column, sanitizers: Column, chain: Column, is_entry: Column, callers: Column, user_input: Column) -> Column:
    """(status, confidence): a confirmed data flow decides first, then the call chain and whether the input is a user's."""
    state = lambda name, sure: F.struct(F.lit(name).alias("status"), F.lit(sure).alias("confidence"))
    confirmed = F.when(flow & source & sink, F.when(sanitizers > 0, state("conditional", 0.7)).otherwise(state("exploitable", 0.9))).when(flow & source, state("unlikely", 0.45)).when(flow & sink, state("needs_review", 0.5))
    lost = ~chain | (~is_entry & (callers == 0))
    static = F.when(lost, state("needs_review", 0.35)).when(~user_input, F.when(is_entry, state("unlikely", 0.4)).otherwise(state("not_exploitable", 0.25))).when(is_entry, state("exploitable", 0.85)).otherwise(state("needs_review", 0.5))
    return F.coalesce(confirmed, static)


def path_confidence(paths: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, primary, updated): the longest complete path, else the longest, and the confidence that the paths give; null keeps the old one.

    ``paths`` has path_id, complete, nodes and effective (a sanitizer that works).
    """
    best = F.max_by("path_id", F.struct("complete", "nodes", (-F.col("path_id")).alias("early")))
    g = paths.groupBy(key).agg(best.alias("primary"), F.bool_or("complete").alias("whole"), F.bool_or("effective").alias("guarded"))
    return g.select(key, "primary", F.when(F.col("guarded"), "low").when(F.col("whole"), "high").otherwise("medium").alias("updated"))


def candidate_confidence(confidence: Column, whole_path: Column, confirmed: Column, false_positive: Column) -> Column:
    """Band of a candidate after deep analysis; a false positive wins, then any confirmation."""
    return F.when(false_positive, "low").when(whole_path | confirmed, "high").otherwise(confidence)


def candidates(findings: DataFrame) -> DataFrame:
    """Findings as candidates: band by severity, one up for medium ones of the agent, and whether they go on."""
    band = lookup(F.lower("severity"), SEVERITY_BAND, "medium")
    band = F.when((F.col("source") == "agent") & (band == "medium"), "high").otherwise(band)
    rows = findings.withColumn("confidence_band", band)
    return rows.withColumn("next_round", F.col("confidence_band").isin("high", "medium") | F.col("severity").isin("critical", "high"))


def after_deep_analysis(candidates_: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Candidates (id, band, severity) with the band that ``results`` (id, whole_path, confirmed, false_positive) give, and who goes on: medium or severe ones."""
    flags = ("whole_path", "confirmed", "false_positive")
    out = candidates_.join(results.select(key, *flags), key, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})
    out = out.withColumn("band", candidate_confidence(F.col("band"), *map(F.col, flags))).drop(*flags)
    return out.withColumn("next_round", (F.col("band") == "medium") | F.col("severity").isin("critical", "high"))


def after_correlation(candidates_: DataFrame, statuses: DataFrame, key: str = "id") -> DataFrame:
    """Candidates with the status of their evidence: confirmed and likely ones have high confidence, false positives and not exploitable ones low; needs_review asks for a person."""
    out = candidates_.join(statuses.select(key, "status"), key, "left")
    band = F.when(F.col("status").isin("confirmed", "likely"), "high").when(F.col("status").isin("false_positive", "not_exploitable"), "low").otherwise(F.col("band"))
    return out.withColumn("band", band).withColumn("review", F.coalesce(F.col("status") == "needs_review", F.lit(True)))


def after_verification(candidates_: DataFrame, verified: DataFrame, key: str = "id") -> DataFrame:
    """Candidates with the adjusted severity where there is one, the band of the new confidence, and who needs review."""
    v = verified.select(key, "status", F.col("confidence").alias("_c"), "adjusted")
    out = candidates_.join(v, key, "left").withColumn("severity", F.coalesce("adjusted", "severity"))
    out = out.withColumn("band", F.when(F.col("_c").isNotNull(), confidence_band(F.col("_c"))).otherwise(F.col("band")))
    return out.withColumn("next_round", F.coalesce(F.col("status") == "needs_review", F.lit(False))).drop("_c", "adjusted")


def assembled(findings: DataFrame, evidence: DataFrame, deep: DataFrame) -> DataFrame:
    """(candidate_id, source, evidence_type, confidence, weight) of all that speaks for or against a candidate.

    ``findings`` has candidate_id, source and band; ``evidence`` candidate_id,
    source, evidence_type and confidence, of known sources only; ``deep``
    candidate_id, has_path, whole_path, confirmed and false_positive.
    """
    source = F.lower("source")
    own = findings.where(source.isin(*SOURCE_TYPE)).select("candidate_id", source.alias("source"), lookup(source, SOURCE_TYPE).alias("evidence_type"), lookup(F.col("band"), BAND_CONFIDENCE, 0.6).alias("confidence"))
    more = evidence.where(source.isin(*SOURCE_TYPE)).select("candidate_id", source.alias("source"), F.coalesce("evidence_type", lookup(source, SOURCE_TYPE)).alias("evidence_type"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    flow = deep.where("has_path").select("candidate_id", F.lit("codeql").alias("source"), F.lit("dataflow_path").alias("evidence_type"), F.when(F.col("whole_path"), 0.8).otherwise(0.6).alias("confidence"))
    verdict = deep.where("confirmed or false_positive").select("candidate_id", F.lit("agent").alias("source"), F.lit("agent_analysis").alias("evidence_type"), F.lit(0.9).alias("confidence"))
    out = reduce(lambda a, b: a.unionByName(b), (own, more, flow, verdict))
    return out.withColumn("weight", lookup(F.col("source"), SOURCE_WEIGHT, 0.5))


def weighed(evidence: DataFrame) -> DataFrame:
    """(candidate_id, n, weighted): pieces of evidence and their mean confidence by weight.

    Confidences count in ten-thousandths and weights in hundredths, as integers,
    so the sums are exact and no order of additions shows; they are divided once.
    """
    parts = F.round(F.col("confidence") * 10_000).cast("bigint")
    weight = F.round(F.col("weight") * 100).cast("bigint")
    return evidence.groupBy("candidate_id").agg(F.count("*").alias("n"), (F.sum(parts * weight).cast("double") / F.sum(weight).cast("double") / 10_000.0).alias("weighted"))


def flow_facts(metadata: Column) -> Column:
    """(source, sink, sanitizers, length) that a finding's JSON metadata tells of its data flow."""
    flag = lambda name: F.coalesce(F.get_json_object(metadata, f"$.{name}").cast("boolean"), F.lit(False))
    steps = F.coalesce(F.size(F.from_json(F.get_json_object(metadata, "$.path"), "array<string>")), F.lit(0))
    guards = F.coalesce(F.size(F.from_json(F.get_json_object(metadata, "$.sanitizers"), "array<string>")), F.lit(0))
    return F.struct(flag("has_source").alias("source"), flag("has_sink").alias("sink"), F.greatest(guards, F.lit(0)).alias("sanitizers"), F.greatest(steps, F.lit(0)).alias("length"))


def transform_score(replaces: Column, encodes: Column, coverage: Column) -> Column:
    """(is_sanitizer, confidence) of a function by what it does: two of three signs."""
    signs = replaces.cast("int") + encodes.cast("int") + (coverage > 0.5).cast("int")
    sure = F.when(replaces, 0.4).otherwise(0.0) + F.when(encodes, 0.3).otherwise(0.0) + coverage * 0.3
    return F.struct((signs >= 2).alias("is_sanitizer"), F.round(F.least(F.lit(1.0), sure), 6).alias("confidence"))


def type_score(safe_return: Column, decorated: Column, guard: Column) -> Column:
    """(is_sanitizer, confidence) of a function by its types: a safe return type or a decorator."""
    sure = F.when(safe_return, 0.5).otherwise(0.0) + F.when(decorated, 0.4).otherwise(0.0) + F.when(guard, 0.1).otherwise(0.0)
    return F.struct((safe_return | decorated).alias("is_sanitizer"), F.round(F.least(F.lit(1.0), sure), 6).alias("confidence"))


def function_features(body: Column) -> Column:
    """(replaces, encodes, safe_return, decorated, guard) read from the text of a function."""
    has = lambda rx: F.regexp_like(body, F.lit(rx))
    return F.struct(
        has(r"\.replace\(|re\.sub\(|replaceAll\(").alias("replaces"), has(r"(?i)(html|url|base64)?\.?(escape|encode|quote)\w*\(").alias("encodes"), has(r"->\s*['\"]?(Safe\w*|Markup|int|float|bool|UUID)\b").alias("safe_return"),
        has(r"(?m)^\s*@\w*(saniti[sz]e|validate|escape)\w*").alias("decorated"), has(r"\bisinstance\(|\bTypeGuard\b").alias("guard"),
    )


def known_sanitizer(name: Column) -> Column:
    """0.9 where a known sanitizer's name stands in a function's last part, else null."""
    return F.when(F.regexp_like(F.lower(F.substring_index(name, ".", -1)), F.lit("|".join(KNOWN_SANITIZERS))), 0.9)


def node_evidence(nodes: DataFrame) -> DataFrame:
    """(node, method, confidence, full) of every way in which a node counts as a sanitizer; ``nodes`` has node, name, transform and type."""
    parts = [F.when(F.col(c)["is_sanitizer"], F.struct(F.lit(c).alias("method"), F.col(c)["confidence"].alias("confidence"))) for c in ("transform", "type")]
    known = known_sanitizer(F.col("name"))
    every = F.array_compact(F.array(*parts, F.when(known.isNotNull(), F.struct(F.lit("name").alias("method"), known.alias("confidence")))))
    return nodes.select("node", F.explode(every).alias("e")).select("node", "e.method", "e.confidence", (F.col("e.confidence") >= 0.8).alias("full"))


def attack_confidence(kind: Column, code: Column, dataflow: Column, surface: Column) -> Column:
    """First confidence of the attacker: half, moved by type, words, data flow and surface."""
    low = F.lower(F.coalesce(code, F.lit("")))
    words = sum((F.when(F.contains(low, F.lit(w)), F.lit(v)).otherwise(0.0) for w, v in ATTACK_WORDS.items()), F.lit(0.0))
    extra = F.when(kind.isin(*SEVERE_TYPES), 0.1).otherwise(0.0) + F.when(F.contains(dataflow, F.lit("->")), 0.05).otherwise(0.0) + F.when((surface != "") & (surface != "internal"), 0.1).otherwise(0.0)
    return F.round(_clamped(0.5 + extra + words), 6)


def defence_confidence(sanitizers: Column, validations: Column, framework: Column) -> Column:
    """First confidence of the defender by the numbers of defences found."""
    capped = lambda n, top, w: F.least(n, F.lit(top)) * w
    return F.round(F.least(F.lit(0.9), 0.1 + capped(sanitizers, 3, 0.2) + capped(validations, 3, 0.1) + capped(framework, 2, 0.15)), 6)


def debate_goes_on(verdict: Column, attack: Column, defence: Column, confidence: Column, gap: float = 0.2, sure: float = 0.6) -> Column:
    """Why a debate goes on, joined; null where its verdict is decisive or nothing speaks for more."""
    apart = F.abs(attack - defence)
    decisive = ~verdict.isin("needs_review", "conditional") & (confidence >= 0.7) & (apart >= 0.3)
    reasons = F.concat_ws(",", F.when(verdict == "needs_review", "needs_review"), F.when(apart < gap, "strength_difference"), F.when(confidence < sure, "confidence"))
    return F.when(decisive, F.lit(None)).otherwise(F.nullif(reasons, F.lit("")))


def within_budget(groups: DataFrame, seconds: int | None = None, tokens: int | None = None, per_target: int = 5000) -> DataFrame:
    """Groups (level, targets, timeout_s, agent) of a strategy made to fit: the low one goes if time is short; the agent leaves low, medium, then high ones until tokens suffice."""
    rank = lookup(F.col("level"), {"low": 0, "medium": 1, "high": 2}, 3)
    rows = groups.withColumn("_rank", rank)
    if seconds is not None:
        # one row for each of a few levels
        rows = rows.withColumn("_time", F.sum("timeout_s").over(Window.partitionBy())).where((F.col("_time") <= seconds) | (F.col("_rank") > 0)).drop("_time")
    if tokens is not None:
        above = Window.partitionBy(F.lit(1)).orderBy("_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        used = F.sum(F.when(F.col("agent"), F.col("targets")).otherwise(0)).over(above) * per_target
        rows = rows.withColumn("_used", used).withColumn("agent", F.col("agent") & ((F.col("_rank") > 2) | (F.col("_used") <= tokens))).drop("_used")
    return rows.drop("_rank")


def evolved(strategies: DataFrame, outcomes: DataFrame, key: str = "strategy") -> DataFrame:
    """Strategies (strategy, used, wins) with the outcomes (strategy, won) of a round added; unknown ones are new."""
    n = outcomes.groupBy(key).agg(F.count("*").alias("_used"), F.count_if("won").alias("_wins"))
    both = strategies.join(n, key, "full_outer")
    total = lambda a, b: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("bigint").alias(a)
    return both.select(key, total("used", "_used"), total("wins", "_wins"))
