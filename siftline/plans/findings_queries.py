"""Queries over findings: filters, scores, merging, budgets, consistency, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import decisions as dc
from ..operators import dedup as dd
from ..operators import findings as fd
from ..operators import intel as it
from ..operators.dims import RISK_WEIGHT, SEVERITIES, lookup, severity_rank
from .bindings import twin, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table loader under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = twin(sql)
        return f

    return add


SCORE = """CAST(round(((CASE severity WHEN 'critical' THEN 1.0e0 WHEN 'high' THEN 0.8e0 WHEN 'medium' THEN 0.6e0 WHEN 'low' THEN 0.4e0 WHEN 'info' THEN 0.2e0 ELSE 0.5e0 END) * 0.4e0
  + (CASE exploitability WHEN 'exploitable' THEN 1.0e0 WHEN 'likely' THEN 0.7e0 WHEN 'possible' THEN 0.5e0 WHEN 'unlikely' THEN 0.3e0 WHEN 'not_exploitable' THEN 0.0e0 ELSE 0.5e0 END) * 0.4e0
  + coalesce(greatest(0.0e0, least(1.0e0, confidence)), 0.7e0) * 0.2e0) * (CASE source WHEN 'agent' THEN 1.2e0 WHEN 'codeql' THEN 1.0e0 WHEN 'semgrep' THEN 0.8e0 ELSE 1.0e0 END), 6) AS DOUBLE)"""
STATUS = """CASE WHEN exploitability IN ('not_exploitable', 'safe') THEN 'not_exploitable' WHEN exploitability IN ('exploitable', 'confirmed') AND severity IN ('high', 'critical') THEN 'exploitable' ELSE 'conditional' END"""
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"
REPORT = """CASE WHEN coalesce(suppressed, false) OR coalesce(filtered_by IN ('finding_budget', 'rule_gating', 'ast_validator', 'file_filter'), false) THEN 'suppressed'
  WHEN final_status = 'exploitable' THEN 'exploitable' WHEN final_status = 'conditional' THEN 'conditional' WHEN final_status IN ('informational', 'not_exploitable') THEN 'informational' ELSE 'conditional' END"""
NORM = r"""lower(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(trim(coalesce({0}, '')), '\s+', ' ', 'g'), '"', ''''), '\', '/'), '\$\{{?[a-zA-Z_][a-zA-Z0-9_]*\}}?', '$X', 'g'), '\{{\{{[a-zA-Z_][a-zA-Z0-9_]*\}}\}}', '{{{{X}}}}', 'g'), '''[^'']*''', '''X''', 'g'))"""
HASH = f"""concat('ast_', substr(sha256(concat_ws('|', coalesce(rule_id, 'unknown'), lower(regexp_replace(replace(trim(coalesce(file, '')), '\\', '/'), '^(\\./|/)+', '')),
  regexp_replace(lower(trim(coalesce(function, ''))), '^(self|this|cls)\\.', ''), {NORM.format("coalesce(sink, function)")}, '',
  CASE WHEN cwe IS NOT NULL THEN concat('cwe:', cwe) ELSE concat('rule:', coalesce(rule_id, 'unknown')) END, '')), 1, 16))"""
SCORED = f"scored AS (SELECT *, {SCORE} AS final_score, {STATUS} AS final_status FROM findings)"
HASHED = f"{SCORED}, hashed AS (SELECT *, {HASH} AS ast_hash FROM scored)"
MERGED = f"""{HASHED}, placed AS (SELECT *, row_number() OVER (PARTITION BY ast_hash ORDER BY final_score DESC,
  CASE source WHEN 'agent' THEN 1.0e0 WHEN 'codeql' THEN 0.9e0 WHEN 'semgrep' THEN 0.8e0 ELSE 0.5e0 END DESC,
  CASE exploitability WHEN 'exploitable' THEN 4 WHEN 'likely' THEN 3 WHEN 'possible' THEN 2 WHEN 'unlikely' THEN 1 WHEN 'not_exploitable' THEN 0 WHEN 'unknown' THEN 2 ELSE 0 END DESC, input_seq) AS rn,
  count(*) OVER (PARTITION BY ast_hash) - 1 AS duplicate_count FROM hashed),
  engines AS (SELECT ast_hash, string_agg(DISTINCT source, ',' ORDER BY source) AS related_engines FROM hashed GROUP BY ast_hash),
  merged AS (SELECT p.*, e.related_engines FROM placed p JOIN engines e USING (ast_hash) WHERE rn = 1)"""


def scored(df: DataFrame) -> DataFrame:
    return df.withColumn("final_score", dc.final_score()).withColumn("final_status", dc.final_status())


def merged(df: DataFrame) -> DataFrame:
    return dd.merge_groups(scored(df).withColumn("ast_hash", dd.semantic_hash()))


@query(f"WITH {MERGED}, s AS (SELECT *, {REPORT} AS report_status FROM merged) SELECT report_status, severity, count(*) AS n, CAST(sum(duplicate_count) AS BIGINT) AS duplicates, round(max(final_score), 6) AS top_score FROM s GROUP BY 1, 2")
def flagship_report(t):
    """Score, adjudicate, merge across engines, map to report status, count."""
    s = merged(t("findings")).withColumn("report_status", fd.report_status())
    return s.groupBy("report_status", "severity").agg(F.count("*").alias("n"), F.sum("duplicate_count").cast("bigint").alias("duplicates"), F.round(F.max("final_score"), 6).alias("top_score"))


@query("SELECT id, severity FROM findings WHERE severity IN ('critical', 'high')")
def flt1_by_severity(t):
    return fd.by_severity(t("findings"), ["critical", "high"]).select("id", "severity")


@query(f"SELECT id, severity FROM findings WHERE {RANK} <= 2")
def flt2_at_least_medium(t):
    return fd.at_least(t("findings"), "medium").select("id", "severity")


@query("SELECT DISTINCT file FROM findings ORDER BY file")
def flt4_unique_files(t):
    return fd.distinct_files(t("findings"))


@query("SELECT id FROM findings WHERE NOT (coalesce(suppressed, false) OR coalesce(filtered_by IN ('finding_budget', 'rule_gating', 'ast_validator', 'file_filter'), false))")
def flt5_unsuppressed(t):
    return t("findings").where(~fd.suppressed()).select("id")


@query(f"WITH {SCORED} SELECT id, {REPORT} AS report_status FROM scored WHERE {REPORT} IN ('exploitable', 'conditional')")
def flt6_actionable(t):
    return fd.actionable(scored(t("findings")).withColumn("report_status", fd.report_status())).select("id", "report_status")


@query("SELECT id, CASE WHEN severity = 'info' THEN 'info_level' WHEN severity = 'low' THEN 'low_severity' WHEN confidence < 0.3e0 THEN 'low_confidence' END AS skip_reason FROM findings")
def flt27_skip_reason(t):
    return t("findings").select("id", fd.skip_reason().alias("skip_reason"))


@query(f"SELECT id, {SCORE} AS final_score FROM findings")
def exp1_final_score(t):
    return t("findings").select("id", dc.final_score().alias("final_score"))


@query(f"SELECT id, CASE WHEN s >= 0.8e0 THEN 'critical' WHEN s >= 0.6e0 THEN 'high' WHEN s >= 0.4e0 THEN 'medium' WHEN s >= 0.2e0 THEN 'low' ELSE 'skip' END AS level FROM (SELECT id, {SCORE} AS s FROM findings)")
def exp14_audit_level(t):
    return t("findings").select("id", dc.audit_level(dc.final_score()).alias("level"))


@query("SELECT id, CASE WHEN confidence < 0.2e0 THEN 'needs_review' WHEN s >= 0.6e0 THEN 'exploitable' WHEN s <= 0.3e0 THEN 'not_exploitable' WHEN s >= 0.45e0 THEN 'conditional' ELSE 'unlikely' END AS derived FROM (SELECT id, confidence, " + SCORE + " AS s FROM findings)")
def exp5_derived_status(t):
    return t("findings").select("id", dc.derived_status(dc.final_score(), F.col("confidence")).alias("derived"))


FUSE = "CASE WHEN id % 3 = 0 THEN NULL ELSE confidence END AS a, CASE WHEN id % 5 = 0 THEN NULL ELSE (id % 10) / 10.0e0 END AS b, CASE WHEN id % 7 < 3 THEN NULL ELSE (id % 4) / 4.0e0 END AS c"


@query(f"""SELECT id, round(coalesce((coalesce(a * 0.5e0, 0.0e0) + coalesce(b * 0.3e0, 0.0e0) + coalesce(c * 0.2e0, 0.0e0)) / nullif((CASE WHEN a IS NULL THEN 0.0e0 ELSE 0.5e0 END) + (CASE WHEN b IS NULL THEN 0.0e0 ELSE 0.3e0 END) + (CASE WHEN c IS NULL THEN 0.0e0 ELSE 0.2e0 END), 0.0e0), 0.5e0), 6) AS weighted,
  coalesce(least(a, b, c), 0.5e0) AS conservative, coalesce(greatest(a, b, c), 0.5e0) AS optimistic FROM (SELECT id, {FUSE} FROM findings)""")
def exp2_exp3_fusion(t):
    df = t("findings").selectExpr("id", *FUSE.replace("AS a, ", "AS a|").replace("AS b, ", "AS b|").split("|"))
    s = [F.col(c) for c in "abc"]
    w = [0.5, 0.3, 0.2]
    return df.select("id", F.round(dc.fused(s, w), 6).alias("weighted"), dc.fused(s, w, "conservative").alias("conservative"), dc.fused(s, w, "optimistic").alias("optimistic"))


@query(f"""SELECT id, {STATUS} AS final_status, coalesce(exploitability IN ('not_exploitable', 'safe') OR (severity IN ('high', 'critical') AND exploitability IN ('unlikely', 'exploitable', 'confirmed', 'likely')), false) AS override_applied FROM findings""")
def exp9_adjudication(t):
    return t("findings").select("id", dc.final_status().alias("final_status"), dc.override_applied().alias("override_applied"))


@query(f"WITH {SCORED} SELECT final_status, count(*) AS n, count(*) FILTER (WHERE coalesce(exploitability = 'not_exploitable' AND final_status = 'exploitable', false)) AS conflicts FROM scored GROUP BY 1")
def agg9_exp10_adjudication_summary(t):
    return scored(t("findings")).groupBy("final_status").agg(F.count("*").alias("n"), F.count_if(dc.status_conflict()).alias("conflicts"))


@query(f"WITH {SCORED} SELECT id, {REPORT} AS report_status FROM scored")
def exp11_report_status(t):
    return scored(t("findings")).select("id", fd.report_status().alias("report_status"))


@query(f"""WITH {SCORED}, r AS (SELECT id, CASE WHEN (exploitability IN ('not_exploitable', 'safe') AND other <> 'not_exploitable') OR (exploitability IN ('exploitable', 'confirmed') AND other = 'not_exploitable') THEN 'rule_1_mismatch' END AS a,
  CASE WHEN other = 'exploitable' AND {RANK} > 2 THEN 'rule_2_severity' END AS b, CASE WHEN other = 'informational' AND {RANK} <= 1 THEN 'rule_5_warning' END AS c
  FROM (SELECT *, CASE id % 4 WHEN 0 THEN 'exploitable' WHEN 1 THEN 'informational' WHEN 2 THEN 'not_exploitable' ELSE final_status END AS other FROM scored))
  SELECT id, rule FROM (SELECT id, a AS rule FROM r UNION ALL SELECT id, b FROM r UNION ALL SELECT id, c FROM r) WHERE rule IS NOT NULL""")
def exp12_row_consistency(t):
    other = F.when(F.col("id") % 4 == 0, "exploitable").when(F.col("id") % 4 == 1, "informational").when(F.col("id") % 4 == 2, "not_exploitable").otherwise(F.col("final_status"))
    return dc.row_conflicts(scored(t("findings")).withColumn("final_status", other))


@query(f"""WITH {SCORED}, lv AS (SELECT concat_ws('|', rule_id, file) AS logical_id, source, input_seq, final_status, CASE final_status WHEN 'exploitable' THEN 3 WHEN 'conditional' THEN 2 ELSE 0 END AS level FROM scored),
  e AS (SELECT logical_id, source, arg_min(level, input_seq) AS f, min(level) AS lo, max(level) AS hi, bool_or(final_status = 'exploitable') AS y, bool_or(final_status = 'not_exploitable') AS no_, count(*) AS n FROM lv GROUP BY 1, 2)
  SELECT logical_id, CAST(sum(n) AS BIGINT) AS findings, count(*) AS engines, bool_or(y) AND bool_or(no_) AS rule_2_conflict, max(f) > 2 AND min(f) < 2 AND count(*) > 1 AS rule_3_conflict, max(hi) - min(lo) >= 2 AS rule_4_conflict FROM e GROUP BY 1""")
def agg11_group_consistency(t):
    return dc.group_conflicts(scored(t("findings")).withColumn("logical_id", F.concat_ws("|", "rule_id", "file")))


@query(f"WITH {HASHED} SELECT id, ast_hash FROM hashed")
def set3_semantic_hash(t):
    return scored(t("findings")).select("id", dd.semantic_hash().alias("ast_hash"))


@query("SELECT id, substr(sha256(concat_ws('|', coalesce(rule_id, 'unknown'), concat_ws(':', file, CAST(line AS VARCHAR)), coalesce(sink, ''))), 1, 16) AS logical_id FROM findings")
def set11_logical_id(t):
    return t("findings").select("id", dd.logical_id().alias("logical_id"))


@query(f"WITH {MERGED} SELECT ast_hash, id, final_score, duplicate_count, related_engines FROM merged")
def agg7_win3_merge(t):
    return merged(t("findings")).select("ast_hash", "id", "final_score", "duplicate_count", "related_engines")


@query(f"WITH {HASHED} SELECT ast_hash, count(*) AS n FROM hashed GROUP BY 1 HAVING count(*) > 1")
def agg8_duplicate_groups(t):
    return dd.duplicate_groups(t("findings").withColumn("ast_hash", dd.semantic_hash()))


@query("SELECT id, rule_id, file, line FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, file, line ORDER BY input_seq) AS rn FROM findings) WHERE rn = 1")
def win1_line_dedup(t):
    return fd.first_of_key(t("findings"), ["rule_id", "file", "line"]).select("id", "rule_id", "file", "line")


@query("""SELECT id, coalesce(max(CASE WHEN confidence >= 0.7e0 THEN 1 ELSE 0 END) OVER (PARTITION BY type, file ORDER BY input_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS duplicate
  FROM (SELECT id, input_seq, type, confidence, regexp_extract(file, '([^/]*/[^/]*)$', 1) AS file FROM findings)""")
def set4_similar_skip(t):
    return fd.similar_skips(t("findings")).select("id", "duplicate")


@query("""WITH r AS (SELECT rule_id, count(*) AS n FROM findings GROUP BY 1), f AS (SELECT file, count(*) AS n FROM findings GROUP BY 1), c AS (SELECT (SELECT CAST(sum(n) AS BIGINT) FROM r) AS total, (SELECT max(n) FROM r) AS max_rule, (SELECT max(n) FROM f) AS max_file, (SELECT count(*) FROM r WHERE n > 50) AS rules_over)
  SELECT total, max_rule, max_file, rules_over, CASE WHEN total > 1500 OR max_rule > 200 OR max_file > 300 THEN 'meltdown' WHEN rules_over >= 3 THEN 'throttled' ELSE 'normal' END AS mode FROM c""")
def win7_budget_mode(t):
    return dd.budget_mode(t("findings"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY input_seq) AS rr FROM findings), b AS (SELECT *, min(input_seq) OVER (PARTITION BY rule_id) AS rs FROM a WHERE rr <= 50),
  c AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY rs, input_seq) AS fr FROM b) SELECT id, rule_id, file FROM c WHERE fr <= 80 ORDER BY rs, input_seq LIMIT 1000""")
def win4_win6_budget(t):
    return dd.apply_budget(t("findings")).select("id", "rule_id", "file")


@query("SELECT severity, count(*) AS kept FROM findings WHERE severity IN ('critical', 'high') AND NOT contains(lower(rule_id), 'generic') AND NOT contains(lower(rule_id), 'audit') GROUP BY 1")
def win7_meltdown(t):
    generic = F.contains(F.lower("rule_id"), F.lit("generic")) | F.contains(F.lower("rule_id"), F.lit("audit"))
    return fd.by_severity(t("findings"), ["critical", "high"]).where(~generic).groupBy("severity").agg(F.count("*").alias("kept"))


@query("SELECT d.severity, count(f.id) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) d(severity) LEFT JOIN findings f ON f.severity = d.severity AND f.confidence > 0.5e0 GROUP BY 1")
def agg2_zero_filled(t):
    return fd.zero_filled_counts(t("findings").where("confidence > 0.5"), "severity", SEVERITIES)


@query("SELECT file, CASE min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS highest FROM findings GROUP BY 1")
def agg4_highest_severity(t):
    return t("findings").groupBy("file").agg(F.coalesce(F.min_by("severity", severity_rank(F.col("severity"))), F.lit("info")).alias("highest"))


@query("SELECT file, CAST(sum(CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 50 WHEN 'medium' THEN 20 WHEN 'low' THEN 5 ELSE 1 END) AS BIGINT) AS risk FROM findings GROUP BY 1")
def agg25_risk_sum(t):
    return t("findings").groupBy("file").agg(F.sum(lookup(F.col("severity"), RISK_WEIGHT, 1)).cast("bigint").alias("risk"))


@query("SELECT rule_id AS value, n FROM (SELECT rule_id, count(*) AS n FROM findings GROUP BY 1) ORDER BY n DESC, rule_id LIMIT 3")
def agg6_top_rules(t):
    return it.most_common(t("findings"), "rule_id", 3, "value")


@query(f"SELECT id, severity FROM findings ORDER BY {RANK}, input_seq LIMIT 100")
def srt1_by_severity(t):
    return fd.sort_by_severity(t("findings")).limit(100).select("id", "severity")


@query(f"WITH {SCORED}, s AS (SELECT *, {REPORT} AS report_status FROM scored) SELECT id, report_status FROM s ORDER BY CASE report_status WHEN 'exploitable' THEN 4 WHEN 'conditional' THEN 3 WHEN 'informational' THEN 2 ELSE 1 END DESC, input_seq LIMIT 50 ")
def srt2_by_report_status(t):
    return fd.sort_by_report_status(scored(t("findings")).withColumn("report_status", fd.report_status())).limit(50).select("id", "report_status")


@query(f"WITH {SCORED} SELECT id, final_score FROM scored ORDER BY final_score DESC, input_seq LIMIT 100 OFFSET 20")
def srt3_srt9_by_score(t):
    return fd.sort_by_score(scored(t("findings"))).offset(20).limit(100).select("id", "final_score")


@query("SELECT severity, source, count(*) AS n, round(avg(confidence), 6) AS mean FROM findings GROUP BY ROLLUP (severity, source)")
def ext_rollup(t):
    return t("findings").rollup("severity", "source").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


@query(r"SELECT id, " + NORM.format("sink") + r" AS code, regexp_replace(lower(trim(coalesce(function, ''))), '^(self|this|cls)\.', '') AS func, lower(regexp_replace(replace(trim(coalesce(file, '')), '\', '/'), '^(\./|/)+', '')) AS path FROM findings")
def fun6_fun7_normalise(t):
    return t("findings").select("id", tx.normalize_code(F.col("sink")).alias("code"), tx.normalize_function(F.col("function")).alias("func"), tx.normalize_path(F.col("file")).alias("path"))


@query("SELECT a.id, b.id AS other_id FROM findings a JOIN findings b ON a.file = b.file AND a.rule_id = b.rule_id AND a.source = 'semgrep' AND b.source = 'codeql' AND abs(a.line - b.line) <= 5 WHERE b.id = (SELECT min(c.id) FROM findings c WHERE c.file = a.file AND c.rule_id = a.rule_id AND c.source = 'codeql' AND abs(c.line - a.line) <= 5)")
def jon8_win16_band_join(t):
    df = t("findings")
    return fd.first_near(df.where("source = 'semgrep'"), df.where("source = 'codeql'"), 5)


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE suppressed) AS suppressed, count(DISTINCT file) AS files, count(DISTINCT rule_id) AS rules, round(avg(confidence), 6) AS mean, max(line) AS last_line FROM findings GROUP BY 1""")
def agg19_agg30_source_statistics(t):
    return fd.source_statistics(t("findings"))


@query("SELECT id, source, severity FROM findings WHERE source = 'agent' UNION ALL SELECT id, source, severity FROM findings WHERE source = 'codeql' AND severity = 'high'")
def set1_union_engines(t):
    df = t("findings")
    return fd.union_engines({"agent": df.where("source = 'agent'").drop("source"), "codeql": df.where("source = 'codeql' and severity = 'high'").drop("source")}).select("id", "source", "severity")


@query("""SELECT file, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, string_agg(DISTINCT source, ',' ORDER BY source) AS engines FROM findings GROUP BY 1 ORDER BY critical DESC, high DESC, file LIMIT 20""")
def srt10_recommended_files(t):
    return fd.files_in_time(t("findings"), 20)


@query("SELECT id, rule_id, n FROM (SELECT id, rule_id, row_number() OVER (PARTITION BY rule_id ORDER BY input_seq DESC) AS n FROM findings) WHERE n <= 10")
def win17_recent_history(t):
    return fd.recent_history(t("findings"), "rule_id", 10).select("id", "rule_id", "n")
