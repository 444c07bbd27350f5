"""Queries over audit targets, tasks, debates, gating and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import rounds as rd
from ..operators import strategy as st
from . import table_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """As in table_queries, registered here."""

    def add(f):
        table_queries.query(sql)(f)
        QUERIES[f.__name__] = table_queries.QUERIES.pop(f.__name__)
        if sql:
            ORACLES[f.__name__] = table_queries.ORACLES.pop(f.__name__)
        return f

    return add


SURFACE = """least(1.0e0, greatest(0.0e0, (CASE WHEN entry_point_type IS NULL THEN 0.0e0 ELSE 0.4e0 * CASE entry_point_type WHEN 'http' THEN 0.8e0 WHEN 'rpc' THEN 0.7e0 WHEN 'mq' THEN 0.6e0 WHEN 'cron' THEN 0.4e0 ELSE 0.5e0 END END)
  + (CASE WHEN http_method IS NULL THEN 0.0e0 ELSE 0.3e0 * CASE upper(http_method) WHEN 'POST' THEN 0.9e0 WHEN 'GET' THEN 0.6e0 ELSE 0.5e0 END END) + (CASE WHEN auth_required THEN -0.05e0 ELSE 0.15e0 END)
  + (CASE WHEN n_params > 5 THEN 0.1e0 WHEN n_params > 0 THEN 0.05e0 * n_params / 5 ELSE 0.0e0 END)
  + (CASE WHEN regexp_matches(lower(file_path), 'auth|login|password|credential|token|session|payment|checkout|transfer|admin|config|secret|api|upload|download|import|export|query') THEN 0.05e0 ELSE 0.0e0 END)))"""
TECH = """least(1.0e0, greatest(0.0e0, (CASE WHEN framework IS NULL THEN 0.4e0 ELSE (0.4e0 + CASE lower(framework) WHEN 'flask' THEN 0.55e0 WHEN 'struts' THEN 0.9e0 WHEN 'gin' THEN 0.5e0 ELSE 0.5e0 END) / 2 END) + (CASE WHEN language = 'php' THEN 0.15e0 WHEN language = 'go' THEN -0.05e0 ELSE 0.0e0 END)))"""


@query(f"SELECT id, round({SURFACE} * 0.35e0 + {TECH} * 0.25e0 + complexity * 0.2e0 + history * 0.2e0, 6) AS score FROM targets")
def exp14_audit_priority(t):
    return t("targets").select("id", st.priority(F.col("complexity"), F.col("history")).alias("score"))


@query("SELECT id FROM targets WHERE NOT regexp_matches(lower(file_path), 'test|spec|mock|fixture|example|sample|docs|readme|changelog|license|__pycache__|node_modules|vendor')")
def flt28_audit_skip(t):
    return t("targets").where(~st.skipped(F.col("file_path"))).select("id")


@query("SELECT id, file_path FROM targets WHERE NOT auth_required AND entry_point_type = 'rpc' AND upper(http_method) = 'GET'")
def flt29_unauthenticated(t):
    return t("targets").where(~F.col("auth_required") & (F.col("entry_point_type") == "rpc") & (F.upper("http_method") == "GET")).select("id", "file_path")


@query("""SELECT id, CASE WHEN regexp_matches(lower(file_path), 'auth|login|password|token') THEN 'auth_check' WHEN regexp_matches(lower(file_path), 'crypto|encrypt|cipher|key') THEN 'crypto_audit' WHEN regexp_matches(lower(file_path), 'config|settings|env') THEN 'config_review' WHEN regexp_matches(lower(file_path), 'api|route|controller|handler') THEN 'api_security' ELSE 'file_scan' END AS task FROM targets""")
def aux4_task_type(t):
    return t("targets").select("id", st.file_task(F.col("file_path")).alias("task"))


@query("SELECT id, task FROM (SELECT id, 'scan' AS task, n_params FROM targets UNION ALL SELECT id, 'auth', n_params FROM targets WHERE NOT auth_required AND entry_point_type IS NOT NULL) WHERE n_params > 0")
def aux3_targets_to_tasks(t):
    extra = F.when(~F.col("auth_required") & F.col("entry_point_type").isNotNull(), "auth")
    return t("targets").where("n_params > 0").select("id", F.explode(F.array_compact(F.array(F.lit("scan"), extra))).alias("task"))


@query("SELECT printf('entry-%04d', CAST(row_number() OVER (ORDER BY id) - 1 AS INT)) AS target, id FROM targets WHERE entry_point_type = 'cron'")
def aux1_entry_ids(t):
    rows = t("targets").where("entry_point_type = 'cron'")
    return rd.numbered(rows.select("id"), [F.col("id")]).select(F.format_string("entry-%04d", F.col("n") - 1).alias("target"), "id")


@query("SELECT id, coalesce(CASE WHEN contains(lower(rule_id), 'xss') THEN 'xss' WHEN contains(cwe, '79') THEN 'xss' WHEN contains(cwe, '89') THEN 'sqli' END, 'generic') AS vuln_type FROM findings")
def exp8_vulnerability_type(t):
    return t("findings").select("id", st.vulnerability_type("generic").alias("vuln_type"))


@query("""SELECT id, severity, new AS adjusted FROM (SELECT id, severity, CASE WHEN exploitability = 'not_exploitable' THEN 'info' WHEN exploitability = 'unlikely' THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE 'info' END ELSE severity END AS new FROM findings) WHERE new <> severity""")
def exp7_severity_adjustment(t):
    return t("findings").select("id", "severity", st.adjusted_severity().alias("adjusted")).where("adjusted is not null")


@query("""WITH a AS (SELECT finding_id, round, confidence, row_number() OVER w AS n, sum(tokens) OVER w AS used, coalesce(greatest(confidence, lag(confidence, 1) OVER w) <= lag(confidence, 2) OVER w + 0.05e0, false) AS stalled FROM debate WINDOW w AS (PARTITION BY finding_id ORDER BY round)),
  f AS (SELECT finding_id, round, row_number() OVER (PARTITION BY finding_id ORDER BY round) AS n, row_number() OVER (PARTITION BY finding_id, role ORDER BY round) = 1 AS fresh FROM debate),
  s AS (SELECT finding_id, round, n - max(CASE WHEN fresh THEN n END) OVER (PARTITION BY finding_id ORDER BY round ROWS UNBOUNDED PRECEDING) AS stable_rounds FROM f)
  SELECT a.finding_id, a.round, CASE WHEN n < 2 THEN NULL WHEN n >= 5 THEN 'max_rounds' WHEN confidence >= 0.85e0 THEN 'high_confidence' WHEN confidence < 0.05e0 THEN 'decisive_verdict' WHEN abs(confidence - 0.5e0) >= 0.35e0 THEN 'strength_gap' WHEN stable_rounds >= 2 THEN 'strategy_stable' WHEN stalled THEN 'no_progress' WHEN used >= 50000 THEN 'cost_limit' END AS reason
  FROM a JOIN s ON s.finding_id = a.finding_id AND s.round = a.round""")
def exp18_convergence(t):
    d = rd.since_new(rd.no_progress(t("debate"), "finding_id", "round", "confidence"), "finding_id", "round", "role")
    w = Window.partitionBy("finding_id").orderBy("round")
    d = d.withColumn("n", F.row_number().over(w)).withColumn("tokens_used", F.sum("tokens").over(w)).withColumn("decisive", F.col("confidence") < 0.05).withColumn("gap", F.abs(F.col("confidence") - 0.5))
    return d.select("finding_id", "round", st.convergence().alias("reason"))


@query("SELECT finding_id, arg_min(confidence, round) AS first_confidence, arg_max(confidence, round) AS last_confidence, arg_max(role, round) AS last_role, count(DISTINCT role) AS roles, CAST(sum(tokens) AS BIGINT) AS tokens FROM debate GROUP BY 1")
def aux18_progress_summary(t):
    return t("debate").groupBy("finding_id").agg(
        F.min_by("confidence", "round").alias("first_confidence"), F.max_by("confidence", "round").alias("last_confidence"), F.max_by("role", "round").alias("last_role"), F.countDistinct("role").alias("roles"), F.sum("tokens").cast("bigint").alias("tokens")
    )


@query("SELECT finding_id, round, CASE WHEN d >= 0.4e0 THEN 'confirmed' WHEN d <= -0.4e0 THEN 'false_positive' WHEN d >= 0.2e0 THEN 'likely' ELSE 'needs_review' END AS verdict FROM (SELECT finding_id, round, confidence - (tokens % 50) / 50.0e0 AS d FROM debate)")
def exp19_heuristic_verdict(t):
    return t("debate").select("finding_id", "round", st.heuristic_verdict(F.col("confidence"), (F.col("tokens") % 50) / 50).alias("verdict"))


@query("SELECT user_id AS strategy, round(CASE WHEN count(*) > 0 THEN 0.6e0 * (count(*) FILTER (WHERE event_type = 'click') / CAST(count(*) AS DOUBLE)) + 0.2e0 * 0.5e0 + 0.2e0 * 0.25e0 ELSE 0.5e0 END, 6) AS fitness FROM events GROUP BY 1 ORDER BY fitness DESC, strategy LIMIT 10")
def srt7_srt8_fitness(t):
    g = t("events").groupBy(F.col("user_id").alias("strategy")).agg(F.count("*").alias("used"), F.count_if(F.col("event_type") == "click").alias("wins"))
    return g.select("strategy", st.fitness(F.col("used"), F.col("wins"), F.lit(0.5), F.lit(0.25)).alias("fitness")).orderBy(F.desc("fitness"), "strategy").limit(10)


@query("""WITH s AS (SELECT id, CASE id % 3 WHEN 0 THEN 'sqli' WHEN 1 THEN 'xss' ELSE 'cmdi' END AS vuln_type, CASE line % 4 WHEN 0 THEN 'escape' WHEN 1 THEN 'bind' ELSE 'quote' END AS category, CASE line % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'ineffective' END AS effect FROM findings),
  r(vuln_type, category) AS (VALUES ('sqli', 'bind'), ('xss', 'escape'), ('cmdi', 'quote'))
  SELECT s.id, CASE WHEN bool_or(r.category IS NOT NULL AND effect = 'full') THEN 'full' WHEN bool_or(r.category IS NOT NULL AND effect = 'partial') THEN 'partial' ELSE 'ineffective' END AS effect FROM s LEFT JOIN r ON r.vuln_type = s.vuln_type AND r.category = s.category GROUP BY 1""")
def exp25_sanitizer_effect(t):
    pick = lambda c, n, *v: F.element_at(F.array(*map(F.lit, v)), (F.least(F.col(c) % n, F.lit(len(v) - 1)) + 1).cast("int"))
    s = t("findings").select("id", pick("id", 3, "sqli", "xss", "cmdi").alias("vuln_type"), pick("line", 4, "escape", "bind", "quote").alias("category"), pick("line", 5, "full", "partial", "ineffective").alias("effect"))
    relevant = s.sparkSession.createDataFrame([("sqli", "bind"), ("xss", "escape"), ("cmdi", "quote")], "vuln_type string, category string")
    return st.sanitizer_effect(s, relevant)


@query("SELECT DISTINCT file FROM (SELECT file FROM findings WHERE severity = 'critical' UNION ALL SELECT file FROM findings WHERE source = 'agent') WHERE file NOT IN (SELECT file FROM findings WHERE line > 485)")
def set8_changed_files(t):
    f = t("findings")
    both = f.where("severity = 'critical'").select("file").unionByName(f.where("source = 'agent'").select("file")).distinct()
    return both.join(f.where("line > 485").select("file").distinct(), "file", "left_anti")


@query("WITH p AS (SELECT rule_id, list_sort(list_distinct(list(CASE severity WHEN 'critical' THEN 'core' WHEN 'high' THEN 'web' WHEN 'medium' THEN 'sql' WHEN 'low' THEN 'xml' ELSE 'misc' END))) AS packs FROM findings GROUP BY 1) SELECT rule_id, array_to_string(list_filter(packs, lambda x: x NOT IN ('web', 'core')), ',') AS dropped FROM p")
def set9_flt24_rule_packs(t):
    pack = F.when(F.col("severity") == "critical", "core").when(F.col("severity") == "high", "web").when(F.col("severity") == "medium", "sql").when(F.col("severity") == "low", "xml").otherwise("misc")
    packs = t("findings").groupBy("rule_id").agg(F.collect_set(pack).alias("packs"))
    return packs.select("rule_id", F.array_join(st.rule_packs(F.array(F.lit("web")), F.col("packs"), F.array(F.lit("core"))), ",").alias("dropped"))


@query("SELECT vendor, severity, n, round(100.0e0 * n / sum(n) OVER (PARTITION BY vendor), 2) AS pct FROM (SELECT vendor, severity, count(*) AS n FROM cves GROUP BY 1, 2)")
def agg26_distribution(t):
    g = t("cves").groupBy("vendor", "severity").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("vendor")), 2))


@query("SELECT coalesce(exploitability, 'error') AS status, count(*) AS n, round(100.0e0 * count(*) / (SELECT count(*) FROM findings), 2) AS pct FROM findings GROUP BY 1")
def agg35_phase_totals(t):
    f = t("findings")
    g = f.groupBy(F.coalesce("exploitability", F.lit("error")).alias("status")).agg(F.count("*").alias("n"))
    total = f.agg(F.count("*").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("status", "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("pct"))


@query("SELECT candidate_id, arg_min(source, seq * 1000000 + k) AS first_source, arg_max(source, seq * 1000000 + k) AS last_source, count(*) AS steps, count(*) >= 2 AS complete FROM (SELECT candidate_id, source, seq, ascii(evidence_type) AS k FROM evidence) GROUP BY 1 HAVING count(DISTINCT seq * 1000000 + k) = count(*)")
def win19_path_ends(t):
    e = t("evidence").withColumn("k", F.col("seq") * 1000000 + F.ascii("evidence_type"))
    g = e.groupBy("candidate_id").agg(F.min_by("source", "k").alias("first_source"), F.max_by("source", "k").alias("last_source"), F.count("*").alias("steps"), F.countDistinct("k").alias("d"))
    return g.where("steps = d").select("candidate_id", "first_source", "last_source", "steps", (F.col("steps") >= 2).alias("complete"))


@query("SELECT candidate_id, seq, source FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY confidence DESC, seq, source, evidence_type, weight) AS rn FROM evidence) WHERE rn <= 2 GROUP BY ALL")
def aux8_evidence_cap(t):
    w = Window.partitionBy("candidate_id").orderBy(F.desc("confidence"), "seq", "source", "evidence_type", "weight")
    return t("evidence").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("candidate_id", "seq", "source").distinct()


@query("SELECT f.id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN g.file IS NOT NULL THEN 'file' ELSE 'none' END AS surface FROM findings f LEFT JOIN (SELECT id FROM findings WHERE function = 'render' AND line % 2 = 0) e ON e.id = f.id LEFT JOIN (SELECT DISTINCT file FROM findings WHERE line = 7) g ON g.file = f.file")
def jon7_attack_surface_match(t):
    """Match by rank: the exact entry point, else any of the file."""
    f = t("findings")
    exact = f.where("function = 'render' and line % 2 = 0").select("id", F.lit(True).alias("e"))
    same = f.where("line = 7").select("file", F.lit(True).alias("g")).distinct()
    return f.join(exact, "id", "left").join(same, "file", "left").select("id", F.when(F.col("e"), "exact").when(F.col("g"), "file").otherwise("none").alias("surface"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/[0-9]+', '/{id}', 'g') AS route, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages")
def fun15_route_of_page(t):
    return t("pages").select("page_id", F.regexp_replace(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1), "/[0-9]+", "/{id}").alias("route"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"))


@query("SELECT event_id AS id, concat(upper(substr(event_type, 1, 1)), substr(event_type, 2)) AS title, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fun12_fun19_titles_and_json(t):
    return t("events").select(F.col("event_id").alias("id"), tx.humanised(F.col("event_type")).alias("title"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
