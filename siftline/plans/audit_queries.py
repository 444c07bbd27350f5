"""Queries over audit sessions and the remaining clean-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as au
from ..operators import decisions as dc
from ..operators import findings as fd
from ..operators import strategy as st
from . import table_queries
from .findings_queries import RANK, SCORE

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


@query("SELECT id, CASE WHEN confidence >= 0.8e0 THEN 'high' WHEN confidence >= 0.5e0 THEN 'medium' ELSE 'low' END AS band FROM findings WHERE confidence >= 0.5e0 OR severity IN ('critical', 'high')")
def flt30_aux11_next_round(t):
    return au.next_round(t("findings")).select("id", au.confidence_band(F.col("confidence")).alias("band"))


METRICS = "SELECT round, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.8e0) AS high, count(*) FILTER (WHERE confidence >= 0.5e0 AND confidence < 0.8e0) AS medium, count(*) FILTER (WHERE confidence < 0.5e0) AS low, round(avg(confidence), 6) AS mean, CAST(sum(tokens) AS BIGINT) AS tokens FROM debate GROUP BY 1"


@query(METRICS)
def agg16_agg17_round_metrics(t):
    return au.round_metrics(t("debate"))


@query(f"WITH m AS ({METRICS}) SELECT round, CASE WHEN round >= 4 THEN 'max_rounds' WHEN n = 0 THEN 'no_candidates' WHEN high / CAST(n AS DOUBLE) >= 0.2e0 THEN 'confidence_threshold' WHEN tokens > 100000 THEN 'resources' END AS reason FROM m")
def exp17_str6_termination(t):
    return au.round_metrics(t("debate")).select("round", au.termination(4, 0.2).alias("reason"))


@query("""WITH h AS (SELECT CASE s_nationkey % 6 WHEN 0 THEN 'flask' WHEN 1 THEN 'spring' WHEN 2 THEN 'gin' WHEN 3 THEN 'express' WHEN 4 THEN 'rails' ELSE 'echo' END AS framework, CASE s_suppkey % 3 WHEN 0 THEN 0.05e0 WHEN 1 THEN 0.01e0 ELSE 0.0e0 END AS weight FROM supplier)
  SELECT framework, round(least(1.0e0, sum(weight)), 6) AS confidence FROM h GROUP BY 1 HAVING round(least(1.0e0, sum(weight)), 6) >= 0.2e0""")
def agg24_framework_confidence(t):
    k = F.col("s_nationkey") % 6
    name = F.element_at(F.array(*map(F.lit, ("flask", "spring", "gin", "express", "rails", "echo"))), (k + 1).cast("int"))
    weight = F.when(F.col("s_suppkey") % 3 == 0, 0.05).when(F.col("s_suppkey") % 3 == 1, 0.01).otherwise(0.0)
    return au.framework_confidence(t("supplier").select(name.alias("framework"), weight.alias("weight")), 0.2)


@query("SELECT count(*) FILTER (WHERE entry_point_type = 'http') AS http, count(*) FILTER (WHERE entry_point_type = 'rpc') AS rpc, count(*) FILTER (WHERE entry_point_type = 'mq') AS mq, count(*) FILTER (WHERE entry_point_type = 'cron') AS cron, count(*) FILTER (WHERE NOT auth_required) AS open FROM targets")
def agg31_attack_surface_counters(t):
    return t("targets").agg(*[F.count_if(F.col("entry_point_type") == k).alias(k) for k in ("http", "rpc", "mq", "cron")], F.count_if(~F.col("auth_required")).alias("open"))


@query("SELECT count(*) AS paths, count(*) FILTER (WHERE steps >= 2) AS complete, count(*) FILTER (WHERE sanitized) AS sanitized, round(avg(steps), 2) AS mean_steps, max(steps) AS longest FROM (SELECT candidate_id, count(*) AS steps, bool_or(evidence_type = 'sanitizer_detected') AS sanitized FROM evidence GROUP BY 1)")
def agg28_agg29_path_statistics(t):
    p = t("evidence").groupBy("candidate_id").agg(F.count("*").alias("steps"), F.bool_or(F.col("evidence_type") == "sanitizer_detected").alias("sanitized"))
    return p.agg(F.count("*").alias("paths"), F.count_if(F.col("steps") >= 2).alias("complete"), F.count_if("sanitized").alias("sanitized"), F.round(F.avg("steps"), 2).alias("mean_steps"), F.max("steps").alias("longest"))


@query(f"WITH u AS (SELECT *, row_number() OVER (PARTITION BY rule_id, file, line ORDER BY input_seq) AS rn FROM findings WHERE source <> 'semgrep') SELECT id, severity FROM u WHERE rn = 1 ORDER BY {RANK}, input_seq LIMIT 300")
def set2_srt4_union_dedup_sort(t):
    f = t("findings")
    both = f.where("source = 'agent'").unionByName(f.where("source = 'codeql'"))
    return fd.sort_by_severity(fd.first_of_key(both, ["rule_id", "file", "line"])).limit(300).select("id", "severity")


@query("SELECT category, file, line, id FROM (SELECT type AS category, file, line, id, row_number() OVER (PARTITION BY type, file, line ORDER BY input_seq) AS rn FROM findings WHERE sink IS NOT NULL) WHERE rn = 1")
def set5_sanitizer_dedup(t):
    f = t("findings").where("sink is not null").withColumnRenamed("type", "category")
    return fd.first_of_key(f, ["category", "file", "line"]).select("category", "file", "line", "id")


@query("SELECT cve_id, min(origin) AS origin FROM (SELECT cve_id, 1 AS origin FROM cves WHERE cve_id % 3 = 0 UNION ALL SELECT cve_id, 2 FROM cves WHERE cve_id % 2 = 0) GROUP BY 1")
def set10_id_union(t):
    c = t("cves")
    both = c.where("cve_id % 3 = 0").select("cve_id", F.lit(1).alias("origin")).unionByName(c.where("cve_id % 2 = 0").select("cve_id", F.lit(2).alias("origin")))
    return fd.first_of_key(both, ["cve_id"], "origin")


@query(f"""WITH s AS (SELECT *, {SCORE} AS final_score, CASE source WHEN 'agent' THEN 1.0e0 WHEN 'codeql' THEN 0.9e0 WHEN 'semgrep' THEN 0.8e0 ELSE 0.5e0 END AS w,
  CASE exploitability WHEN 'exploitable' THEN 4 WHEN 'likely' THEN 3 WHEN 'possible' THEN 2 WHEN 'unlikely' THEN 1 WHEN 'unknown' THEN 2 ELSE 0 END AS e, -({RANK}) AS v FROM findings)
  SELECT a.id, CASE WHEN (a.final_score, a.w, a.e, a.v) > (b.final_score, b.w, b.e, b.v) THEN 1 WHEN (a.final_score, a.w, a.e, a.v) < (b.final_score, b.w, b.e, b.v) THEN -1 ELSE 0 END AS cmp FROM s a JOIN s b ON b.id = a.id + 1""")
def exp13_merge_comparator(t):
    s = t("findings").withColumn("final_score", dc.final_score()).select("id", au.merge_rank().alias("r"))
    b = s.select((F.col("id") - 1).alias("id"), F.col("r").alias("other"))
    return s.join(b, "id").select("id", F.when(F.col("r") > F.col("other"), 1).when(F.col("r") < F.col("other"), -1).otherwise(0).alias("cmp"))


@query("SELECT DISTINCT path FROM (SELECT CAST(o_orderkey AS VARCHAR) AS path FROM orders UNION ALL SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 5 = 0)")
def flt22_changed_paths(t):
    o = t("orders")
    return au.changed_paths(o.select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey").cast("string")).alias("old_path")))


@query("SELECT input_seq, CASE input_seq % 3 WHEN 0 THEN concat('>=', b, ',<', CASE WHEN m > 0 THEN concat(CAST(m + 1 AS VARCHAR), '.0.0') ELSE concat('0.', CAST(n + 1 AS VARCHAR), '.0') END) WHEN 1 THEN concat('>=', b, ',<', CAST(m AS VARCHAR), '.', CAST(n + 1 AS VARCHAR), '.0') ELSE b END AS spec FROM (SELECT input_seq, input_seq % 4 AS m, input_seq % 7 AS n, concat(CAST(input_seq % 4 AS VARCHAR), '.', CAST(input_seq % 7 AS VARCHAR), '.0') AS b FROM deps)")
def fun4_version_clean(t):
    k = F.col("input_seq")
    mark = F.when(k % 3 == 0, "^").when(k % 3 == 1, "~").otherwise("")
    return t("deps").select("input_seq", au.cleaned_range(F.concat(mark, (k % 4).cast("string"), F.lit("."), (k % 7).cast("string"), F.lit(".x"))).alias("spec"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN concat('CWE-', CAST(id % 90 AS VARCHAR)) WHEN id % 3 = 1 THEN concat('CWE-', CAST(id % 50 AS VARCHAR)) END AS cwe FROM findings")
def fun10_weakness(t):
    k = F.col("id")
    tags = F.array(F.lit("security"), F.when(k % 3 == 0, F.concat(F.lit("external/cwe/cwe-0"), (k % 90).cast("string"))).otherwise("x"))
    rule = F.when(k % 3 == 1, F.concat(F.lit("py.CWE_"), (k % 50).cast("string"))).otherwise("py.rule")
    return t("findings").select("id", au.weakness(rule, tags).alias("cwe"))


@query("SELECT vendor, count(*) FILTER (WHERE severity <> 'low' AND kev) AS kept FROM cves GROUP BY 1 HAVING count(*) FILTER (WHERE severity <> 'low' AND kev) > 0")
def flt19_scan_post_filter(t):
    """Low rows leave the nested lists, then dependencies without an exploited one leave the report."""
    lists = t("cves").groupBy("vendor").agg(F.collect_list(F.struct("severity", "kev")).alias("cves"))
    kept = lists.select("vendor", F.filter("cves", lambda c: (c["severity"] != "low") & c["kev"]).alias("cves"))
    return kept.where(F.size("cves") > 0).select("vendor", F.size("cves").cast("bigint").alias("kept"))


@query("SELECT concat_ws(' ', name, CASE WHEN version LIKE 'v%' THEN substr(version, 2) END) AS q, count(*) AS n FROM deps GROUP BY 1")
def fun20_search_query(t):
    plain = F.when(F.col("version").startswith("v"), F.substring("version", 2, 100))
    return t("deps").groupBy(F.concat_ws(" ", "name", plain).alias("q")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN bool_or(contains(html, '<table')) AND bool_or(contains(url, '/en/')) THEN 'web' WHEN bool_or(contains(url, '/en/')) THEN 'api' WHEN bool_or(contains(html, 'main')) THEN 'cli' WHEN bool_or(contains(url, '.html')) THEN 'library' ELSE 'unknown' END AS project_type FROM pages")
def exp27_project_type(t):
    has = lambda c, w: F.contains(c, F.lit(w))
    return st.project_type(t("pages").select(has("html", "<table").alias("html"), has("url", "/en/").alias("routes"), has("html", "main").alias("main"), has("url", ".html").alias("package")))
