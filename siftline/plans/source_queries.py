"""Queries that read documents made from the driver's tables back through the sources, and further operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import classify as cl
from ..operators import decisions as dc
from ..operators import dedup as dd
from ..operators import graph as gr
from ..sources import manifests as mf
from ..sources import reports as rp
from . import table_queries
from .findings_queries import SCORE

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


def _document(column: Column) -> Column:
    return F.to_json(column).alias("value")


@query("""SELECT rule_id, file, line, line + 2 AS end_line, CASE source WHEN 'semgrep' THEN 'high' WHEN 'codeql' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN type = 'vulnerability' THEN 'vulnerability' ELSE 'suspicious' END AS type,
  CASE id % 3 WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.7e0 ELSE 0.5e0 END AS confidence, cwe, concat('m', CAST(id AS VARCHAR)) AS message FROM findings""")
def src7_pattern_match_documents(t):
    meta = F.struct(
        F.when(F.col("type") == "vulnerability", "security").otherwise("style").alias("category"), F.to_json(F.array("cwe")).alias("cwe"), F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), (F.col("id") % 3 + 1).cast("int")).alias("confidence")
    )
    level = F.when(F.col("source") == "semgrep", "ERROR").when(F.col("source") == "codeql", "WARNING").otherwise("INFO")
    extra = F.struct(F.concat(F.lit("m"), F.col("id").cast("string")).alias("message"), level.alias("severity"), meta.alias("metadata"))
    result = F.struct(F.col("rule_id").alias("check_id"), F.col("file").alias("path"), F.struct(F.col("line")).alias("start"), F.struct((F.col("line") + 2).alias("line")).alias("end"), extra.alias("extra"))
    docs = t("findings").groupBy("file").agg(F.collect_list(result).alias("results")).select(_document(F.struct("results")))
    return rp.pattern_matches(docs).drop("owasp")


@query("SELECT rule_id, concat('src/', CAST(id AS VARCHAR)) AS file, line, CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS steps, id % 2 = 0 AS complete, CASE WHEN id % 2 = 0 THEN line + 9 ELSE line END AS sink_line FROM findings")
def src8_src9_sarif_documents(t):
    def place(line):
        return F.struct(F.struct(F.struct(F.concat(F.lit("file://src/"), F.col("id").cast("string")).alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation"))

    line = F.col("line")
    flow = F.array(F.struct(F.array(F.struct(F.array(F.struct(place(line).alias("location")), F.struct(place(line + 9).alias("location"))).alias("locations"))).alias("threadFlows")))
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.array(place(line)).alias("locations"), F.when(F.col("id") % 2 == 0, flow).alias("codeFlows"))
    docs = t("findings").groupBy("file").agg(F.collect_list(result).alias("results")).select(_document(F.struct(F.array(F.struct("results")).alias("runs"))))
    out = rp.sarif_results(docs)
    return out.select("rule_id", "file", "line", "severity", F.size("steps").alias("steps"), "complete", F.element_at("steps", -1)["line"].alias("sink_line"))


@query("SELECT CAST(cve_id AS VARCHAR) AS cve_id, CAST(vendor AS VARCHAR) AS vendor, published AS added, has_poc AS ransomware FROM cves WHERE kev")
def src14_exploited_catalogue(t):
    v = F.struct(F.col("cve_id").cast("string").alias("cveID"), F.col("vendor").cast("string").alias("vendorProject"), F.lit("p").alias("product"), F.col("published").cast("string").alias("dateAdded"), F.when(F.col("has_poc"), "Known").otherwise("Unknown").alias("knownRansomwareCampaignUse"))
    docs = t("cves").where("kev").groupBy((F.col("cve_id") % 10).alias("g")).agg(F.collect_list(v).alias("vulnerabilities")).select(_document(F.struct("vulnerabilities")))
    return rp.exploited_catalogue(docs).drop("product")


@query("SELECT concat('A-', CAST(input_seq AS VARCHAR)) AS advisory, CASE WHEN input_seq % 3 = 0 THEN concat('CVE-2024-', CAST(input_seq AS VARCHAR)) ELSE concat('A-', CAST(input_seq AS VARCHAR)) END AS cve_id, CASE WHEN input_seq % 2 = 0 THEN '>=1.0.0,<2.0.0' ELSE '>=1.0.0' END AS ranges FROM deps")
def src16_advisory_documents(t):
    seq = F.col("input_seq").cast("string")
    event = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    events = F.when(F.col("input_seq") % 2 == 0, F.array(event("introduced", "1.0.0"), event("fixed", "2.0.0"))).otherwise(F.array(event("introduced", "1.0.0")))
    alias = F.array(F.lit("X-1"), F.when(F.col("input_seq") % 3 == 0, F.concat(F.lit("CVE-2024-"), seq)).otherwise(F.lit("X-2")))
    doc = F.struct(F.concat(F.lit("A-"), seq).alias("id"), alias.alias("aliases"), F.array(F.struct(F.array(F.struct(events.alias("events"))).alias("ranges"))).alias("affected"))
    return rp.advisories(t("deps").select(_document(doc))).withColumn("ranges", F.array_join("ranges", ","))


@query("SELECT replace(lower(concat('Pkg_', CAST(input_seq AS VARCHAR))), '_', '-') AS name, CASE input_seq % 4 WHEN 0 THEN '==' WHEN 1 THEN '>=' WHEN 2 THEN '~=' END AS operator, CASE WHEN input_seq % 4 < 3 THEN concat(CAST(input_seq % 9 AS VARCHAR), '.1') END AS version FROM deps")
def src23_requirement_lines(t):
    seq = F.col("input_seq")
    op = F.when(seq % 4 == 0, "==").when(seq % 4 == 1, " >= ").when(seq % 4 == 2, "~=")
    line = F.concat(F.lit("Pkg_"), seq.cast("string"), F.coalesce(F.concat(op, (seq % 9).cast("string"), F.lit(".1")), F.lit("")), F.when(seq % 5 == 0, "  # note").otherwise(""))
    files = t("deps").groupBy((seq % 20).cast("string").alias("path")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    return mf.requirements(files).select("name", "operator", "version")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE o_orderkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'deleted' END AS change, CAST(o_orderkey % 50 AS INT) AS additions, CAST(o_orderkey % 7 AS INT) AS deletions FROM orders")
def src26_jon17_git_changes(t):
    o = t("orders")
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(F.lit("A"), F.lit("M"), F.lit("D")), (key % 3 + 1).cast("int"))
    raw = o.select(F.concat(F.lit(":100644 100644 abc def "), kind, F.lit("\t"), key.cast("string")).alias("line"))
    num = o.select(F.concat_ws("\t", (key % 50).cast("string"), (key % 7).cast("string"), key.cast("string")).alias("line"))
    return mf.git_changes(raw.unionByName(num)).select("path", "change", "additions", "deletions")


@query("SELECT CASE o_orderkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'deleted' END AS change, count(*) AS files, CAST(sum(o_orderkey % 50) AS BIGINT) AS additions FROM orders GROUP BY 1")
def agg20_diff_totals(t):
    kind = F.element_at(F.array(F.lit("added"), F.lit("modified"), F.lit("deleted")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return t("orders").groupBy(kind.alias("change")).agg(F.count("*").alias("files"), F.sum(F.col("o_orderkey") % 50).cast("bigint").alias("additions"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'CVE-2020-1234,CVE-2021-5555' ELSE '' END AS cves, CASE p_partkey % 4 WHEN 0 THEN 'dos' WHEN 1 THEN 'webapp' WHEN 2 THEN 'remote' ELSE 'other' END AS poc_type FROM part")
def src15_exploit_rows(t):
    k = F.col("p_partkey")
    rows = t("part").select(k.alias("id"), F.when(k % 3 == 0, "cve-2020-1234;CVE-2021-5555;cve-2020-1234;OSVDB-3").otherwise("none").alias("codes"), F.element_at(F.array(*map(F.lit, ("DOS", "webapps", "remote", "shellcode"))), (k % 4 + 1).cast("int")).alias("type"), F.lit("2020-01-01").alias("date"))
    return rp.exploit_rows(rows).select("id", F.array_join("cve_ids", ",").alias("cves"), "poc_type")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(could not resolve|no matching distribution|module not found|cannot find package)') THEN 'missing_dependency' WHEN regexp_matches(text, '(?i)(permission denied|access is denied)') THEN 'permission' ELSE 'ok' END AS health FROM (SELECT doc_id, concat(CASE doc_id % 5 WHEN 0 THEN 'Could not RESOLVE x ' WHEN 1 THEN 'Permission denied ' ELSE '' END, text) AS text FROM documents)")
def exp29_health_classes(t):
    k = F.col("doc_id") % 5
    text = F.concat(F.when(k == 0, "Could not RESOLVE x ").when(k == 1, "Permission denied ").otherwise(""), "text")
    return t("documents").select("doc_id", cl.first_match(text, cl.HEALTH, "ok").alias("health"))


@query("SELECT s_nationkey AS project, CASE min(CASE s_suppkey % 13 WHEN 0 THEN 0 WHEN 3 THEN 3 WHEN 5 THEN 4 WHEN 7 THEN 7 END) WHEN 0 THEN 'maven' WHEN 3 THEN 'go' WHEN 4 THEN 'npm' WHEN 7 THEN 'make' ELSE 'unknown' END AS build_system FROM supplier GROUP BY 1")
def exp30_build_system(t):
    k = F.col("s_suppkey") % 13
    name = F.when(k == 0, "pom.xml").when(k == 3, "go.mod").when(k == 5, "package.json").when(k == 7, "Makefile").otherwise("x.txt")
    return cl.build_system(t("supplier").select(F.col("s_nationkey").alias("project"), name.alias("name")))


@query("SELECT id, CASE WHEN id % 3 = 0 AND NOT (id % 4 = 0) THEN true ELSE false END AS sensitive FROM findings")
def flt32_flt33_sensitive(t):
    key = F.when(F.col("id") % 3 == 0, "db.Password").otherwise("db.name")
    value = F.when(F.col("id") % 4 == 0, "changeme1234").otherwise("s3cr3tVal-99")
    return t("findings").select("id", cl.sensitive(key, value).alias("sensitive"))


@query("SELECT id, round((CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) / 5.0e0, 6) AS coverage FROM findings")
def fun25_char_coverage(t):
    escaped = F.array_compact(F.array(F.when(F.col("id") % 2 == 0, "<"), F.when(F.col("id") % 2 == 0, ">"), F.when(F.col("id") % 3 == 0, "&"), F.lit("z")))
    return t("findings").select("id", cl.coverage(escaped, "xss").alias("coverage"))


@query("""WITH g AS (SELECT candidate_id, sum(confidence * weight) / sum(weight) AS w, count(DISTINCT source) AS s, bool_or(is_false_positive) AND bool_or(confidence >= 0.8e0) AS bad, count(*) >= 3 AS complete FROM evidence GROUP BY 1),
  a AS (SELECT *, least(1.0e0, greatest(0.0e0, w + CASE WHEN s >= 3 THEN 0.1e0 WHEN s >= 2 THEN 0.05e0 ELSE 0.0e0 END)) AS x FROM g), b AS (SELECT *, least(1.0e0, greatest(0.0e0, least(1.0e0, x + s * 0.05e0) - CASE WHEN bad THEN 0.15e0 ELSE 0.0e0 END)) AS y FROM a)
  SELECT candidate_id, CAST(floor(least(1.0e0, y + CASE WHEN complete THEN 0.1e0 ELSE 0.0e0 END) * 10000 + 0.2718e0) AS BIGINT) AS per_10000 FROM b""")
def agg14_correlation_confidence(t):
    g = t("evidence").groupBy("candidate_id").agg(
        (F.sum(F.col("confidence") * F.col("weight")) / F.sum("weight")).alias("w"), F.countDistinct("source").alias("s"), (F.bool_or("is_false_positive") & F.bool_or(F.col("confidence") >= 0.8)).alias("bad"), (F.count("*") >= 3).alias("complete")
    )
    confidence = cl.correlation_confidence(F.col("w"), F.col("s"), F.col("s"), ~F.col("bad"), F.col("complete"))
    # an offset that is no half keeps exact ties from rounding apart
    return g.select("candidate_id", F.floor(confidence * 10000 + 0.2718).alias("per_10000"))


@query("SELECT finding_id, round, coalesce(lag(tokens) OVER w IS NOT NULL AND (tokens < 1 OR tokens < lag(tokens) OVER w * 0.5e0), false) AS diminishing FROM debate WINDOW w AS (PARTITION BY finding_id ORDER BY round)")
def win9_diminishing_returns(t):
    return cl.diminishing(t("debate"), "finding_id", "round", "tokens").select("finding_id", "round", "diminishing")


@query(f"WITH l AS (SELECT CASE WHEN s >= 0.8e0 THEN 'critical' WHEN s >= 0.6e0 THEN 'high' WHEN s >= 0.4e0 THEN 'medium' WHEN s >= 0.2e0 THEN 'low' ELSE 'skip' END AS level FROM (SELECT {SCORE} AS s FROM findings)) SELECT level, count(*) AS targets, CASE level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS parallel, CAST(least(1800, greatest(60, count(*) * 30)) AS BIGINT) AS timeout_s FROM l GROUP BY 1")
def exp15_group_limits(t):
    return cl.group_limits(t("findings").select(dc.audit_level(dc.final_score()).alias("level")))


@query("SELECT rule_id, string_agg(file, ',' ORDER BY file) AS files FROM (SELECT rule_id, file, row_number() OVER (PARTITION BY rule_id ORDER BY last DESC, file) AS rn FROM (SELECT rule_id, file, max(input_seq) AS last FROM findings GROUP BY 1, 2)) WHERE rn <= 5 GROUP BY 1")
def win18_recent_distinct(t):
    g = t("findings").groupBy("rule_id", "file").agg(F.max("input_seq").alias("last"))
    top = g.withColumn("rn", F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("last"), "file"))).where("rn <= 5")
    return top.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))


@query("SELECT vuln_id, rule_id, min(line) AS line FROM (SELECT vuln_id, rule_id, line FROM baseline UNION ALL SELECT input_seq, rule_id, line FROM current WHERE input_seq NOT IN (SELECT vuln_id FROM baseline)) GROUP BY 1, 2")
def set7_baseline_update(t):
    new = t("current").select(F.col("input_seq").alias("vuln_id"), "rule_id", "line")
    return dd.upsert(t("baseline").select("vuln_id", "rule_id", "line"), new, "vuln_id", [])


@query("WITH RECURSIVE w(entry, node, depth) AS (SELECT s, s, 0 FROM (SELECT DISTINCT src AS s FROM edges WHERE src % 25 = 1) UNION SELECT w.entry, e.dst, w.depth + 1 FROM w JOIN edges e ON e.src = w.node WHERE w.depth < 3) SELECT entry, node AS changed, CAST(min(depth) AS INT) AS depth FROM w WHERE node % 10 = 4 GROUP BY 1, 2")
def grf16_critical_paths(t):
    e = gr._cut(t("edges"))  # seeds and edges are both read from it
    found = gr.closure(e, e.where("src % 25 = 1").select(F.col("src").alias("seed")).distinct(), 3, F.col("node") % 10 == 4)
    return found.select(F.col("seed").alias("entry"), F.col("node").alias("changed"), "depth")


@query("SELECT f.input_seq, f.path, concat('pkg.mod', CAST(f.input_seq % 50 AS VARCHAR)) AS name, concat('pkg/mod', CAST(f.input_seq % 50 AS VARCHAR), '.py') AS target FROM files f WHERE f.input_seq % 50 IN (SELECT input_seq FROM files WHERE input_seq % 2 = 0)")
def jon10_jon11_import_targets(t):
    imports = t("files").select("input_seq", "path", F.concat(F.lit("pkg.mod"), (F.col("input_seq") % 50).cast("string")).alias("name"))
    files = t("files").where("input_seq % 2 = 0").select(F.concat(F.lit("pkg/mod"), F.col("input_seq").cast("string"), F.lit(".py")).alias("path"))
    return cl.import_targets(imports, files).join(imports, ["path", "name"]).select("input_seq", "path", "name", "target")


@query("SELECT l_suppkey AS caller, l_partkey % 500 AS callee FROM lineitem WHERE l_partkey % 500 IN (SELECT s_suppkey FROM supplier) GROUP BY ALL")
def jon13_valid_callees(t):
    calls = t("lineitem").select(F.col("l_suppkey").alias("caller"), (F.col("l_partkey") % 500).alias("callee")).distinct()
    return gr.valid_callees(calls, t("supplier").select(F.col("s_suppkey").alias("callee"))).select("caller", "callee")
