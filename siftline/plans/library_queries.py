"""Queries of sources, sinks, structure and pipelines over documents made from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonfix
from ..functions import text as tx
from ..functions import versions as vs
from ..operators import decisions as dc
from ..operators import detectors as dt
from ..operators import dedup as dd
from ..operators import files as fl
from ..operators import findings as fd
from ..operators import graph as gr
from ..operators import intel as it
from ..sources import feeds, manifests, reports, structure, surface
from . import pipelines as pl
from . import table_queries
from .findings_queries import MERGED, RANK, REPORT
from .strategy_queries import SURFACE, TECH

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


def text(column: str) -> Column:
    return F.col(column).cast("string")


def pick(key: Column, *values: str) -> Column:
    """The value at ``key`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


# --- files

EXT = "lower(regexp_extract(path, '(\\.[A-Za-z0-9]+)$', 1))"
SEEN = f"{EXT} IN ('.py', '.go', '.java') AND size <= 5000 AND NOT contains(path, '/vendor/') AND NOT contains(path, '/tests/')"


@query(f"SELECT {EXT} AS language, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS loc FROM files WHERE {SEEN} GROUP BY 1")
def src2_src4_agg32_project_scan(t):
    return dt.project_structure(dt.eligible_files(t("files"), (".py", ".go", ".java"), 5000))


@query(f"SELECT path FROM (SELECT path, input_seq, regexp_extract(lower(path), '([a-z_]+)\\.[a-z]+$', 1) IN ('main', 'app', 'server', 'index', 'router', 'routes', 'controller', 'handler', 'views', 'api') AS e FROM (SELECT input_seq, CASE WHEN input_seq % 7 = 0 THEN concat('/repo/', CAST(input_seq AS VARCHAR), '/app.py') ELSE path END AS path, text, size FROM files) WHERE {SEEN}) ORDER BY e DESC, input_seq LIMIT 50")
def src3_srt11_srt12_prioritised_files(t):
    f = t("files").withColumn("path", F.when(F.col("input_seq") % 7 == 0, F.concat(F.lit("/repo/"), text("input_seq"), F.lit("/app.py"))).otherwise(F.col("path")))
    return fl.prioritised(dt.eligible_files(f, (".py", ".go", ".java"), 5000), 50).select("path")


@query("""WITH r AS (SELECT path AS p, sha256(concat_ws(':', path, CAST(input_seq AS VARCHAR), CAST(size AS VARCHAR))) AS h FROM files), b AS (SELECT substr(sha256(p), 1, 3) AS b, sha256(string_agg(h, '' ORDER BY p, h)) AS h, count(*) AS n FROM r GROUP BY 1)
  SELECT sha256(string_agg(h, '' ORDER BY b)) AS source_hash, CAST(sum(n) AS BIGINT) AS files FROM b""")
def src5_src6_fun16_source_hash(t):
    return fl.source_hash(t("files"), modified="input_seq")


@query("SELECT path FROM (SELECT path, CASE WHEN doc % 3 = 0 THEN 'python' WHEN doc % 3 = 1 THEN 'go' ELSE 'perl' END AS language FROM (SELECT path, input_seq AS doc FROM files)) WHERE language IN ('python', 'go') AND NOT contains(path, '/tests/')")
def flt23_file_filter_plan(t):
    return fl.kept_files(t("files").withColumn("language", pick(F.col("input_seq"), "python", "go", "perl")), ["python", "go"], 1).select("path")


@query("SELECT id, CASE WHEN id % 3 = 0 OR id % 4 = 1 THEN 'valid' ELSE 'literal_only' END AS validity FROM findings")
def flt26_rule_validity(t):
    k = F.col("id")
    return t("findings").select("id", fl.rule_validity(pick(k, "exec($X, ...)", "eval", "system"), k % 4 == 1, F.lit(False)).alias("validity"))


@query("SELECT id, line FROM findings WHERE file = './src/m7.py'")
def flt3_by_file(t):
    return fd.by_file(t("findings"), "./src/m7.py").select("id", "line")


@query("SELECT event_id AS k FROM events WHERE event_id % 3 = 0 OR event_id % 90 > 45")
def snk5_live_cache(t):
    e = F.col("event_id")
    return fl.live(t("events").select(e.alias("k"), F.when(e % 3 != 0, e % 90).alias("expires_at")), F.lit(45)).select("k")


# --- reports and feeds


@query("SELECT rule_id, concat('src/', CAST(id AS VARCHAR)) AS file, line, CASE id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'medium' END AS severity, 1 AS steps, false AS complete FROM findings")
def src10_fun14_sarif_locations(t):
    place = F.struct(F.struct(F.struct(F.concat(F.lit("file://src/"), text("id")).alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), pick(F.col("id"), "error", "warning", "note", "odd").alias("level"), F.array(place).alias("locations"))
    docs = t("findings").groupBy("file", "rule_id").agg(F.collect_list(result).alias("results")).select(F.to_json(F.struct(F.array(F.struct("results")).alias("runs"))).alias("value"))
    return reports.sarif_results(docs).select("rule_id", "file", "line", "severity", F.size("steps").alias("steps"), "complete")


@query("SELECT file, line, CASE WHEN id % 2 = 0 THEN 'high' ELSE 'low' END AS severity, CASE WHEN id % 2 = 0 THEN concat('t', CAST(id AS VARCHAR)) ELSE concat('w', CAST(id AS VARCHAR)) END AS title FROM findings WHERE id % 5 < 4")
def src11_aux28_fun17_model_replies(t):
    """Replies in fences, with a trailing comma, with an open bracket, as suspicious code, and without JSON."""
    k = F.col("id")
    found = F.concat(F.lit('{"findings": [{"title": "t'), text("id"), F.lit('", "severity": "HIGH", "line": '), text("line"))
    doubt = F.concat(F.lit('{"suspicious_code": [{"location": "'), F.col("file"), F.lit(":"), text("line"), F.lit('", "why_suspicious": "w'), text("id"))
    body = F.when(k % 2 == 0, found).otherwise(doubt)
    end = F.when(k % 2 == 0, F.lit("}")).otherwise('"}')
    reply = F.when(k % 5 == 0, F.concat(F.lit("Here:\n```json\n"), body, end, F.lit("]}\n```"))).when(k % 5 == 1, F.concat(body, end, F.lit(",]}"))).when(k % 5 == 2, F.concat(body, end)).when(k % 5 == 3, F.concat(F.lit("sure "), body, end, F.lit("]} bye"))).otherwise("sorry")
    return feeds.model_findings(t("findings").select("file", reply.alias("reply"))).select("file", "line", "severity", "title")


@query("""SELECT concat('CVE-', CAST(cve_id AS VARCHAR)) AS cve_id, description, CASE WHEN cve_id % 3 = 0 THEN cvss END AS cvss_v3, CASE WHEN cve_id % 3 <> 0 THEN cvss END AS cvss_v2,
  CASE WHEN cvss >= 9.0e0 THEN 'critical' WHEN cvss >= 7.0e0 THEN 'high' WHEN cvss >= 4.0e0 THEN 'medium' WHEN cvss > 0 THEN 'low' ELSE 'info' END AS severity, concat('CWE-', CAST(cve_id % 50 AS VARCHAR)) AS cwe, concat('v', CAST(vendor AS VARCHAR), ':p') AS product, published FROM cves""")
def src12_fun18_nvd_records(t):
    metric = F.when(F.col("cvss").isNotNull(), F.array(F.struct(F.struct(F.col("cvss").alias("baseScore")).alias("cvssData"))))
    three = F.col("cve_id") % 3 == 0
    weak = F.array(F.struct(F.array(F.struct(F.lit("en").alias("lang"), F.concat(F.lit("CWE-"), (F.col("cve_id") % 50).cast("string")).alias("value"))).alias("description")))
    cpe = F.struct(F.concat(F.lit("cpe:2.3:a:v"), text("vendor"), F.lit(":p:1.0:*")).alias("criteria"))
    doc = F.struct(
        F.concat(F.lit("CVE-"), text("cve_id")).alias("id"), F.concat(text("published"), F.lit("T01:02:03.000")).alias("published"), F.array(F.struct(F.lit("es").alias("lang"), F.lit("no").alias("value")), F.struct(F.lit("en").alias("lang"), F.col("description").alias("value"))).alias("descriptions"),
        F.struct(F.when(three, metric).alias("cvssMetricV31"), F.when(~three, metric).alias("cvssMetricV2")).alias("metrics"), weak.alias("weaknesses"), F.array(F.struct(F.array(F.struct(F.array(cpe).alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
    )
    r = feeds.nvd_records(t("cves").select(F.to_json(doc).alias("value")))
    return r.select("cve_id", "description", "cvss_v3", "cvss_v2", "severity", F.col("cwe_ids")[0].alias("cwe"), F.col("products")[0].alias("product"), F.col("published").cast("date").alias("published"))


@query("""WITH m AS (SELECT min(published) AS lo, max(published) AS hi FROM cves), w AS (SELECT CAST(unnest(generate_series(0, CAST(floor(datediff('day', lo, hi) / 120) AS INT))) AS INT) AS k, lo, hi FROM m),
  d AS (SELECT k, CAST(lo + k * 120 AS DATE) AS first_day, CAST(least(hi, lo + k * 120 + 119) AS DATE) AS last_day FROM w), c AS (SELECT d.*, count(c.cve_id) AS total FROM d LEFT JOIN cves c ON c.published BETWEEN d.first_day AND d.last_day GROUP BY ALL)
  SELECT first_day, last_day, CAST(unnest(generate_series(0, CAST(floor(greatest(total - 1, 0) / 50) AS INT))) * 50 AS BIGINT) AS start_index FROM c""")
def src13_paged_windows(t):
    """Every page of every window of days between the first and the last date, by the records each window holds."""
    return feeds.paged_windows(t("cves").select("published"), 120, 50)


@query("SELECT concat('G-', CAST(input_seq AS VARCHAR)) AS advisory, CASE WHEN input_seq % 3 = 0 THEN concat('CVE-', CAST(input_seq AS VARCHAR)) ELSE concat('G-', CAST(input_seq AS VARCHAR)) END AS cve_id, 'high' AS severity, name AS product, '>=1.0,<2.0' AS ranges FROM deps")
def src17_github_advisories(t):
    seq = text("input_seq")
    doc = F.struct(
        F.concat(F.lit("G-"), seq).alias("ghsa_id"), F.when(F.col("input_seq") % 3 == 0, F.concat(F.lit("CVE-"), seq)).alias("cve_id"), F.lit("HIGH").alias("severity"),
        F.array(F.struct(F.struct(F.lit("pip").alias("ecosystem"), F.col("name")).alias("package"), F.lit(">= 1.0, < 2.0").alias("vulnerable_version_range"))).alias("vulnerabilities"),
    )
    a = feeds.github_advisories(t("deps").select(F.to_json(doc).alias("value")))
    return a.select("advisory", "cve_id", "severity", F.col("products")[0].alias("product"), F.col("ranges")[0].alias("ranges"))


@query("SELECT id, module FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'host/x/y' WHEN 1 THEN 'host/x/y/z' WHEN 2 THEN 'host/x/yz' ELSE 'host/x' END AS module FROM part) WHERE module = 'host/x/y' OR starts_with(module, 'host/x/y/') ORDER BY id LIMIT 50")
def src18_go_modules(t):
    rows = t("part").select(F.col("p_partkey").alias("id"), pick(F.col("p_partkey"), "host/x/y", "host/x/y/z", "host/x/yz", "host/x").alias("module"))
    return feeds.go_modules_affected(rows, "host/x/y")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'CVE-2020-1234' ELSE '' END AS ids, p_partkey % 5 = 0 OR p_size >= 40 AS verified FROM part WHERE p_size >= 3 AND (p_partkey % 3 = 0 OR p_partkey % 4 = 1)")
def src19_poc_repositories(t):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "cve-2020-1234 check").when(k % 4 == 1, "Exploit of x").otherwise("tool")
    repos = t("part").select(k.alias("id"), name.alias("name"), F.when(k % 5 == 0, "Rapid7").otherwise("me").alias("owner"), F.lit("text").alias("description"), F.when(F.col("p_size") >= 40, F.lit(100)).otherwise(F.col("p_size")).alias("stars"))
    return feeds.poc_repositories(repos, 3).select("id", F.array_join("cve_ids", ",").alias("ids"), "verified")


@query("""WITH u AS (SELECT 'a' AS engine, page_id, url, (page_id * 7 % 100) / 100.0e0 AS relevance FROM pages UNION ALL SELECT 'b', page_id, url, (page_id * 11 % 100) / 100.0e0 FROM pages)
  SELECT engine, page_id, relevance FROM (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY relevance DESC, url, page_id) AS rn FROM u) WHERE rn <= 10""")
def src20_src21_udf9_search_union(t):
    hits = lambda m: t("pages").select("page_id", F.concat("url", F.lit(" "), F.lpad(text("page_id"), 12, "0")).alias("url"), F.lit("t CVE-2020-0001").alias("title"), F.lit("").alias("snippet"), ((F.col("page_id") * m % 100) / 100).alias("relevance"))
    return feeds.search_union({"a": hits(7), "b": hits(11)}).select("engine", "page_id", "relevance")


@query("SELECT CAST(CAST(floor(input_seq / 20) AS BIGINT) AS VARCHAR) AS path, concat('n', CAST(input_seq AS VARCHAR)) AS name, concat('^', CAST(input_seq % 9 AS VARCHAR)) AS version, input_seq % 4 = 1 AS is_dev, input_seq % 4 = 3 AS is_optional FROM deps")
def src22_npm_manifests(t):
    k = F.col("input_seq")
    entry = F.struct(F.concat(F.lit("n"), text("input_seq")).alias("key"), F.concat(F.lit("^"), (k % 9).cast("string")).alias("value"))
    parts = [F.map_from_entries(F.collect_list(F.when(k % 4 == n, entry))).alias(name) for n, name in enumerate(("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"))]
    docs = t("deps").groupBy(F.floor(k / 20).cast("bigint").cast("string").alias("path")).agg(*parts)
    return manifests.npm_manifest(docs.select("path", F.to_json(F.struct(*[c for c in docs.columns if c != "path"])).alias("content")))


@query("SELECT CAST(CAST(floor(input_seq / 20) AS BIGINT) AS VARCHAR) AS path, concat('host.org/m', CAST(input_seq AS VARCHAR)) AS name, CASE WHEN input_seq % 3 = 0 THEN 'v2.0.0' ELSE 'v1.0.0' END AS version, input_seq % 2 = 0 AS is_direct, CASE WHEN input_seq % 3 = 0 THEN 1.0e0 ELSE 0.5e0 END AS confidence FROM deps")
def src24_jon19_go_modules(t):
    k = F.col("input_seq")
    name = F.concat(F.lit("host.org/m"), text("input_seq"))
    line = F.concat(F.lit("\t"), name, F.lit(" v1.0.0"), F.when(k % 2 == 0, "").otherwise(" // indirect"))
    files = t("deps").groupBy(F.floor(k / 20).cast("bigint").cast("string").alias("path")).agg(F.concat(F.lit("module m\nrequire (\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n)")).alias("content"))
    sums = t("deps").where("input_seq % 3 = 0").select(name.alias("name"), F.lit("v2.0.0").alias("version"))
    return manifests.go_modules(files, sums).select("path", "name", "version", "is_direct", "confidence")


@query("SELECT CAST(CAST(floor(input_seq / 20) AS BIGINT) AS VARCHAR) AS path, concat('g:a', CAST(input_seq AS VARCHAR)) AS name, CASE input_seq % 3 WHEN 0 THEN '3.2' WHEN 1 THEN '${unknown}' ELSE '1.0' END AS version FROM deps")
def src25_jon20_maven(t):
    k = F.col("input_seq")
    dep = F.concat(F.lit("<dependency><groupId>g</groupId><artifactId>a"), text("input_seq"), F.lit("</artifactId><version>"), pick(k, "${lib.version}", "${unknown}", "1.0"), F.lit("</version></dependency>"))
    files = t("deps").groupBy(F.floor(k / 20).cast("bigint").cast("string").alias("path")).agg(F.concat(F.lit("<project><properties><lib.version>3.2</lib.version></properties>"), F.array_join(F.collect_list(dep), ""), F.lit("</project>")).alias("content"))
    return manifests.maven(files)


@query("SELECT CAST(CAST(floor(input_seq / 20) AS BIGINT) AS VARCHAR) AS path, CASE WHEN input_seq % 2 = 0 THEN 'implementation' ELSE 'testImplementation' END AS scope, concat('g:a', CAST(input_seq AS VARCHAR)) AS name, CASE WHEN input_seq % 3 < 2 THEN concat('1.', CAST(input_seq % 9 AS VARCHAR)) END AS version FROM deps")
def aux23_gradle_lines(t):
    k = F.col("input_seq")
    scope = F.when(k % 2 == 0, "implementation").otherwise("testImplementation")
    coordinate = F.concat(F.lit("g:a"), text("input_seq"), F.when(k % 3 < 2, F.concat(F.lit(":1."), (k % 9).cast("string"))).otherwise(""))
    line = F.when(k % 3 == 0, F.concat(F.lit("    "), scope, F.lit(" '"), coordinate, F.lit("'"))).otherwise(F.concat(F.lit("    "), scope, F.lit('("'), coordinate, F.lit('")')))
    files = t("deps").groupBy(F.floor(k / 20).cast("bigint").cast("string").alias("path")).agg(F.concat(F.lit("dependencies {\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n}")).alias("content"))
    return manifests.gradle(files)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS path, concat('host.org/p', CAST(s_suppkey AS VARCHAR)) AS module, CASE WHEN s_suppkey % 3 > 0 THEN concat('1.', CAST(s_suppkey % 9 AS VARCHAR)) END AS go_version FROM supplier")
def aux24_go_directives(t):
    k = F.col("s_suppkey")
    content = F.concat(F.lit("module host.org/p"), k.cast("string"), F.lit("\n\n"), F.when(k % 3 > 0, F.concat(F.lit("go 1."), (k % 9).cast("string"), F.lit("\ngo 9.9\n"))).otherwise(""))
    return manifests.go_directives(t("supplier").select(k.cast("string").alias("path"), content.alias("content")))


@query("SELECT name, operator, version, extras FROM (SELECT concat('pkg-', CAST(input_seq AS VARCHAR)) AS name, CASE input_seq % 3 WHEN 0 THEN '==' WHEN 1 THEN '~=' END AS operator, CASE WHEN input_seq % 3 < 2 THEN concat(CAST(input_seq % 9 AS VARCHAR), '.0') END AS version, CASE WHEN input_seq % 4 = 0 THEN 'a,b' END AS extras FROM deps)")
def fun5_requirement_parse(t):
    k = F.col("input_seq")
    line = F.concat(F.lit("Pkg_"), text("input_seq"), F.when(k % 4 == 0, "[a,b]").otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("== "), (k % 9).cast("string"), F.lit(".0"))).when(k % 3 == 1, F.concat(F.lit(" ~="), (k % 9).cast("string"), F.lit(".0 ; python_version > '3'"))).otherwise(""))
    return manifests.requirements(t("deps").select(F.lit("r").alias("path"), line.alias("content"))).select("name", "operator", "version", "extras")


# --- versions and intelligence


@query("SELECT a.p_partkey AS id, CASE WHEN (a.p_size, a.p_partkey % 10) > (20, 5) THEN 1 WHEN (a.p_size, a.p_partkey % 10) < (20, 5) THEN -1 ELSE 0 END AS cmp FROM part a")
def fun2_version_compare(t):
    v = F.concat(F.lit("v"), text("p_size"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit("-rc1"))
    return t("part").select(F.col("p_partkey").alias("id"), vs.compared(v, F.lit("20.5")).alias("cmp"))


@query("SELECT p_partkey AS id, CAST(p_size AS INT) AS min_major, p_partkey % 2 = 0 AS min_in, CAST(p_size + 3 AS INT) AS max_major, p_partkey % 3 = 0 AS max_in FROM part")
def fun3_version_range_parse(t):
    k = F.col("p_partkey")
    spec = F.concat(F.when(k % 2 == 0, ">=").otherwise("> "), text("p_size"), F.lit(".1, "), F.when(k % 3 == 0, "<=").otherwise("<"), (F.col("p_size") + 3).cast("string"), F.lit(".0.2"))
    b = vs.range_bounds(spec)
    return t("part").select(k.alias("id"), b["min"][0].alias("min_major"), b["min_in"].alias("min_in"), b["max"][0].alias("max_major"), b["max_in"].alias("max_in"))


@query("SELECT f.framework, c.cve_id FROM (VALUES ('urgent'), ('medium'), ('cve-7'), ('specified')) f(framework) JOIN cves c ON contains(lower(c.description), f.framework) OR contains(concat('p-', c.vendor), f.framework)")
def jon3_flt18_framework_cves(t):
    c = t("cves")
    names = c.sparkSession.createDataFrame([("Urgent",), ("medium",), ("CVE-7",), ("specified",)], "name string")
    cves = c.select("cve_id", "description", F.array(F.concat(F.lit("P-"), text("vendor"))).alias("products"), F.array().cast("array<string>").alias("ranges"))
    return it.framework_cves(names, cves).select(F.lower("framework").alias("framework"), "cve_id")


@query("""WITH d AS (SELECT s_suppkey AS input_seq, CASE s_suppkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'maven' ELSE 'pip' END AS ecosystem, CASE s_suppkey % 3 WHEN 0 THEN concat('h.org/x/lib', s_suppkey) WHEN 1 THEN concat('g:lib', s_suppkey) ELSE concat('Lib', s_suppkey) END AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat(s_suppkey % 5, '.5.0') END AS version FROM supplier),
  n AS (SELECT input_seq, version, unnest([lower(name), CASE ecosystem WHEN 'go' THEN list_last(string_split(lower(name), '/')) WHEN 'maven' THEN list_last(string_split(lower(name), ':')) ELSE lower(name) END]) AS needle FROM d),
  c AS (SELECT p_partkey AS cve_id, concat('in lib', p_partkey % 200, ' of x') AS description, p_partkey % 2 = 0 AS ranged, p_partkey % 5 = 0 AS advisory, concat('lib', p_partkey % 90) AS product FROM part)
  SELECT DISTINCT input_seq, cve_id FROM n JOIN c ON CASE WHEN advisory THEN product = needle ELSE contains(concat(description, ' ', product), needle) END WHERE version IS NULL OR NOT ranged OR CAST(split_part(version, '.', 1) AS INT) BETWEEN 1 AND 2""")
def flt17_relevant_cves(t):
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    n = k.cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("h.org/x/lib"), n)).when(k % 3 == 1, F.concat(F.lit("g:lib"), n)).otherwise(F.concat(F.lit("Lib"), n))
    deps = t("supplier").select(k.alias("input_seq"), pick(k, "go", "maven", "pip").alias("ecosystem"), name.alias("name"), F.when(k % 4 != 0, F.concat((k % 5).cast("string"), F.lit(".5.0"))).alias("version"))
    ranges = F.when(p % 2 == 0, F.array(F.lit(">=1.0.0,<3.0.0"))).otherwise(F.array().cast("array<string>"))
    cves = t("part").select(p.alias("cve_id"), F.concat(F.lit("in lib"), (p % 200).cast("string"), F.lit(" of x")).alias("description"), F.array(F.concat(F.lit("Lib"), (p % 90).cast("string"))).alias("products"), ranges.alias("ranges"), (p % 5 == 0).alias("from_advisory"))
    return it.relevant(deps, cves)


@query("SELECT coalesce(o.poc_id, n.poc_id) AS poc_id, CASE WHEN n.poc_id IS NOT NULL THEN n.stars ELSE o.stars END AS stars, CASE WHEN o.poc_id IS NULL THEN n.title ELSE o.title END AS title FROM (SELECT * FROM pocs WHERE poc_id % 3 <> 0) o FULL OUTER JOIN (SELECT poc_id, stars + 1 AS stars, 'new' AS title FROM pocs WHERE poc_id % 4 = 0) n ON o.poc_id = n.poc_id")
def snk2_snk3_poc_upsert(t):
    old = t("pocs").where("poc_id % 3 <> 0").select("poc_id", "stars", "title")
    new = t("pocs").where("poc_id % 4 = 0").select("poc_id", (F.col("stars") + 1).alias("stars"), F.lit("new").alias("title"))
    return dd.upsert(old, new, "poc_id", ["stars"])


@query("SELECT c.cve_id, CASE WHEN c.cve_id % 3 = 0 THEN 'store' ELSE 'feed' END AS origin, CASE WHEN c.cve_id % 3 = 0 THEN c.severity ELSE 'fresh' END AS severity FROM cves c WHERE c.cve_id % 2 = 0 AND (c.cve_id % 3 = 0 OR c.cve_id % 5 = 0)")
def aux20_read_through(t):
    c = t("cves").select("cve_id", "severity")
    return it.read_through(c.where("cve_id % 2 = 0"), c.where("cve_id % 3 = 0"), c.where("cve_id % 5 = 0").withColumn("severity", F.lit("fresh")))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 7 = 3")
def aux22_alias_lookup(t):
    return it.alias_lookup(t("part").select(F.col("p_partkey").alias("id"), F.array(F.lit("X"), F.concat(F.lit("CVE-"), (F.col("p_partkey") % 7).cast("string"))).alias("aliases")), "CVE-3").select("id")


@query("SELECT (SELECT count(*) FROM deps) AS dependencies, count(DISTINCT input_seq) AS vulnerable, count(*) AS findings, bool_or(input_seq % 6 = 0) AS has_critical, bool_or(input_seq % 9 = 0) AS has_exploited FROM deps WHERE input_seq % 3 = 0")
def aux25_security_summary(t):
    k = F.col("input_seq")
    hits = t("deps").where("input_seq % 3 = 0").select("input_seq", F.when(k % 6 == 0, "critical").otherwise("low").alias("severity"), (k % 9 == 0).alias("kev"))
    return it.security_summary(t("deps"), hits)


@query("SELECT source, CAST(n AS BIGINT) AS n, error FROM (SELECT 'kev' AS source, count(*) AS n, '' AS error FROM cves WHERE kev UNION ALL SELECT 'osv', count(*), '' FROM deps UNION ALL SELECT 'broken', 0, 'ValueError')")
def aux21_api2_sync_statistics(t):
    def broken() -> DataFrame:
        raise ValueError("no such feed")

    return pl.sync_all(t("region").sparkSession, {"kev": lambda: t("cves").where("kev"), "osv": lambda: t("deps"), "broken": broken}).select("source", "n", F.substring_index("error", ":", 1).alias("error"))


# --- structure, routes and detectors


def _program(k: Column, n: Column) -> Column:
    """A module of one routed function that calls one of its own, one of another module and one that is nowhere."""
    name = lambda x: F.concat(F.lit("f"), x.cast("string"))
    return F.concat(F.lit("import lib.m"), n.cast("string"), F.lit("\n@app.route('/x')\ndef "), name(k), F.lit("():\n    "), name(n), F.lit("()\n    own()\n    nowhere_at_all()\n\ndef own():\n    pass\n"))


PROGRAMS = "SELECT s_suppkey AS k, (s_suppkey * 7) % (SELECT max(s_suppkey) FROM supplier) + 1 AS n FROM supplier"


def _programs(t) -> DataFrame:
    top = t("supplier").agg(F.max("s_suppkey").alias("top"))
    p = t("supplier").crossJoin(F.broadcast(top)).select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") * 7) % F.col("top") + 1).alias("n"))
    return p.select(F.concat(F.lit("lib/m"), F.col("k").cast("string"), F.lit(".py")).alias("path"), _program(F.col("k"), F.col("n")).alias("content"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT unnest(['function', 'function', 'call', 'call', 'call', 'call', 'import']) AS kind FROM ({PROGRAMS})) GROUP BY 1")
def det9_aux7_structure(t):
    return structure.python_structure(_programs(t)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH p AS ({PROGRAMS}) SELECT concat('lib/m', k, '.py:f', k) AS src, concat('lib/m', n, '.py:f', n) AS dst FROM p UNION SELECT concat('lib/m', k, '.py:f', k), concat('lib/m', k, '.py:own') FROM p")
def grf1_jon12_udf2_call_graph(t):
    return structure.call_graph(structure.python_structure(_programs(t)))[1]


@query(f"SELECT concat('lib/m', k, '.py:f', k) AS id FROM ({PROGRAMS})")
def grf2_entry_points(t):
    return structure.call_graph(structure.python_structure(_programs(t)))[0].where("is_entry").select("id")


@query(f"""WITH p AS ({PROGRAMS}), e AS (SELECT DISTINCT k AS src, n AS dst FROM p WHERE k <> n), d AS (SELECT s.k, (SELECT count(*) FROM e WHERE src = s.k) AS o, (SELECT count(*) FROM e WHERE dst = s.k) AS i FROM p s)
  SELECT concat('lib/m', k, '.py') AS path, CAST(o AS BIGINT) AS out_degree, CAST(i AS BIGINT) AS in_degree, round((o + i) / (SELECT CAST(max(o + i) AS DOUBLE) FROM d), 6) AS centrality FROM d""")
def grf11_file_dependencies(t):
    files = _programs(t)
    imports = structure.python_structure(files).where("kind = 'import'").select("path", "name", "line")
    return gr.file_dependencies(imports, files)[0]


@query("SELECT DISTINCT src, dst FROM edges")
def grf18_graph_documents(t):
    e = t("edges")
    docs = gr.as_documents(e.select(F.col("src").alias("node")).distinct(), e)
    return gr.from_documents(docs, "edge", "src bigint, dst bigint")


@query(f"WITH p AS ({PROGRAMS}) SELECT concat('f', n) AS name, concat('lib/m', k, '.py') AS path, 4 AS line_no FROM p")
def grf19_text_callers(t):
    files = _programs(t)
    names = files.select(F.regexp_extract("content", r"def (f\d+)", 1).alias("name"))
    return gr.text_callers(dt.lines(files, "path", "content"), names)


@query(f"SELECT concat('lib/m', k, '.py') AS path, concat('f', k) AS name FROM ({PROGRAMS}) WHERE ends_with(concat('lib/m', k, '.py'), 'm7.py')")
def grf8_target_nodes(t):
    nodes = structure.python_structure(_programs(t)).where("kind = 'function' and name <> 'own'").select("path", "name", "line")
    return gr.target_nodes(nodes, "m7.py", line=3).select("path", "name")


@query("WITH RECURSIVE w(node, depth) AS (SELECT min(src), 0 FROM edges UNION SELECT e.dst, w.depth + 1 FROM w JOIN edges e ON e.src = w.node WHERE w.depth < 4) SELECT node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY 1")
def grf5_reach_of_one(t):
    e = t("edges")
    one = e.agg(F.min("src").alias("seed"))
    return gr.nearest(e, one, 4).select("node", "depth")


@query("SELECT count(*) AS original_files, count(*) FILTER (WHERE input_seq % 7 = 0) AS incremental_files, count(*) FILTER (WHERE input_seq % 7 <> 0) AS files_saved, round(count(*) / CAST(count(*) FILTER (WHERE input_seq % 7 = 0) AS DOUBLE), 2) AS speedup_factor, round(100.0e0 * count(*) FILTER (WHERE input_seq % 7 <> 0) / count(*), 1) AS time_saved_percent FROM files")
def grf15_speedup(t):
    f = t("files")
    return gr.speedup(f, f.where("input_seq % 7 = 0"))


@query("WITH RECURSIVE w(seed, node, depth) AS (SELECT s, s, 0 FROM (SELECT DISTINCT dst AS s FROM edges WHERE dst % 20 = 5) UNION SELECT w.seed, e.src, w.depth + 1 FROM w JOIN edges e ON e.dst = w.node WHERE w.depth < 5), c AS (SELECT seed, node, min(depth) AS depth FROM w GROUP BY 1, 2), h AS (SELECT seed, min(depth) AS d FROM c WHERE node % 10 = 1 GROUP BY 1) SELECT h.seed AS sink FROM h WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.seed = h.seed AND c.node % 7 = 0 AND c.depth < h.d)")
def flt31_exploitable_sinks(t):
    e = t("edges")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    traces = gr.taint(e, nodes.where("node % 10 = 1").withColumn("kind", F.lit("http")), e.where("dst % 20 = 5").select(F.col("dst").alias("sink")).distinct(), nodes.where("node % 7 = 0").withColumn("confidence", F.lit(0.9)), 5)
    return gr.exploitable_sinks(traces).select("sink")


# --- pipelines and sinks


@query(f"WITH {MERGED}, s AS (SELECT *, {REPORT} AS report_status FROM merged) SELECT severity, report_status, count(*) AS n FROM s WHERE {RANK} <= 2 GROUP BY 1, 2".replace("FROM findings)", f"FROM findings WHERE {RANK} <= 2)"))
def api1_full_scan(t):
    return pl.full_scan(t("findings"), minimum="medium").groupBy("severity", "report_status").agg(F.count("*").alias("n"))


@query(f"WITH {MERGED}, s AS (SELECT *, {REPORT} AS report_status FROM merged) SELECT concat('| ', severity, ' | ', report_status, ' | ', rule_id, ' | ', file, ' | ', line, ' |') AS value FROM s ORDER BY final_score DESC, input_seq LIMIT 50")
def snk6_markdown_report(t):
    return pl.markdown(pl.full_scan(t("findings")))


def _folder(t, name: str) -> str:
    """A fresh folder where the session keeps what its tasks share."""
    spark = t("region").sparkSession
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        gr._cut(spark.range(1))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT source AS report_status, count(*) AS n FROM findings GROUP BY 1")
def snk7_export(t):
    path = _folder(t, "export")
    pl.export_scan(t("findings").select("id", F.col("source").alias("report_status")), path)
    return t("region").sparkSession.read.parquet(path).groupBy("report_status").agg(F.count("*").alias("n"))


@query("SELECT vuln_id, rule_id, true AS fixed FROM baseline")
def snk4_baseline_snapshots(t):
    path = _folder(t, "baseline")
    b = t("baseline").select("vuln_id", "rule_id", "fixed")
    pl.save_snapshot(b, path, 1)
    pl.save_snapshot(b.withColumn("fixed", F.lit(True)), path, 2)
    return pl.load_snapshot(b.sparkSession, path)


@query("""WITH s AS (SELECT o_custkey AS file FROM orders WHERE o_orderkey % 50 = 0), c AS (SELECT * FROM current WHERE file IN (SELECT file FROM s)), b AS (SELECT * FROM baseline WHERE file IN (SELECT file FROM s)),
  m AS (SELECT c.input_seq, arg_min(b.vuln_id, b.baseline_seq) AS vuln_id, arg_min(b.fixed, b.baseline_seq) AS fixed FROM c JOIN b ON b.file = c.file AND b.rule_id = c.rule_id AND abs(c.line - b.line) <= 5 GROUP BY 1)
  SELECT status, count(*) AS n FROM (SELECT CASE WHEN m.vuln_id IS NULL THEN 'new' WHEN m.fixed THEN 'regressed' ELSE 'persistent' END AS status FROM c LEFT JOIN m USING (input_seq) UNION ALL SELECT 'fixed' FROM b WHERE vuln_id NOT IN (SELECT vuln_id FROM m)) GROUP BY 1""")
def str4_str2_udf6_incremental_scan(t):
    changes = t("orders").where("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("path"), F.lit("modified").alias("change")).distinct()
    none = changes.where(F.lit(False)).select(F.col("path").alias("src"), F.col("path").alias("dst"))
    return pl.incremental_scan(changes, none, t("current"), t("baseline")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT id, CASE WHEN s >= 0.8e0 THEN 'critical' WHEN s >= 0.6e0 THEN 'high' WHEN s >= 0.4e0 THEN 'medium' ELSE 'low' END AS level FROM (SELECT id, file_path, round({SURFACE} * 0.35e0 + {TECH} * 0.25e0 + complexity * 0.2e0 + history * 0.2e0, 6) AS s FROM targets) WHERE s >= 0.2e0 AND NOT regexp_matches(lower(file_path), 'test|spec|mock|fixture|example|sample|docs|readme|changelog|license|__pycache__|node_modules|vendor')")
def api7_audit_plan(t):
    return pl.audit_plan(t("targets")).select("id", "level")


@query("SELECT source, count(*) AS n FROM (SELECT 'own' AS source FROM findings UNION ALL SELECT 'codeql' FROM findings) GROUP BY 1")
def udf1_engine_registry(t):
    """A source of the caller's own beside a built-in one."""
    pl.FINDING_SOURCES["plain"] = lambda docs: docs.select(F.get_json_object("value", "$.rule").alias("rule_id"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    sarif = t("findings").select(F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.col("rule_id").alias("ruleId"), F.array(place).alias("locations"))).alias("results"))).alias("runs"))).alias("value"))
    plain = t("findings").select(F.to_json(F.struct(F.col("rule_id").alias("rule"))).alias("value"))
    return pl.read_findings({"plain": plain, "sarif": sarif}, {"plain": "own", "sarif": "codeql"}).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT 'requirements' AS kind, count(*) AS n FROM deps UNION ALL SELECT 'maven', count(*) FROM deps")
def udf7_dependency_registry(t):
    req = t("deps").select(F.lit("r").alias("path"), F.concat(F.lit("p"), text("input_seq"), F.lit("==1.0")).alias("content"))
    pom = t("deps").select(F.lit("p").alias("path"), F.concat(F.lit("<dependency><groupId>g</groupId><artifactId>a"), text("input_seq"), F.lit("</artifactId></dependency>")).alias("content"))
    out = None
    for kind, files in (("requirements", req), ("maven", pom)):
        part = pl.DEPENDENCY_SOURCES[kind](files).select(F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, event_id, n <= 5 AS allowed FROM r""")
def str7_token_bucket(t):
    """Requests of one instant: the burst is allowed, nothing refills."""
    return fl.token_bucket(t("events").select("user_id", "event_id", F.lit(0.0).alias("seconds")), 1.0, 5).select("user_id", "event_id", "allowed")


@query("SELECT id, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY rs, input_seq) AS fr FROM (SELECT *, min(input_seq) OVER (PARTITION BY rule_id) AS rs FROM findings)) WHERE fr <= 3")
def win5_per_file_cap(t):
    big = 1 << 40
    return dd.apply_budget(t("findings"), per_rule=big, per_file=3, total=(1 << 31) - 1).select("id", "rule_id")


@query("SELECT doc_id, list_filter([CASE WHEN contains(text, 'license') THEN 'license' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'number' END], lambda x: x IS NOT NULL) AS found FROM documents".replace("list_filter([", "array_to_string(list_filter([").replace("IS NOT NULL) AS", "IS NOT NULL), ',') AS"))
def det12_static_defence(t):
    return dt.static_defence(t("documents").select("doc_id", "text"), {"license": "license", "number": "[0-9]{4}"}, "doc_id").select("doc_id", F.array_join("found", ",").alias("found"))


@query("SELECT id, concat('[', upper(severity), '] ', rule_id, ' (', file, ':', line, ')') AS shown FROM findings")
def fun23_display(t):
    return t("findings").select("id", fd.display(F.col("severity"), F.col("rule_id"), F.col("file"), F.col("line")).alias("shown"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN concat('v', id) WHEN 1 THEN concat('call', id) WHEN 2 THEN concat('q', id) END AS name FROM findings")
def fun11_message_mining(t):
    n = text("id")
    message = F.when(F.col("id") % 4 == 0, F.concat(F.lit("Flow of variable 'v"), n, F.lit("' here"))).when(F.col("id") % 4 == 1, F.concat(F.lit("goes to call"), n, F.lit("(x) there"))).when(F.col("id") % 4 == 2, F.concat(F.lit("the `q"), n, F.lit("` value"))).otherwise("nothing named")
    return t("findings").select("id", tx.mined_name(message).alias("name"))


@query("SELECT doc_id, substr(text, 1, 1) = '{' AS ok FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{\"a\": 1}' ELSE 'x' END AS text FROM documents)")
def fun17_json_repair(t):
    body = F.when(F.col("doc_id") % 2 == 0, "```json\n{'a': 1,}\n```").otherwise("no json")
    return t("documents").select("doc_id", jsonfix.repaired(body).isNotNull().alias("ok"))


@query("SELECT candidate_id, CASE WHEN count(DISTINCT source) >= 3 THEN 'all' WHEN bool_or(source = 'codeql') THEN 'flow' END AS rule FROM evidence GROUP BY 1")
def udf4_correlation_rules_as_data(t):
    rules = (("flow", 1, ("codeql",), (), "likely"), ("all", 3, (), (), "confirmed"))
    return dc.correlate(t("evidence"), rules=rules).select("candidate_id", "rule")


@query("SELECT doc_id, x.line AS line, x.rule AS rule FROM (SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN [{'line': 2, 'rule': 'plain_repository'}, {'line': 3, 'rule': 'snapshot_version'}] WHEN 1 THEN [{'line': 1, 'rule': 'plain_repository'}, {'line': 2, 'rule': 'stored_password'}] ELSE [{'line': 2, 'rule': 'unpinned_requirement'}] END) AS x FROM documents)")
def det15_build_file_risks(t):
    k = F.col("doc_id")
    pom = "<project>\n<url>http://repo.example/m</url>\n<version>1.0-SNAPSHOT</version>\n</project>"
    gradle = 'maven { url "http://repo.example/m" }\nstorePassword "abcdefgh"\n'
    path = F.concat(F.lit("p"), k.cast("string"), pick(k, "/pom.xml", "/build.gradle", "/requirements.txt"))
    files = t("documents").select("doc_id", path.alias("path"), pick(k, pom, gradle, "# top\nplain\nother==1.0\n").alias("content"))
    return surface.build_risks(files).join(files.select("doc_id", "path"), "path").select("doc_id", "line", "rule")


@query("SELECT job, count(*) AS runs FROM (SELECT unnest(['hourly', CASE WHEN hour(ts) = 2 THEN 'daily' END]) AS job FROM (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events)) WHERE job IS NOT NULL GROUP BY 1")
def udf5_scheduled_jobs(t):
    hours = t("events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at")).distinct()
    return pl.due_jobs(hours, {"hourly": F.lit(True), "daily": F.hour("at") == 2}).groupBy("job").agg(F.count("*").alias("runs"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, max(p_partkey) AS last FROM part")
def str3_row_iteration(t):
    """Rows go one batch after the other through a generator that keeps none, a partition each; only its totals go on."""
    return pl.streamed_totals(t("part"), "p_partkey").select("n", "last")
