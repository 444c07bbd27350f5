"""Domain tables over the driver's tables: one SQL text per view, valid in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables in braces are the driver's; other names are earlier views.
VIEWS = {
    "findings": """
        SELECT event_id AS id, event_id AS input_seq, event_type AS rule_id,
          concat('./src/m', CAST(user_id AS STRING), '.py') AS file, CAST(floor(value) AS INT) + 1 AS line,
          CASE event_id % 3 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'codeql' ELSE 'agent' END AS source,
          CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
          CASE event_id % 7 WHEN 0 THEN 'exploitable' WHEN 1 THEN 'likely' WHEN 2 THEN 'possible' WHEN 3 THEN 'unlikely'
            WHEN 4 THEN 'not_exploitable' WHEN 5 THEN 'unknown' END AS exploitability,
          (event_id % 101) / 100.0e0 AS confidence,
          CASE event_id % 4 WHEN 0 THEN ' Self.handle' WHEN 1 THEN 'this.handle' WHEN 2 THEN 'render' END AS function,
          CASE event_id % 6 WHEN 0 THEN concat('exec("', event_type, '")') WHEN 1 THEN 'eval( ${X} )' END AS sink,
          CASE event_id % 9 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-79' END AS cwe,
          CASE event_id % 13 WHEN 0 THEN 'finding_budget' WHEN 1 THEN 'other' END AS filtered_by,
          event_id % 17 = 0 AS suppressed,
          CASE event_id % 2 WHEN 0 THEN 'vulnerability' ELSE 'suspicious' END AS type
        FROM {events}""",
    "cves": """
        SELECT o_orderkey AS cve_id, concat('CVE-', CAST(o_orderkey AS STRING), ' in ', o_orderpriority) AS description,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END AS severity,
          CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE round(least(10.0e0, o_totalprice / 50000.0e0), 1) END AS cvss,
          o_orderstatus = 'F' AS kev, o_orderkey % 5 = 0 AS has_poc, CAST(o_orderdate AS DATE) AS published, o_custkey AS vendor
        FROM {orders}""",
    "pocs": """
        SELECT p_partkey AS poc_id, p_name AS title, p_type AS poc_type, p_brand AS platform, p_size AS stars, p_size % 3 = 0 AS verified FROM {part}""",
    "cve_poc_map": "SELECT DISTINCT l_orderkey AS cve_id, l_partkey AS poc_id FROM {lineitem}",
    "deps": """
        SELECT p_partkey AS input_seq, p_name AS name, p_type AS ecosystem,
          CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '*' WHEN 2 THEN '${rev}'
            ELSE concat('v', CAST(p_size AS STRING), '.', CAST(p_partkey % 10 AS STRING), '.', CAST(p_partkey % 7 AS STRING), CASE p_partkey % 3 WHEN 0 THEN '-rc1' ELSE '' END) END AS version,
          (p_partkey % 10) / 10.0e0 AS version_confidence
        FROM {part}""",
    "edges": """
        SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM {lineitem} a JOIN {lineitem} b
        ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey""",
    "baseline": """
        SELECT o_orderkey AS baseline_seq, o_orderkey AS vuln_id, o_orderpriority AS rule_id, o_custkey AS file, CAST(o_orderkey % 40 AS INT) + 1 AS line,
          o_orderstatus = 'F' AS fixed FROM {orders} WHERE o_orderkey % 3 <> 0""",
    "current": """
        SELECT o_orderkey AS input_seq, o_orderpriority AS rule_id, o_custkey AS file, CAST((o_orderkey * 7) % 40 AS INT) + 1 AS line FROM {orders} WHERE o_orderkey % 4 <> 0""",
    "debate": """
        SELECT conv_id AS finding_id, turn AS round, role, CAST(length(text) AS BIGINT) AS tokens,
          (length(text) % 100) / 100.0e0 AS confidence FROM {conversations}""",
    "evidence": """
        SELECT l_orderkey AS candidate_id, l_linenumber AS seq,
          CASE l_returnflag WHEN 'A' THEN 'agent' WHEN 'N' THEN 'codeql' ELSE 'semgrep' END AS source,
          CASE l_suppkey % 5 WHEN 0 THEN 'dataflow_path' WHEN 1 THEN 'agent_analysis' WHEN 2 THEN 'sanitizer_detected' WHEN 3 THEN 'cve_match' ELSE 'pattern_match' END AS evidence_type,
          round(l_discount * 10.0e0, 4) AS confidence, CASE l_returnflag WHEN 'A' THEN 0.8e0 WHEN 'N' THEN 0.9e0 ELSE 0.6e0 END AS weight,
          l_linestatus = 'F' AND l_partkey % 7 = 0 AS is_false_positive
        FROM {lineitem}""",
    "files": """
        SELECT doc_id AS input_seq, concat('/repo/', source, '/', CASE doc_id % 6 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'tests/' ELSE '' END, 'f', CAST(doc_id AS STRING),
          CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.go' WHEN 3 THEN '.min.js' ELSE '.md' END) AS path,
          text, CAST(length(text) AS BIGINT) AS size FROM {documents}""",
    "programs": """
        SELECT p_partkey AS k, CASE p_partkey % 2 WHEN 0 THEN concat('src/p', CAST(p_partkey % 7 AS STRING), '/C', CAST(p_partkey AS STRING), '.java') ELSE concat('cmd/g', CAST(p_partkey AS STRING), '/main.go') END AS path,
          translate(CASE p_partkey % 2 WHEN 0 THEN concat('package p', CAST(p_partkey % 7 AS STRING), ';', chr(10), 'import p', CAST((p_partkey * 3 % 100 * 2 + 2) % 7 AS STRING), '.C', CAST(p_partkey * 3 % 100 * 2 + 2 AS STRING), ';', chr(10),
            CASE p_partkey % 3 WHEN 0 THEN '// void ghost() < C2.m1(); >' WHEN 1 THEN '/* class Ghost < @GetMapping("/ghost") void m0() < */' ELSE '' END, chr(10), '@RequestMapping("/c', CAST(p_partkey AS STRING), '")', chr(10), 'public class C', CAST(p_partkey AS STRING), ' <', chr(10),
            CASE WHEN p_partkey % 4 > 0 THEN concat('  @GetMapping("/a', CAST(p_partkey % 5 AS STRING), '") public void m0(String s) < C', CAST(p_partkey * 3 % 100 * 2 + 2 AS STRING), '.m1("x < y"); >') ELSE '' END, chr(10),
            CASE WHEN p_partkey % 5 > 0 THEN '  static int m1(String s) < return s.length(); >' ELSE '  interface Inner < int m3(String s); >' END, chr(10),
            CASE WHEN p_partkey % 3 = 1 THEN concat('  @KafkaListener(topics = "t', CAST(p_partkey % 9 AS STRING), '") void m2(String s) < m0(s); >') ELSE '' END, chr(10), '>', chr(10))
          ELSE concat('package main', chr(10), 'import "h.org/x/q', CAST(p_partkey % 5 AS STRING), '"', chr(10),
            CASE p_partkey % 3 WHEN 0 THEN '// func ghost() <' WHEN 1 THEN '/* r.GET("/ghost", g) < */' ELSE 'var s = `func fake() < r.GET("/fake", f)`' END, chr(10), 'func setup(r *gin.Engine) <', chr(10), '  v := r.Group("/v', CAST(p_partkey % 4 AS STRING), '")', chr(10),
            CASE WHEN p_partkey % 4 = 1 THEN concat('  v.POST("/p', CAST(p_partkey AS STRING), '", h', CAST(p_partkey % 3 AS STRING), ')') ELSE concat('  r.GET("/g', CAST(p_partkey AS STRING), '", h', CAST(p_partkey % 3 AS STRING), ')') END, chr(10),
            CASE WHEN p_partkey % 7 = 3 THEN '  c.AddFunc("@daily", clean)' ELSE '' END, chr(10), '>', chr(10), 'func (s *Srv) h', CAST(p_partkey % 3 AS STRING), '() < s.run() >', chr(10)) END, '<>', concat(chr(123), chr(125))) AS content
        FROM {part}""",
    "targets": """
        SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'http' WHEN 1 THEN 'rpc' WHEN 2 THEN 'mq' WHEN 3 THEN 'cron' WHEN 4 THEN 'smtp' END AS entry_point_type,
          CASE event_id % 4 WHEN 0 THEN 'post' WHEN 1 THEN 'GET' WHEN 2 THEN 'TRACE' END AS http_method, event_id % 3 = 0 AS auth_required, CAST(event_id % 8 AS INT) AS n_params,
          concat('/srv/', CASE event_id % 9 WHEN 0 THEN 'auth' WHEN 1 THEN 'crypto' WHEN 2 THEN 'settings' WHEN 3 THEN 'route' WHEN 4 THEN 'tests' ELSE 'core' END, '/', event_type, '.py') AS file_path,
          CASE event_id % 5 WHEN 0 THEN 'Flask' WHEN 1 THEN 'struts' WHEN 2 THEN 'gin' WHEN 3 THEN 'own' END AS framework, CASE event_id % 4 WHEN 0 THEN 'php' WHEN 1 THEN 'go' ELSE 'python' END AS language,
          (event_id % 10) / 10.0e0 AS complexity, (event_id % 7) / 7.0e0 AS history
        FROM {events}""",
}
_TABLES = re.compile(r"(?<!\$)\{(\w+)\}")
_LITERAL = re.compile(r"\$\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the Parquet tables of ``sf_dir``."""
    # ${NAME} is a literal of the data, not a table: it is hidden from the parser
    text = _LITERAL.sub(r"$#\1#", VIEWS[name])
    frames = {t: table(spark, sf_dir, t) for t in set(_TABLES.findall(text))}
    df = spark.sql(text, **frames)
    for column in {"version", "sink"} & set(df.columns):
        df = df.withColumn(column, F.regexp_replace(column, r"\$#(\w+)#", r"\${$1}"))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def twin(sql: str) -> str:
    """``sql`` for DuckDB, with the views that it names in front."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    heads = [f"{n} AS ({_TABLES.sub(r'\1', VIEWS[n])})" for n in names]
    if not heads:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(heads) + ", " + body[len("WITH RECURSIVE") :]
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join(heads) + ", " + body[len("WITH") :]
    return "WITH " + ", ".join(heads) + " " + body
