"""Queries over evidence, exploitability, entry points, configuration and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import outputs as op
from ..sources import rule_yaml, structure, surface
from . import table_queries
from .library_queries import _programs, pick

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


def every(column: str, n: int, k: int = 0) -> Column:
    return F.col(column) % n == k


# --- scores

DIMENSIONS = """
  round(CASE WHEN id % 7 = 0 THEN 0.1e0 WHEN id % 5 = 0 THEN CASE id % 3 WHEN 0 THEN 0.0e0 WHEN 1 THEN 0.2e0 ELSE 0.3e0 END WHEN id % 2 = 0 AND id % 3 = 0 THEN greatest(0.5e0, 1 - line * 0.05e0) * 0.9e0 WHEN id % 2 = 0 OR id % 3 = 0 THEN 0.5e0 ELSE 0.2e0 END, 6) AS flow,
  round(CASE WHEN id % 7 = 1 THEN 0.0e0 WHEN id % 3 = 0 THEN greatest(0.8e0, 1 - line * 0.02e0) * 0.95e0 WHEN id % 4 = 0 THEN CASE WHEN id % 11 = 0 THEN 0.1e0 WHEN confidence > 0.8e0 THEN 0.0e0 ELSE 0.2e0 END WHEN id % 2 = 0 THEN 0.6e0 ELSE 0.0e0 END, 6) AS taint,
  round(CASE WHEN id % 7 = 2 THEN 0.2e0 WHEN id % 4 = 0 THEN CASE id % 3 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.8e0 ELSE 0.7e0 END WHEN id % 6 > 0 THEN least(0.7e0, 0.3e0 + (id % 6) * 0.1e0) ELSE 0.1e0 END, 6) AS reach,
  CASE id % 5 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.7e0 WHEN 2 THEN 0.3e0 WHEN 3 THEN 0.5e0 ELSE 0.5e0 END AS surface"""


@query(f"SELECT id, {DIMENSIONS} FROM findings")
def exp4_udf3_dimension_scores(t):
    k, line = F.col("id"), F.col("line")
    flow = ev.dataflow_score(k % 7 != 0, every("id", 2), every("id", 3), every("id", 5), pick(k, "full", "partial", "unknown"), line)
    taint = ev.taint_score(k % 7 != 1, every("id", 3), every("id", 4), every("id", 2), F.when(k % 11 != 0, F.col("confidence")), line, F.col("confidence"))
    reach = ev.reach_score(k % 7 != 2, every("id", 4), pick(k, "HTTP", "CLI", "MQ"), k % 6)
    kind = F.when(k % 5 == 0, "http").when(k % 5 == 1, "Cli").when(k % 5 == 2, "LIBRARY").when(k % 5 == 3, "odd")
    return t("findings").select("id", flow["score"].alias("flow"), taint["score"].alias("taint"), reach["score"].alias("reach"), ev.surface_score(kind)["score"].alias("surface"))


@query("""SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 AND id % 5 < 3 THEN CASE WHEN id % 4 > 0 THEN 'conditional' ELSE 'exploitable' END WHEN id % 3 = 0 AND id % 2 = 0 THEN 'unlikely' WHEN id % 3 = 0 AND id % 5 < 3 THEN 'needs_review'
  WHEN id % 8 = 7 OR (id % 6 > 0 AND id % 7 = 0) THEN 'needs_review' WHEN id % 2 = 1 THEN CASE WHEN id % 6 = 0 THEN 'unlikely' ELSE 'not_exploitable' END WHEN id % 6 = 0 THEN 'exploitable' ELSE 'needs_review' END AS status,
  CASE WHEN id % 3 = 0 AND id % 2 = 0 AND id % 5 < 3 THEN CASE WHEN id % 4 > 0 THEN 0.7e0 ELSE 0.9e0 END WHEN id % 3 = 0 AND id % 2 = 0 THEN 0.45e0 WHEN id % 3 = 0 AND id % 5 < 3 THEN 0.5e0
  WHEN id % 8 = 7 OR (id % 6 > 0 AND id % 7 = 0) THEN 0.35e0 WHEN id % 2 = 1 THEN CASE WHEN id % 6 = 0 THEN 0.4e0 ELSE 0.25e0 END WHEN id % 6 = 0 THEN 0.85e0 ELSE 0.5e0 END AS confidence FROM findings""")
def exp6_exploitability(t):
    k = F.col("id")
    e = ev.exploitability(every("id", 3), every("id", 2), k % 5 < 3, k % 4, k % 8 != 7, every("id", 6), k % 7, every("id", 2))
    return t("findings").select("id", e["status"].alias("status"), e["confidence"].alias("confidence"))


@query("""SELECT candidate_id, arg_max(pid, (CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END) * 1000000 + n * 1000 - pid) AS "primary", CASE WHEN bool_or(seq % 5 = 4) THEN 'low' WHEN bool_or(seq % 2 = 0) THEN 'high' ELSE 'medium' END AS updated
  FROM (SELECT candidate_id, seq, seq AS pid, seq % 3 AS n FROM evidence) GROUP BY 1""")
def exp22_aux14_path_confidence(t):
    paths = t("evidence").select("candidate_id", F.col("seq").alias("path_id"), every("seq", 2).alias("complete"), (F.col("seq") % 3).alias("nodes"), every("seq", 5, 4).alias("effective"))
    return ev.path_confidence(paths)


BAND = "CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'high' WHEN 'medium' THEN CASE WHEN source = 'agent' THEN 'high' ELSE 'medium' END ELSE 'low' END"


@query(f"SELECT id, {BAND} AS confidence_band, {BAND} IN ('high', 'medium') OR severity IN ('critical', 'high') AS next_round FROM findings")
def exp24_candidates(t):
    return ev.candidates(t("findings")).select("id", "confidence_band", "next_round")


@query("SELECT id, band, band = 'medium' OR severity IN ('critical', 'high') AS next_round FROM (SELECT id, severity, CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN 'low' WHEN id % 4 = 0 AND (id % 2 = 0 OR id % 5 = 0) THEN 'high' WHEN confidence >= 0.8e0 THEN 'high' WHEN confidence >= 0.5e0 THEN 'medium' ELSE 'low' END AS band FROM findings)")
def exp23_aux10_second_round(t):
    f = t("findings")
    results = f.where(every("id", 4)).select("id", every("id", 2).alias("whole_path"), every("id", 5).alias("confirmed"), every("id", 3).alias("false_positive"))
    return ev.after_deep_analysis(f.select("id", "severity", ev.confidence_band(F.col("confidence")).alias("band")), results).select("id", "band", "next_round")


@query("""SELECT id, CASE WHEN id % 5 IN (0, 1) THEN 'high' WHEN id % 5 IN (2, 3) THEN 'low' WHEN confidence >= 0.8e0 THEN 'high' WHEN confidence >= 0.5e0 THEN 'medium' ELSE 'low' END AS band, id % 5 = 4 OR id % 2 = 1 AS review FROM (SELECT id - id % 2 AS x, CASE WHEN id % 2 = 0 THEN id ELSE id END AS id, confidence FROM findings)""".replace("id % 5 IN (0, 1)", "id % 2 = 0 AND id % 5 IN (0, 1)").replace("id % 5 IN (2, 3)", "id % 2 = 0 AND id % 5 IN (2, 3)"))
def aux9_third_round(t):
    f = t("findings")
    statuses = f.where(every("id", 2)).select("id", pick(F.col("id"), "confirmed", "likely", "false_positive", "not_exploitable", "needs_review").alias("status"))
    return ev.after_correlation(f.select("id", ev.confidence_band(F.col("confidence")).alias("band")), statuses).select("id", "band", "review")


@query("SELECT id, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN 'info' ELSE severity END AS severity, CASE WHEN id % 2 = 0 THEN CASE WHEN confidence >= 0.8e0 THEN 'high' WHEN confidence >= 0.5e0 THEN 'medium' ELSE 'low' END ELSE 'old' END AS band, id % 2 = 0 AND id % 4 = 0 AS next_round FROM findings")
def aux12_fourth_round(t):
    f = t("findings")
    verified = f.where(every("id", 2)).select("id", pick(F.col("id"), "needs_review", "x", "exploitable", "y").alias("status"), "confidence", F.when(every("id", 3), "info").alias("adjusted"))
    return ev.after_verification(f.select("id", "severity", F.lit("old").alias("band")), verified).select("id", "severity", "band", "next_round")


@query("""WITH a AS (SELECT id, source, CASE source WHEN 'semgrep' THEN 'pattern_match' WHEN 'codeql' THEN 'dataflow_path' ELSE 'agent_analysis' END AS evidence_type, CASE id % 3 WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.6e0 ELSE 0.3e0 END AS confidence FROM findings
  UNION ALL SELECT candidate_id, source, evidence_type, confidence FROM evidence UNION ALL SELECT id, 'codeql', 'dataflow_path', CASE WHEN id % 4 = 0 THEN 0.8e0 ELSE 0.6e0 END FROM findings WHERE id % 2 = 0 UNION ALL SELECT id, 'agent', 'agent_analysis', 0.9e0 FROM findings WHERE id % 3 = 0 OR id % 5 = 0)
  SELECT id AS candidate_id, count(*) AS n, sum(CAST(round(confidence * 10000) AS BIGINT) * CASE source WHEN 'semgrep' THEN 60 WHEN 'codeql' THEN 90 ELSE 80 END) / CAST(sum(CASE source WHEN 'semgrep' THEN 60 WHEN 'codeql' THEN 90 ELSE 80 END) AS DOUBLE) / 10000.0e0 AS weighted FROM a GROUP BY 1""")
def jon15_evidence_assembly(t):
    f = t("findings")
    own = f.select(F.col("id").alias("candidate_id"), "source", pick(F.col("id"), "high", "medium", "low").alias("band"))
    deep = f.select(F.col("id").alias("candidate_id"), every("id", 2).alias("has_path"), every("id", 4).alias("whole_path"), every("id", 3).alias("confirmed"), every("id", 5).alias("false_positive"))
    all_ = ev.assembled(own, t("evidence").select("candidate_id", "source", "evidence_type", "confidence"), deep)
    return ev.weighed(all_)


@query("SELECT id, id % 2 = 0 AS source, id % 3 = 0 AS sink, CAST(id % 4 AS INT) AS sanitizers, CAST(id % 5 AS INT) AS length FROM findings")
def aux13_flow_facts(t):
    k = F.col("id")
    doc = F.struct(every("id", 2).alias("has_source"), F.when(every("id", 3), True).alias("has_sink"), F.when(k % 4 > 0, F.array_repeat(F.lit("s"), (k % 4).cast("int"))).alias("sanitizers"), F.array_repeat(F.lit("p"), (k % 5).cast("int")).alias("path"))
    return t("findings").select("id", ev.flow_facts(F.to_json(doc)).alias("f")).select("id", "f.*")


@query("""SELECT id, CAST(id % 2 = 0 AS INT) + CAST(id % 3 = 0 AS INT) + CAST(confidence > 0.5e0 AS INT) >= 2 AS transform, round(least(1.0e0, CASE WHEN id % 2 = 0 THEN 0.4e0 ELSE 0.0e0 END + CASE WHEN id % 3 = 0 THEN 0.3e0 ELSE 0.0e0 END + confidence * 0.3e0), 6) AS transform_confidence,
  id % 2 = 0 OR id % 5 = 0 AS typed, round(CASE WHEN id % 2 = 0 THEN 0.5e0 ELSE 0.0e0 END + CASE WHEN id % 5 = 0 THEN 0.4e0 ELSE 0.0e0 END + CASE WHEN id % 3 = 0 THEN 0.1e0 ELSE 0.0e0 END, 6) AS type_confidence FROM findings""")
def exp26_sanitizer_scores(t):
    a, b = ev.transform_score(every("id", 2), every("id", 3), F.col("confidence")), ev.type_score(every("id", 2), every("id", 5), every("id", 3))
    return t("findings").select("id", a["is_sanitizer"].alias("transform"), a["confidence"].alias("transform_confidence"), b["is_sanitizer"].alias("typed"), b["confidence"].alias("type_confidence"))


@query("SELECT id, id % 2 = 0 AS replaces, id % 3 = 0 AS encodes, id % 5 = 0 AS safe_return, id % 7 = 0 AS decorated, id % 11 = 0 AS guard FROM findings")
def aux6_function_features(t):
    part = lambda n, x: F.when(every("id", n), x).otherwise("")
    body = F.concat(part(7, "@sanitized\n"), F.lit("def f(x)"), part(5, " -> Markup"), F.lit(":\n  y = x"), part(2, ".replace('a', 'b')"), F.lit("\n"), part(3, "  y = html.escape(y)\n"), part(11, "  assert isinstance(y, str)\n"))
    return t("findings").select("id", ev.function_features(body).alias("f")).select("id", "f.*")


@query("SELECT id AS node, 'transform' AS method, 0.7e0 AS confidence, false AS full FROM findings WHERE id % 2 = 0 UNION ALL SELECT id, 'type', 0.9e0, true FROM findings WHERE id % 3 = 0 UNION ALL SELECT id, 'name', 0.9e0, true FROM findings WHERE id % 5 = 0")
def aux5_node_sanitizers(t):
    s = lambda n, v: F.struct(every("id", n).alias("is_sanitizer"), F.lit(v).alias("confidence"))
    name = F.when(every("id", 5), "lib.html_escape").otherwise("escape.run")
    return ev.node_evidence(t("findings").select(F.col("id").alias("node"), name.alias("name"), s(2, 0.7).alias("transform"), s(3, 0.9).alias("type")))


@query("""SELECT id, round(least(1.0e0, greatest(0.0e0, 0.5e0 + CASE WHEN id % 2 = 0 THEN 0.1e0 ELSE 0.0e0 END + CASE id % 4 WHEN 0 THEN 0.15e0 WHEN 1 THEN -0.2e0 WHEN 2 THEN -0.25e0 ELSE 0.0e0 END + CASE WHEN id % 3 = 0 THEN 0.05e0 ELSE 0.0e0 END + CASE WHEN id % 5 = 0 THEN 0.1e0 ELSE 0.0e0 END)), 6) AS attack,
  round(least(0.9e0, 0.1e0 + least(id % 5, 3) * 0.2e0 + least(id % 4, 3) * 0.1e0 + least(id % 3, 2) * 0.15e0), 6) AS defence FROM findings""")
def aux15_quick_assessment(t):
    k = F.col("id")
    code = pick(k, "User_controlled input", "a prepared statement", "sanitize, then escape", "plain")
    attack = ev.attack_confidence(F.when(every("id", 2), "rce").otherwise("x"), code, F.when(every("id", 3), "a -> b").otherwise(""), F.when(every("id", 5), "http").otherwise("internal"))
    return t("findings").select("id", attack.alias("attack"), ev.defence_confidence(k % 5, k % 4, k % 3).alias("defence"))


@query("""SELECT finding_id, round, CASE WHEN v NOT IN ('needs_review', 'conditional') AND confidence >= 0.7e0 AND gap >= 0.3e0 THEN NULL ELSE nullif(concat_ws(',', CASE WHEN v = 'needs_review' THEN 'needs_review' END, CASE WHEN gap < 0.2e0 THEN 'strength_difference' END, CASE WHEN confidence < 0.6e0 THEN 'confidence' END), '') END AS reasons
  FROM (SELECT finding_id, round, confidence, abs((tokens % 10) / 10.0e0 - 0.5e0) AS gap, CASE tokens % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'needs_review' ELSE 'conditional' END AS v FROM debate)""")
def exp20_debate_continuation(t):
    d = t("debate")
    return d.select("finding_id", "round", ev.debate_goes_on(pick(F.col("tokens"), "confirmed", "needs_review", "conditional"), (F.col("tokens") % 10) / 10, F.lit(0.5), F.col("confidence")).alias("reasons"))


@query("WITH g AS (SELECT CASE severity WHEN 'info' THEN 'skip' ELSE severity END AS level, count(*) AS targets FROM findings GROUP BY 1), r AS (SELECT level, targets, CASE level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS rk FROM g WHERE level <> 'skip') SELECT level, targets, rk > 2 OR (SELECT sum(x.targets) * 5000 FROM r x WHERE x.rk >= r.rk) <= (SELECT sum(targets) * 3000 FROM r) AS agent FROM r WHERE level <> 'low'")
def exp16_strategy_budget(t):
    g = t("findings").where("severity <> 'info'").groupBy(F.col("severity").alias("level")).agg(F.count("*").alias("targets")).withColumn("timeout_s", F.lit(100)).withColumn("agent", F.lit(True))
    tokens = t("findings").where("severity <> 'info'").count() * 3000
    return ev.within_budget(g, seconds=350, tokens=tokens).select("level", "targets", "agent")


@query("SELECT coalesce(s.user_id, o.user_id) AS strategy, coalesce(s.used, 0) + coalesce(o.used, 0) AS used, coalesce(s.wins, 0) + coalesce(o.wins, 0) AS wins FROM (SELECT user_id, count(*) AS used, CAST(0 AS BIGINT) AS wins FROM events WHERE event_id % 2 = 0 GROUP BY 1) s FULL OUTER JOIN (SELECT user_id, count(*) AS used, count(*) FILTER (WHERE event_type = 'click') AS wins FROM events WHERE event_id % 3 = 0 GROUP BY 1) o ON s.user_id = o.user_id")
def aux17_strategy_evolution(t):
    e = t("events").withColumnRenamed("user_id", "strategy")
    old = e.where("event_id % 2 = 0").groupBy("strategy").agg(F.count("*").alias("used"), F.lit(0).cast("bigint").alias("wins"))
    return ev.evolved(old, e.where("event_id % 3 = 0").select("strategy", (F.col("event_type") == "click").alias("won")))


# --- entry points and configuration


def _sources(t) -> DataFrame:
    """A file for each supplier, of seven kinds by its key."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    text = {
        0: (".go", 'func main() {\n  r.GET("/a/:id", show)\n  http.HandleFunc("/plain", plain)\n  c.AddFunc("0 * * * *", tick)\n}\n'),
        1: (".java", '@RestController\n@RequestMapping("/api")\npublic class C {\n  @GetMapping(value = "/x")\n  public String show(String a) { return a; }\n  @PostMapping("/y")\n  public String put() { return ""; }\n}\n'),
        2: (".java", '@DubboService(version = "1")\npublic class Pay {\n}\n@KafkaListener(\n  topics = "orders")\npublic void take(String m) {}\n'),
        3: (".proto", "service S {\n  rpc Get (Req) returns (Res);\n  rpc Put (stream Req) returns (Res);\n}\n"),
        4: (".py", "@app.route('/v/<int:id>')\n@login\ndef view(id):\n    pass\n\n@celery.task\ndef beat():\n    pass\n"),
        5: (".py", "channel.basic_consume(\n  queue='jobs', on_message_callback=f)\n"),
        6: (".txt", "nothing\n"),
    }
    path, content = F.lit(None), F.lit(None)
    for i, (end, body) in text.items():
        path, content = F.when(k % 7 == i, F.concat(F.lit("src/f"), n, F.lit(end))).otherwise(path), F.when(k % 7 == i, body).otherwise(content)
    return t("supplier").select(path.alias("path"), content.alias("content"))


_ENTRIES = """(VALUES (0, '.go', 2, 'http', 'gin', 'GET', '/a/{id}', 'show'), (0, '.go', 3, 'http', 'net/http', 'ANY', '/plain', 'plain'), (0, '.go', 4, 'cron', 'cron', NULL, '0 * * * *', 'tick'),
  (1, '.java', 4, 'http', 'spring', 'GET', '/api/x', 'show'), (1, '.java', 6, 'http', 'spring', 'POST', '/api/y', 'put'), (2, '.java', 1, 'rpc', 'dubbo', NULL, 'Pay', 'Pay'), (2, '.java', 4, 'mq', 'kafka', NULL, 'orders', 'take'),
  (3, '.proto', 2, 'rpc', 'grpc', NULL, 'Get', 'Req'), (3, '.proto', 3, 'rpc', 'grpc', NULL, 'Put', 'Req'), (4, '.py', 1, 'http', 'flask', 'ANY', '/v/{id}', 'view'), (4, '.py', 6, 'cron', 'celery', NULL, 'beat', 'beat'), (5, '.py', 1, 'mq', 'rabbitmq', NULL, 'jobs', NULL)) e(m, ending, line, kind, framework, method, route, handler)"""


@query(f"SELECT concat('src/f', s_suppkey, ending) AS path, line, kind, framework, method, route, handler FROM supplier JOIN {_ENTRIES} ON s_suppkey % 7 = m")
def det1_det2_det4_det5_udf8_entry_points(t):
    return surface.entry_points(_sources(t))


@query(f"SELECT concat('src/f', s_suppkey, ending) AS path, CASE WHEN m = 4 THEN 3 ELSE line END AS line, CASE WHEN m = 4 THEN 'syntax' ELSE 'pattern' END AS tier FROM supplier JOIN {_ENTRIES} ON s_suppkey % 7 = m WHERE m <> 4 OR line = 1")
def det6_det7_cascade(t):
    files = _sources(t)
    parsed = surface.syntax_entry_points(structure.python_structure(files.where("path like '%.py'")))
    return surface.cascade(files, parsed).select("path", "line", "tier")


@query("SELECT concat('d', s_suppkey, '/Dockerfile') AS path, line, rule, risk FROM supplier, (VALUES (1, 'DF008', 'low'), (2, 'DF001', 'high'), (3, 'DF005', 'high'), (4, 'DF007', 'high'), (5, 'DF010', 'medium'), (6, 'DF012', 'info')) r(line, rule, risk) WHERE s_suppkey % 2 = 0 UNION ALL SELECT concat('p', s_suppkey, '/.github/workflows/ci.yml'), line, rule, risk FROM supplier, (VALUES (1, 'target_checkout', 'high'), (3, 'unpinned_action', 'low'), (4, 'plain_secret', 'high'), (5, 'untrusted_input', 'high')) r(line, rule, risk) WHERE s_suppkey % 2 = 1")
def det13_det14_src29_config_risks(t):
    k = F.col("s_suppkey")
    docker = "FROM base:latest\nUSER root\nENV API_TOKEN=x\nRUN curl http://x | sh\nRUN chmod 777 /a\nHEALTHCHECK NONE\n"
    flow = "on: pull_request_target\nsteps:\n  - uses: actions/checkout@main\n    DB_PASSWORD: 'abcdefghijkl'\n    run: echo ${{ github.event.issue.title }}\n"
    path = F.when(k % 2 == 0, F.concat(F.lit("d"), k.cast("string"), F.lit("/Dockerfile"))).otherwise(F.concat(F.lit("p"), k.cast("string"), F.lit("/.github/workflows/ci.yml")))
    return surface.config_risks(t("supplier").select(path.alias("path"), F.when(k % 2 == 0, docker).otherwise(flow).alias("content")))


@query("SELECT concat('r', s_suppkey, '.yaml') AS path, concat('rule-', s_suppkey, x) AS rule_id, CASE x WHEN 'a' THEN 'ERROR' ELSE 'INFO' END AS severity, CASE x WHEN 'a' THEN 'python,go' ELSE 'java' END AS languages FROM supplier, (VALUES ('a'), ('b')) v(x)")
def src27_rule_files(t):
    n = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("rules:\n  - id: rule-"), n, F.lit("a\n    languages: [python, go]\n    severity: ERROR\n    pattern: f($X)\n  - id: rule-"), n, F.lit("b\n    severity: INFO\n    languages: [java]\n"))
    return surface.rule_files(t("supplier").select(F.concat(F.lit("r"), n, F.lit(".yaml")).alias("path"), text.alias("content")))


@query("""WITH s AS (SELECT *, s_suppkey AS k FROM supplier WHERE s_suppkey % 11 <> 0)
  SELECT concat('r', k, '.yml') AS path, '/rules/0' AS place, concat('r: ', k) AS rule_id, CASE WHEN k % 5 = 0 THEN 'WARNING' ELSE 'ERROR' END AS severity, array_to_string(['python', 'go', 'java'][1:CAST(k % 3 + 1 AS INT)], ',') AS languages,
    CASE k % 4 WHEN 2 THEN k % 3 + 2 ELSE 1 END AS n_patterns, CASE WHEN k % 2 = 0 THEN 'valid' ELSE 'literal_only' END AS validity FROM s
  UNION ALL SELECT concat('r', k, '.yml'), '/rules/1', CASE WHEN k % 7 <> 0 THEN concat('n', s_nationkey, '/', k) END, 'INFO', '', 1, CASE WHEN k % 7 = 0 THEN 'invalid_structure' ELSE 'valid' END FROM s""")
def src27_flt26_det17_rules(t):
    """Files of two rules in several styles of YAML; one in eleven holds an anchor and is refused."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    languages = F.slice(F.array(*map(F.lit, ("python", "go", "java"))), 1, (k % 3 + 1).cast("int"))
    listed = F.when(k % 2 == 0, text("[", F.array_join(F.transform(languages, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ",\n      "), "] # all")).otherwise(text("\n    - ", F.array_join(languages, "\n    # next\n    - ")))
    either = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), k % 3 + 1), lambda i: text("      - pattern: g", i.cast("string"), "($X)\n")), "")
    pattern = F.when(k % 4 == 0, "    pattern: |\n      if a:\n        f($X, ...)\n\n").when(k % 4 == 1, '    pattern: "eval # (x)"\n').when(k % 4 == 2, text("    pattern-either:\n", either)).otherwise("    pattern-regex: >-\n      abc\n      def\n")
    first = text("rules:\n  # one\n  - id: ", F.when(k % 2 == 0, text('"r: ', n, '"')).otherwise(text("'r: ", n, "'")), "\n    languages: ", listed, "\n    severity: ", F.when(k % 5 == 0, "WARNING").otherwise("ERROR"), "\n", pattern, "    message: several\n      lines of\n\n      text\n")
    second = text(F.when(k % 7 != 0, text("  - id:   n", F.col("s_nationkey").cast("string"), "/", n, "  # two\n    severity: INFO\n")).otherwise("  -\n    severity: INFO\n"), "    patterns:\n    - pattern-inside: def $F(...)\n", F.when(k % 11 == 0, "    metadata: &shared x\n").otherwise("    metadata:\n      cwe: ~\n"))
    return rule_yaml.rules(rule_yaml.yaml_values(t("supplier").select(text("r", n, ".yml").alias("path"), F.concat(first, second).alias("content"))))


@query("SELECT id, marker, name FROM (SELECT id, 'source' AS marker, CASE id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'config' END AS name FROM findings UNION ALL SELECT id, 'sink', CASE WHEN id % 2 = 0 THEN 'exec' END FROM findings) WHERE name IS NOT NULL")
def det10_flow_markers(t):
    body = F.concat(F.when(every("id", 3), "request.args['x']; os.environ['y'];").when(every("id", 3, 1), "os.environ['y'];").otherwise("z = 1;"), F.when(every("id", 2), " os.system(x)").otherwise(""))
    table = {"source": (("user", r"request\."), ("config", r"os\.environ")), "sink": (("exec", r"os\.system|exec\("), ("sql", r"execute\("))}
    return surface.flow_markers(t("findings").select("id", body.alias("body")), table)


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'python,security' WHEN 1 THEN 'java,owasp,security' WHEN 2 THEN 'flask,python,security' ELSE 'security' END AS sets FROM findings")
def flt25_rule_selection(t):
    table = {"python": ("python",), "java": ("java", "owasp"), "flask": ("flask", "python", "unlisted")}
    official = ("security", "python", "java", "owasp", "flask")
    stack = F.when(every("id", 4), F.array(F.lit("Python"))).when(every("id", 4, 1), F.array(F.lit("java"))).when(every("id", 4, 2), F.array(F.lit("python"), F.lit("Flask"))).otherwise(F.array(F.lit("cobol")))
    return t("findings").select("id", F.array_join(op.rule_sets(stack, table, official), ",").alias("sets"))


# --- outputs

LEVEL = "CASE WHEN complexity >= 0.8e0 THEN 'critical' WHEN complexity >= 0.6e0 THEN 'high' WHEN complexity >= 0.4e0 THEN 'medium' WHEN complexity >= 0.2e0 THEN 'low' ELSE 'skip' END"


def _targets(t) -> DataFrame:
    from ..operators.decisions import audit_level

    return t("targets").withColumn("level", audit_level(F.col("complexity"))).withColumn("score", F.col("complexity")).withColumn("loc", F.col("n_params") * 10)


@query(f"SELECT id, {LEVEL} AS level FROM targets ORDER BY CASE {LEVEL} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, complexity DESC, id LIMIT 200")
def srt5_targets_by_level(t):
    return op.by_level(_targets(t)).limit(200).select("id", "level")


@query("SELECT id FROM targets ORDER BY n_params DESC, id LIMIT 200")
def srt6_task_queue(t):
    return op.queue(t("targets").withColumnRenamed("n_params", "priority")).limit(200).select("id")


@query(f"SELECT {LEVEL} AS level, count(*) AS targets, CAST(sum(n_params * 10) AS BIGINT) AS loc FROM targets GROUP BY 1")
def agg27_strategy_summary(t):
    return op.strategy_summary(_targets(t))


@query("SELECT risk, count(*) AS n FROM (SELECT CASE severity WHEN 'critical' THEN 'high' ELSE severity END AS risk FROM findings) GROUP BY 1")
def agg34_risk_counts(t):
    return op.risk_counts(t("findings").withColumn("risk", F.when(F.col("severity") == "critical", "high").otherwise(F.col("severity"))))


@query("SELECT kind, concat('## ', kind, ' (', count(*), ')', chr(10), string_agg(line_, chr(10) ORDER BY rn) FILTER (WHERE rn <= 20)) AS value FROM (SELECT rule_id AS kind, concat('- `GET /', id, '` ', path, ':', line) AS line_, row_number() OVER (PARTITION BY rule_id ORDER BY path, line) AS rn FROM (SELECT *, concat(file, '#', printf('%012d', id)) AS path FROM findings)) GROUP BY 1")
def snk8_surface_markdown(t):
    path = F.concat("file", F.lit("#"), F.lpad(F.col("id").cast("string"), 12, "0"))
    e = t("findings").select(F.col("rule_id").alias("kind"), path.alias("path"), "line", F.lit("GET").alias("method"), F.concat(F.lit("/"), F.col("id").cast("string")).alias("route"))
    return op.surface_markdown(e)


@query("SELECT file AS path, count(*) AS n, min(line) AS first_line FROM findings GROUP BY 1")
def snk9_api3_config_json(t):
    docs = op.config_json(t("findings").select(F.col("file").alias("path"), "line", F.col("rule_id").alias("rule"), F.col("severity").alias("risk")))
    v = F.from_json("value", "count bigint, findings array<struct<line:int,rule:string,risk:string>>")
    return docs.select("path", v["count"].alias("n"), v["findings"][0]["line"].alias("first_line"))


@query(f"SELECT level, concat(level, ':', chr(10), '  targets: ', targets, chr(10), '  timeout_seconds: 60', chr(10), '  agent: true') AS value FROM (SELECT {LEVEL} AS level, count(*) AS targets FROM targets GROUP BY 1)")
def snk10_strategy_yaml(t):
    return op.strategy_yaml(_targets(t).groupBy("level").agg(F.count("*").alias("targets")).withColumn("timeout_s", F.lit(60)).withColumn("agent", F.lit(True)))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN concat(id, ': skipped, low_severity') ELSE concat(id, ': confirmed (50%)') END AS line FROM findings")
def aux19_session_report(t):
    f = t("findings")
    return op.session_report(f.where("id % 3 <> 0").select("id", F.lit("confirmed").alias("verdict"), F.lit(0.5).alias("confidence")), f.where("id % 3 = 0").select("id", F.lit("low_severity").alias("reason")))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'drop' ELSE 'scan' END AS action, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'deleted' ELSE 'modified' END ELSE 'depends on a change' END AS reason FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def aux27_scan_plan(t):
    o = t("orders").withColumn("path", F.col("o_orderkey").cast("string"))
    return op.scan_plan(o.where("o_orderkey % 3 = 0").select("path", F.when(F.col("o_orderkey") % 5 == 0, "deleted").otherwise("modified").alias("change")), o.where("o_orderkey % 2 = 0").select("path"))


@query("SELECT path, CAST(len(string_split(text, chr(10))) AS INT) AS loc FROM files WHERE lower(regexp_extract(path, '(\\.[A-Za-z0-9]+)$', 1)) IN ('.py', '.java', '.go')")
def aux2_file_targets(t):
    return op.file_targets(t("files"), (".py", ".java", ".go"))


@query("SELECT path, target, snippet FROM (SELECT concat('p', l.l_suppkey) AS path, d.path AS target, substr(d.text, 1, 500) AS snippet, row_number() OVER (PARTITION BY l.l_suppkey ORDER BY l.line, d.path) AS rn FROM (SELECT l_suppkey, l_partkey % 200 AS k, min(l_orderkey) AS line FROM lineitem GROUP BY 1, 2) l JOIN files d ON d.input_seq = l.k) WHERE rn <= 5")
def aux26_context(t):
    files = t("files")
    calls = t("lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 200).alias("input_seq")).agg(F.min("l_orderkey").alias("line"))
    imports = calls.join(files.select("input_seq", F.col("path").alias("target")), "input_seq").select(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("path"), "target", "line")
    return op.context(imports, files)


@query("SELECT count(*) AS functions, count(*) AS files FROM (SELECT s_suppkey AS k FROM supplier)".replace("count(*) AS functions", "count(*) * 2 AS functions"))
def api4_parse(t):
    return structure.python_structure(_programs(t)).where("kind = 'function'").agg(F.count("*").alias("functions"), F.countDistinct("path").alias("files"))


@query("SELECT rule_id, file, line, min(id) AS id FROM findings WHERE source = 'semgrep' GROUP BY 1, 2, 3")
def api5_single_engine(t):
    from ..operators.findings import first_of_key

    return first_of_key(t("findings").where("source = 'semgrep'"), ["rule_id", "file", "line"]).select("rule_id", "file", "line", "id")
