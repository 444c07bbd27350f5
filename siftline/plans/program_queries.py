"""Structure, entry points and calls of Java and Go texts that vary with their row; the twins search the same texts line by line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import braces, structure, surface
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


def _files(t):
    return t("programs").select("path", "content")


LINES = r"WITH a AS (SELECT k, path, content, string_split(content, chr(10)) AS parts FROM programs), l AS (SELECT k, path, content, unnest(parts) AS text, unnest(range(1, len(parts) + 1)) AS line FROM a), c AS (SELECT * FROM l WHERE NOT regexp_matches(text, '^(//|/\*|var s)'))"


@query(
    LINES
    + r""" SELECT path, CAST(sum(len(regexp_extract_all(text, '(?:void|int) (m\d)\(|func (?:\(s \*Srv\) )?\w+\('))) AS BIGINT) AS functions, CAST(sum(len(regexp_extract_all(text, '(?:class|interface) \w+ \{'))) AS BIGINT) AS classes,
  CAST(sum(len(regexp_extract_all(text, '(?:C\d+\.m1|[{] m0|s\.length|r\.Group|\w\.POST|\w\.GET|c\.AddFunc|s\.run)\('))) AS BIGINT) AS calls, CAST(sum(len(regexp_extract_all(text, '^import '))) AS BIGINT) AS imports FROM c GROUP BY path"""
)
def det9_aux7_brace_structure(t):
    n = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    return braces.brace_structure(_files(t)).groupBy("path").agg(n("function", "functions"), n("class", "classes"), n("call", "calls"), n("import", "imports"))


ENTRIES = (
    LINES
    + r""" SELECT path, line, 'http' AS kind, 'spring' AS framework, 'GET' AS method, regexp_extract(content, '@RequestMapping\("([^"]*)"', 1) || regexp_extract(text, '@GetMapping\("([^"]*)"', 1) AS route, regexp_extract(text, 'void (\w+)\(', 1) AS handler FROM c WHERE contains(text, '@GetMapping')
  UNION ALL SELECT path, line, 'mq', 'kafka', NULL, regexp_extract(text, 'topics = "([^"]*)"', 1), regexp_extract(text, 'void (\w+)\(', 1) FROM c WHERE contains(text, '@KafkaListener')
  UNION ALL SELECT path, line, 'http', 'gin', regexp_extract(text, '\.(GET|POST)\(', 1), CASE WHEN contains(text, ' v.') THEN regexp_extract(content, 'Group\("([^"]*)"', 1) ELSE '' END || regexp_extract(text, '\("([^"]*)"', 1), regexp_extract(text, ', (\w+)\)', 1) FROM c WHERE regexp_matches(text, '\.(GET|POST)\(')
  UNION ALL SELECT path, line, 'cron', 'cron', NULL, regexp_extract(text, '\("([^"]*)"', 1), regexp_extract(text, ', (\w+)\)', 1) FROM c WHERE contains(text, 'AddFunc')"""
)


@query(ENTRIES)
def det6_brace_entry_points(t):
    return braces.brace_entry_points(braces.brace_structure(_files(t)))


@query(f"WITH e AS ({ENTRIES}) SELECT path, line, kind, route, 'syntax' AS tier FROM e UNION ALL SELECT path, 1, 'file', NULL, 'file' FROM programs WHERE path NOT IN (SELECT path FROM e) AND regexp_matches(path, '(^|/)(main|app|server|index|manage)\\.[a-z]+$')")
def det7_brace_cascade(t):
    """Parsed rows are preferred; here comments and strings hold decoys that patterns alone would take for entries."""
    files = _files(t)
    return surface.cascade(files, braces.brace_entry_points(braces.brace_structure(files))).select("path", "line", "kind", "route", "tier")


@query(
    LINES
    + r""", d AS (SELECT path, regexp_extract(path, '(C\d+)\.java', 1) AS class, unnest(regexp_extract_all(text, '(?:void|int) (m[012])\(', 1)) AS name FROM c WHERE path LIKE '%.java'),
  u AS (SELECT path, regexp_extract(path, '(C\d+)\.java', 1) AS class, regexp_extract(text, '(?:void|int) (m\d)\(', 1) AS caller, regexp_extract(text, '(C\d+)\.m1\(', 1) AS other, contains(text, '{ m0(') AS own FROM c WHERE path LIKE '%.java' AND regexp_matches(text, '(?:void|int) m\d\('))
  SELECT concat(u.path, ':', u.class, '.', u.caller) AS src, concat(d.path, ':', d.class, '.', d.name) AS dst FROM u JOIN d ON (d.class = u.other AND d.name = 'm1') OR (u.own AND d.path = u.path AND d.name = 'm0')"""
)
def grf1_jon12_import_calls(t):
    """Calls of Java files through their imports and inside their class."""
    files = _files(t).where("path like '%.java'")
    return structure.call_graph(braces.brace_structure(files))[1]
