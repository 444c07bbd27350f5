"""Scanner output as rows: pattern-match JSON, SARIF and advisory feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dims import lookup

# Fixed maps.
LEVELS = {"error": "high", "warning": "medium", "note": "low", "none": "info"}
MATCH_SEVERITY = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
CONFIDENCE = {"HIGH": 0.9, "MEDIUM": 0.7, "LOW": 0.5}
MATCH_SCHEMA = """results ARRAY<STRUCT<check_id:STRING, path:STRING, start:STRUCT<line:INT,col:INT>, `end`:STRUCT<line:INT,col:INT>,
  extra:STRUCT<message:STRING, severity:STRING, lines:STRING, metadata:STRUCT<category:STRING, cwe:STRING, owasp:STRING, confidence:STRING, severity:STRING>>>>"""
_PLACE = "STRUCT<physicalLocation:STRUCT<artifactLocation:STRUCT<uri:STRING>,region:STRUCT<startLine:INT,startColumn:INT,endLine:INT,snippet:STRUCT<text:STRING>>>>"
SARIF_SCHEMA = f"""runs ARRAY<STRUCT<results:ARRAY<STRUCT<ruleId:STRING, level:STRING, message:STRUCT<text:STRING>, locations:ARRAY<{_PLACE}>,
  codeFlows:ARRAY<STRUCT<threadFlows:ARRAY<STRUCT<locations:ARRAY<STRUCT<location:{_PLACE}>>>>>>>>>>"""


def _first(raw: Column) -> Column:
    """First element of what is a JSON list, or the value itself."""
    return F.coalesce(F.get_json_object(raw, "$[0]"), raw)


def pattern_matches(documents: DataFrame, column: str = "value") -> DataFrame:
    """Findings of pattern-match JSON documents; invalid documents give no row."""
    r = documents.select(F.explode(F.from_json(column, MATCH_SCHEMA)["results"]).alias("r")).where("r.start.line >= 1")
    meta = F.col("r.extra.metadata")
    severity = F.coalesce(F.lower(meta["severity"]), lookup(F.col("r.extra.severity"), MATCH_SEVERITY, "medium"))
    return r.select(
        F.col("r.check_id").alias("rule_id"), F.col("r.path").alias("file"), F.col("r.start.line").alias("line"), F.coalesce("r.end.line", "r.start.line").alias("end_line"), severity.alias("severity"),
        F.when(meta["category"] == "security", "vulnerability").otherwise("suspicious").alias("type"), lookup(F.upper(meta["confidence"]), CONFIDENCE, 0.7).alias("confidence"),
        F.nullif(F.regexp_extract(_first(meta["cwe"]), r"(CWE-\d+)", 1), F.lit("")).alias("cwe"), _first(meta["owasp"]).alias("owasp"), F.col("r.extra.message").alias("message"),
    )


def sarif_results(documents: DataFrame, column: str = "value") -> DataFrame:
    """Findings with the ordered steps of their first data flow, or of their locations where there is none."""
    results = documents.select(F.explode(F.from_json(column, SARIF_SCHEMA)["runs"]).alias("run")).select(F.explode("run.results").alias("r"))
    flow = F.transform(F.get(F.get(F.col("r.codeFlows"), F.lit(0))["threadFlows"], F.lit(0))["locations"], lambda x: x["location"])
    steps = F.transform(
        F.coalesce(flow, F.col("r.locations")), lambda x, k: F.struct((k + 1).alias("step"), F.regexp_replace(x["physicalLocation"]["artifactLocation"]["uri"], "^file://", "").alias("file"), x["physicalLocation"]["region"]["startLine"].alias("line"))
    )
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    return results.select(
        F.col("r.ruleId").alias("rule_id"), F.regexp_replace(place["artifactLocation"]["uri"], "^file://", "").alias("file"), place["region"]["startLine"].alias("line"), lookup(F.lower("r.level"), LEVELS, "medium").alias("severity"),
        F.lit(0.85).alias("confidence"), steps.alias("steps"), (flow.isNotNull() & (F.size(flow) >= 2)).alias("complete"),
    )


def exploited_catalogue(documents: DataFrame, column: str = "value") -> DataFrame:
    """(cve_id, vendor, product, added, ransomware) of a known-exploited feed."""
    schema = "vulnerabilities ARRAY<STRUCT<cveID:STRING, vendorProject:STRING, product:STRING, dateAdded:STRING, knownRansomwareCampaignUse:STRING>>"
    v = documents.select(F.explode(F.from_json(column, schema)["vulnerabilities"]).alias("v"))
    return v.select(F.col("v.cveID").alias("cve_id"), F.col("v.vendorProject").alias("vendor"), F.col("v.product").alias("product"), F.try_to_timestamp("v.dateAdded").cast("date").alias("added"), (F.lower("v.knownRansomwareCampaignUse") == "known").alias("ransomware"))


def advisories(documents: DataFrame, column: str = "value") -> DataFrame:
    """(advisory, cve_id, ranges) of advisory records; every range event is a string of its own."""
    schema = "id STRING, aliases ARRAY<STRING>, affected ARRAY<STRUCT<ranges:ARRAY<STRUCT<events:ARRAY<MAP<STRING,STRING>>>>>>"
    a = documents.select(F.from_json(column, schema).alias("a")).where("a.id is not null")
    events = F.flatten(F.flatten(F.transform("a.affected", lambda x: F.transform(x["ranges"], lambda r: r["events"]))))
    text = F.transform(events, lambda e: F.when(e["introduced"].isNotNull(), F.concat(F.lit(">="), e["introduced"])).when(e["fixed"].isNotNull(), F.concat(F.lit("<"), e["fixed"])))
    alias = F.get(F.filter("a.aliases", lambda x: x.startswith("CVE-")), F.lit(0))
    return a.select(F.col("a.id").alias("advisory"), F.coalesce(alias, F.col("a.id")).alias("cve_id"), F.array_compact(text).alias("ranges"))


def exploit_rows(table: DataFrame) -> DataFrame:
    """Exploit-archive CSV rows with the CVE ids of their codes."""
    kind = F.lower("type")
    return table.select("id", F.array_distinct(F.regexp_extract_all(F.upper("codes"), F.lit(r"CVE-\d{4}-\d{4,}"), F.lit(0))).alias("cve_ids"), F.when(kind.isin("dos", "local", "remote", "webapps"), F.when(kind == "webapps", "webapp").otherwise(kind)).otherwise("other").alias("poc_type"), F.try_to_timestamp("date").cast("date").alias("published"))
