"""Vulnerability feeds, search results and model replies as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonfix import attempts, finished, once
from ..functions.text import identifiers
from ..operators.decisions import cvss_severity

_CVSS = "ARRAY<STRUCT<cvssData:STRUCT<baseScore:DOUBLE, vectorString:STRING>>>"
NVD_SCHEMA = f"""id STRING, published STRING, lastModified STRING, descriptions ARRAY<STRUCT<lang:STRING, value:STRING>>,
  metrics STRUCT<cvssMetricV31:{_CVSS}, cvssMetricV30:{_CVSS}, cvssMetricV2:{_CVSS}>, weaknesses ARRAY<STRUCT<description:ARRAY<STRUCT<lang:STRING, value:STRING>>>>,
  configurations ARRAY<STRUCT<nodes:ARRAY<STRUCT<cpeMatch:ARRAY<STRUCT<criteria:STRING>>>>>>, `references` ARRAY<STRUCT<url:STRING, tags:ARRAY<STRING>>>"""
# Items of a model's reply.
FOUND = "STRUCT<type:STRING,title:STRING,severity:STRING,line:INT,cwe:STRING,confidence:DOUBLE>"
DOUBT = "STRUCT<location:STRING,why_suspicious:STRING,confidence:DOUBLE>"
TRUSTED_OWNERS = ("projectdiscovery", "rapid7", "vulhub")


def nvd_records(documents: DataFrame, column: str = "value") -> DataFrame:
    """One row per record: texts, the newest CVSS there is, distinct weaknesses and up to ten products, patch links."""
    c = documents.select(F.from_json(column, NVD_SCHEMA).alias("c")).where("c.id is not null")
    text = lambda lang: F.get(F.filter("c.descriptions", lambda d: d["lang"] == lang), F.lit(0))["value"]
    score = lambda v: F.get(F.col(f"c.metrics.{v}"), F.lit(0))["cvssData"]["baseScore"]
    weak = F.array_distinct(F.transform(F.filter(F.flatten(F.transform("c.weaknesses", lambda w: w["description"])), lambda d: (d["lang"] == "en") & d["value"].startswith("CWE-")), lambda d: d["value"]))
    cpes = F.flatten(F.flatten(F.transform("c.configurations", lambda x: F.transform(x["nodes"], lambda n: n["cpeMatch"]))))
    products = F.slice(F.array_distinct(F.transform(cpes, lambda m: F.concat_ws(":", F.split_part(m["criteria"], F.lit(":"), F.lit(4)), F.split_part(m["criteria"], F.lit(":"), F.lit(5))))), 1, 10)
    v3 = F.coalesce(score("cvssMetricV31"), score("cvssMetricV30"))
    return c.select(
        F.col("c.id").alias("cve_id"), text("en").alias("description"), text("zh").alias("description_zh"), v3.alias("cvss_v3"), score("cvssMetricV2").alias("cvss_v2"), cvss_severity(F.coalesce(v3, score("cvssMetricV2"))).alias("severity"),
        F.coalesce(weak, F.array().cast("array<string>")).alias("cwe_ids"), F.coalesce(products, F.array().cast("array<string>")).alias("products"), F.transform(F.filter("c.references", lambda r: F.array_contains(r["tags"], "Patch")), lambda r: r["url"]).alias("patches"),
        F.try_to_timestamp("c.published").alias("published"),
    )


def github_advisories(documents: DataFrame, column: str = "value") -> DataFrame:
    """(advisory, cve_id, severity, products, ranges): the CVE id, or the advisory's own."""
    schema = "ghsa_id STRING, cve_id STRING, severity STRING, vulnerabilities ARRAY<STRUCT<package:STRUCT<ecosystem:STRING,name:STRING>, vulnerable_version_range:STRING>>"
    a = documents.select(F.from_json(column, schema).alias("a")).where("a.ghsa_id is not null")
    return a.select(
        F.col("a.ghsa_id").alias("advisory"), F.coalesce("a.cve_id", "a.ghsa_id").alias("cve_id"), F.lower("a.severity").alias("severity"), F.array_distinct(F.transform("a.vulnerabilities", lambda v: v["package"]["name"])).alias("products"),
        F.array_compact(F.transform("a.vulnerabilities", lambda v: F.replace(v["vulnerable_version_range"], F.lit(" "), F.lit("")))).alias("ranges"),
    )


def go_modules_affected(entries: DataFrame, module: str, limit: int = 50) -> DataFrame:
    """Entries (id, module) of a module or of one below its path."""
    return entries.where((F.col("module") == module) | F.col("module").startswith(module + "/")).orderBy("id").limit(limit)


def poc_repositories(repos: DataFrame, min_stars: int = 1) -> DataFrame:
    """Repositories (name, owner, description, stars) that mention a CVE or an exploit; trusted owners or 100 stars verify."""
    text = F.concat_ws(" ", "name", "description")
    ids = identifiers(text, r"CVE-\d{4}-\d{4,}")
    rows = repos.withColumn("cve_ids", ids).where((F.col("stars") >= min_stars) & ((F.size("cve_ids") > 0) | F.regexp_like(F.lower(text), F.lit("exploit|poc|proof of concept"))))
    return rows.withColumn("verified", F.lower("owner").isin(*TRUSTED_OWNERS) | (F.col("stars") >= 100))


def search_union(engines: dict[str, DataFrame], limit: int = 10) -> DataFrame:
    """The first ``limit`` results of each engine, most relevant first, with the ids in their text."""
    parts = [df.withColumn("engine", F.lit(name)) for name, df in engines.items()]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    top = both.withColumn("_rank", F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("relevance"), "url"))).where(F.col("_rank") <= limit)
    text = F.concat_ws(" ", "title", "snippet")
    return top.drop("_rank").withColumn("cve_ids", identifiers(text, r"CVE-\d{4}-\d{4,}")).withColumn("cwe_ids", identifiers(text, r"CWE-\d+")).orderBy(F.desc("relevance"), "url")


def model_findings(replies: DataFrame, file: str = "file", column: str = "reply") -> DataFrame:
    """Findings and suspicious code of model replies, however the JSON is wrapped; unparsable replies give no row."""
    tried = replies.select(F.col(file).alias("file"), attempts(F.col(column)).alias("tried"))
    # both lists are taken from one parse, and replies are read once
    none = lambda kind: F.lit(None).cast(kind)
    found = lambda r: F.transform(r["findings"], lambda f: F.struct(F.lit(True).alias("known"), f.alias("f"), none(DOUBT).alias("s")))
    doubted = lambda r: F.transform(r["suspicious_code"], lambda s: F.struct(F.lit(False).alias("known"), none(FOUND).alias("f"), s.alias("s")))
    both = once(F.from_json(finished(F.col("tried")), f"findings ARRAY<{FOUND}>, suspicious_code ARRAY<{DOUBT}>"), lambda r: F.concat(F.coalesce(found(r), F.array()), F.coalesce(doubted(r), F.array())))
    # a plain explode would have the parse pushed into a filter below, once more
    rows = tried.select("file", F.posexplode_outer(both).alias("pos", "x")).where("pos is not null").select("file", "x.*")
    place = F.regexp_extract("s.location", r"^(.*):(\d+)$", 1)
    line = F.regexp_extract("s.location", r"^(.*):(\d+)$", 2).try_cast("int")
    known = F.col("known")
    return rows.select(
        F.when(~known & (place != ""), place).otherwise(F.col("file")).alias("file"), F.coalesce(F.when(known, F.col("f.line")).otherwise(line), F.lit(1)).alias("line"),
        F.when(known, F.lower(F.coalesce("f.severity", F.lit("medium")))).otherwise("low").alias("severity"), F.when(known, F.col("f.title")).otherwise(F.col("s.why_suspicious")).alias("title"),
        "f.cwe", F.when(known, F.col("f.confidence")).otherwise(F.col("s.confidence")).alias("confidence"),
    )


def paged_windows(published: DataFrame, days: int, page: int, column: str = "published") -> DataFrame:
    """(first_day, last_day, start_index): the requests that read a dated feed, window by window, page by page; one page of an empty window."""
    ends = published.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo is not null")
    windows = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.floor(F.datediff("hi", "lo") / days).cast("int"))).alias("k"))
    windows = windows.select("k", F.date_add("lo", F.col("k") * days).alias("first_day"), F.least("hi", F.date_add("lo", F.col("k") * days + (days - 1))).alias("last_day"))
    per = published.crossJoin(F.broadcast(ends)).select(F.floor(F.datediff(column, "lo") / days).cast("int").alias("k")).groupBy("k").agg(F.count("*").alias("total"))
    pages = F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.coalesce("total", F.lit(0)) - 1, F.lit(0)) / page))
    return windows.join(per, "k", "left").select("first_day", "last_day", F.explode(F.transform(pages, lambda p: p * page)).alias("start_index"))
