"""Reports and exports as rows of text or JSON, and the counts in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dims import lookup

LEVELS = ("critical", "high", "medium", "low", "skip")


def by_level(targets: DataFrame, seq: str = "id") -> DataFrame:
    """Targets in order of level, then score, then id."""
    return targets.orderBy(lookup(F.col("level"), {v: k for k, v in enumerate(LEVELS)}, len(LEVELS)), F.desc("score"), seq)


def queue(tasks: DataFrame, seq: str = "id") -> DataFrame:
    """Tasks by priority, first come first."""
    return tasks.orderBy(F.desc("priority"), seq)


def strategy_summary(targets: DataFrame) -> DataFrame:
    """(level, targets, loc) of a strategy."""
    return targets.groupBy("level").agg(F.count("*").alias("targets"), F.sum("loc").cast("bigint").alias("loc"))


def risk_counts(findings: DataFrame, risk: str = "risk") -> DataFrame:
    return findings.groupBy(risk).agg(F.count("*").alias("n"))


def surface_markdown(entries: DataFrame, most: int = 20) -> DataFrame:
    """(kind, value): a Markdown section for each kind of entry point, with its number and the first ones by path and line."""
    # the rank is cut to ``most`` before the shuffle; the numbers are counted apart
    first = entries.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("path", "line"))).where(F.col("_n") <= most)
    line = F.struct("_n", F.concat(F.lit("- `"), F.concat_ws(" ", "method", "route"), F.lit("` "), F.concat_ws(":", "path", F.col("line").cast("string"))).alias("t"))
    body = first.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("body"))
    g = entries.groupBy("kind").agg(F.count("*").alias("n")).join(body, "kind")
    return g.select("kind", F.concat(F.lit("## "), "kind", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), "body").alias("value"))


def config_json(findings: DataFrame) -> DataFrame:
    """(path, value): the findings of each configuration file as one JSON document, by line."""
    rows = F.array_sort(F.collect_list(F.struct("line", "rule", "risk")))
    return findings.groupBy("path").agg(F.to_json(F.struct(F.count("*").alias("count"), rows.alias("findings"))).alias("value"))


def strategy_yaml(groups: DataFrame) -> DataFrame:
    """(level, value): one YAML block a level."""
    row = lambda name, c: F.concat(F.lit(f"  {name}: "), F.col(c).cast("string"))
    return groups.select("level", F.concat_ws("\n", F.concat("level", F.lit(":")), row("targets", "targets"), row("timeout_seconds", "timeout_s"), row("agent", "agent")).alias("value"))


def session_report(results: DataFrame, skipped: DataFrame) -> DataFrame:
    """(id, line): a line for every finding of a session; those passed over say why."""
    done = results.select("id", F.format_string("%s: %s (%.0f%%)", F.col("id").cast("string"), "verdict", F.col("confidence") * 100).alias("line"))
    return done.unionByName(skipped.select("id", F.concat(F.col("id").cast("string"), F.lit(": skipped, "), "reason").alias("line")))


def scan_plan(changes: DataFrame, impacted: DataFrame) -> DataFrame:
    """(path, action, reason) of an incremental scan: changed files first; a file that is both is changed."""
    a = changes.select("path", F.when(F.col("change") == "deleted", "drop").otherwise("scan").alias("action"), F.col("change").alias("reason"), F.lit(0).alias("_r"))
    b = impacted.select("path", F.lit("scan").alias("action"), F.lit("depends on a change").alias("reason"), F.lit(1).alias("_r"))
    return a.unionByName(b).groupBy("path").agg(F.min_by(F.struct("action", "reason"), "_r").alias("x")).select("path", "x.*")


def file_targets(files: DataFrame, extensions: tuple[str, ...], path: str = "path", text: str = "text") -> DataFrame:
    """(path, loc): source files as audit targets."""
    return files.where(F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)).isin(*extensions)).select(path, F.size(F.split(text, "\n")).alias("loc"))


def rule_sets(stack: Column, table: dict[str, tuple[str, ...]], official: tuple[str, ...], always: tuple[str, ...] = ("security",)) -> Column:
    """Sorted rule sets for an array of language and framework names: what the table gives for each, and what is always used, as far as they are official."""
    sets = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = F.flatten(F.transform(stack, lambda s: F.coalesce(F.try_element_at(sets, F.lower(s)), F.array().cast("array<string>"))))
    return F.array_sort(F.array_intersect(F.array_distinct(F.concat(F.array(*map(F.lit, always)), found)), F.array(*map(F.lit, official))))


def context(imports: DataFrame, files: DataFrame, most: int = 5, chars: int = 500) -> DataFrame:
    """(path, target, snippet): the first ``most`` files that a file imports, by line, with the start of their text; the cap is the report's."""
    ranked = imports.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("line", "target"))).where(F.col("_n") <= most)
    return ranked.join(files.select(F.col("path").alias("target"), F.left("text", F.lit(chars)).alias("snippet")), "target").select("path", "target", "snippet")
