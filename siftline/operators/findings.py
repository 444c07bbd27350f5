"""Filters, orders and counts of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dims import REPORT_PRIORITY, SEVERITIES, SUPPRESSING_FILTERS, lookup, severity_rank


def by_severity(df: DataFrame, severities: list[str], column: str = "severity") -> DataFrame:
    return df.where(F.col(column).isin(severities))


def at_least(df: DataFrame, severity: str, column: str = "severity") -> DataFrame:
    """Findings at or above a severity."""
    return df.where(severity_rank(F.col(column)) <= SEVERITIES.index(severity))


def suppressed() -> Column:
    return F.coalesce(F.col("suppressed"), F.lit(False)) | F.coalesce(F.col("filtered_by").isin(list(SUPPRESSING_FILTERS)), F.lit(False))


def report_status(status: str = "final_status") -> Column:
    """Suppressed first, then the final status; conditional where that says nothing."""
    value = F.lower(F.trim(F.col(status)))
    return (
        F.when(suppressed(), "suppressed")
        .when(value == "exploitable", "exploitable")
        .when(value == "conditional", "conditional")
        .when(value.isin("informational", "not_exploitable"), "informational")
        .otherwise("conditional")
    )


def actionable(df: DataFrame, column: str = "report_status") -> DataFrame:
    return df.where(F.col(column).isin("exploitable", "conditional"))


def sort_by_severity(df: DataFrame, seq: str = "input_seq") -> DataFrame:
    return df.orderBy(severity_rank(F.col("severity")), seq)


def sort_by_report_status(df: DataFrame, seq: str = "input_seq") -> DataFrame:
    return df.orderBy(lookup(F.col("report_status"), REPORT_PRIORITY, 0).desc(), seq)


def sort_by_score(df: DataFrame, seq: str = "input_seq") -> DataFrame:
    return df.orderBy(F.coalesce("final_score", F.lit(0.0)).desc(), seq)


def zero_filled_counts(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """One row per value of ``domain``, whether it occurs or not: one aggregate, no join."""
    counts = df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in domain])
    return counts.select(F.expr("stack({}, {})".format(len(domain), ", ".join(f"'{v}', `{v}`" for v in domain))).alias(column, "n"))


def first_of_key(df: DataFrame, keys: list[str], seq: str = "input_seq") -> DataFrame:
    """The first row, by ``seq``, of every key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(seq))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_of_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def similar_skips(df: DataFrame, minimum: float = 0.7, seq: str = "input_seq") -> DataFrame:
    """Whether an earlier confident finding of the same type has the same last two path parts."""
    key = [F.col("type"), F.substring_index(F.substring_index("file", ":", 1), "/", -2)]
    earlier = Window.partitionBy(*key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.when(F.col("confidence") >= minimum, 1).otherwise(0)).over(earlier)
    return df.withColumn("duplicate", F.coalesce(seen, F.lit(0)) == 1)


def skip_reason(minimum: float = 0.3) -> Column:
    """Why verification passes a finding over, in order of precedence; null if it does not."""
    return F.when(F.col("severity") == "info", "info_level").when(F.col("severity") == "low", "low_severity").when(F.col("confidence") < minimum, "low_confidence")


def by_file(df: DataFrame, file: str) -> DataFrame:
    return df.where(F.col("file") == file)


def distinct_files(df: DataFrame) -> DataFrame:
    """Files with a finding, in order."""
    return df.select("file").distinct().orderBy("file")


def near_lines(left: DataFrame, right: DataFrame, keys: list[str], band: int, line: str = "line", other: str = "other_line") -> DataFrame:
    """Pairs of equal keys whose lines are at most ``band`` apart.

    Lines are cut into strips of the band's width plus one and a row of the right
    side goes to its own strip and both beside it, so the strip is part of an
    equi-join key and a hot key is no product of all its rows.
    """
    width = band + 1
    near = F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.floor(F.col(other) / width) + k)).alias("_strip")
    right = right.select("*", near)
    both = left.withColumn("_strip", F.floor(F.col(line) / width)).join(right, [*keys, "_strip"])
    return both.where(F.abs(F.col(line) - F.col(other)) <= band).drop("_strip")


def first_near(df: DataFrame, other: DataFrame, band: int = 5) -> DataFrame:
    """(id, other_id): the first finding of another engine, in order of id, at the line or within ``band`` lines."""
    b = other.select("file", "rule_id", F.col("id").alias("other_id"), F.col("line").alias("other_line"))
    return near_lines(df.select("id", "file", "rule_id", "line"), b, ["file", "rule_id"], band).groupBy("id").agg(F.min("other_id").alias("other_id"))


def source_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("suppressed").alias("suppressed"), F.countDistinct("file").alias("files"), F.countDistinct("rule_id").alias("rules"), F.round(F.avg("confidence"), 6).alias("mean"), F.max("line").alias("last_line")
    )


def union_engines(parts: dict[str, DataFrame]) -> DataFrame:
    """All engines' findings, each with its engine as source."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def files_in_time(df: DataFrame, limit: int) -> DataFrame:
    """The files to look at first, as many as the time allows: most critical, then most high findings."""
    severe = lambda s: F.count_if(F.col("severity") == s).alias(s)
    groups = df.groupBy("file").agg(F.count("*").alias("n"), severe("critical"), severe("high"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("engines"))
    return groups.orderBy(F.desc("critical"), F.desc("high"), "file").limit(limit)


def recent_history(df: DataFrame, key: str, keep: int, seq: str = "input_seq") -> DataFrame:
    """The last ``keep`` rows of every key, numbered from the latest in ``n``."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where(F.col("n") <= keep)


def with_verdicts(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with the verdict and its confidence; ``unverified`` and 0 where there is none."""
    v = verdicts.select("id", F.col("verdict").alias("_v"), F.col("confidence").alias("_c"))
    return df.join(v, "id", "left").withColumn("verdict", F.coalesce("_v", F.lit("unverified"))).withColumn("verdict_confidence", F.coalesce("_c", F.lit(0.0))).drop("_v", "_c")


def display(severity: Column, title: Column, file: Column, line: Column) -> Column:
    """One line for people: ``[HIGH] title (file:line)``."""
    return F.concat(F.lit("["), F.upper(severity), F.lit("] "), title, F.lit(" ("), F.concat_ws(":", file, line.cast("string")), F.lit(")"))
