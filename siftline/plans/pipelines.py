"""End-to-end plans: full scan, incremental scan, vulnerability lookup, audit strategy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import decisions as dc
from ..operators import dedup as dd
from ..operators import findings as fd
from ..operators import graph as gr
from ..operators import intel as it
from ..operators import strategy as st
from ..sources import manifests, reports

#: Readers by kind: each turns a table of documents into rows. Callers may add their own.
FINDING_SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {"pattern": reports.pattern_matches, "sarif": reports.sarif_results}
DEPENDENCY_SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {"requirements": manifests.requirements, "npm": manifests.npm_manifest, "go": manifests.go_modules, "maven": manifests.maven}
FUSIONS: dict[str, str] = {"weighted": "weighted", "conservative": "conservative", "optimistic": "optimistic"}


def read_findings(documents: dict[str, DataFrame], engines: dict[str, str]) -> DataFrame:
    """Union of all sources with their engine; ``documents`` by source kind, ``engines`` names them."""
    parts = [FINDING_SOURCES[kind](docs).withColumn("source", F.lit(engines[kind])) for kind, docs in documents.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def full_scan(findings: DataFrame, verification: DataFrame | None = None, minimum: str = "info") -> DataFrame:
    """Findings scored, verified, adjudicated, merged across engines and mapped to a report status.

    ``verification`` (id, exploitability) overrides what a finding carries. One
    shuffle joins it, one merges duplicates; the rest is projection.
    """
    df = fd.at_least(findings, minimum)
    if verification is not None:
        better = verification.select("id", F.col("exploitability").alias("_verified"))
        df = df.join(better, "id", "left").withColumn("exploitability", F.coalesce("_verified", "exploitability")).drop("_verified")
    df = df.withColumn("final_score", dc.final_score()).withColumn("final_status", dc.final_status()).withColumn("ast_hash", dd.semantic_hash())
    return dd.merge_groups(df).withColumn("report_status", fd.report_status())


def incremental_scan(changes: DataFrame, edges: DataFrame, findings: DataFrame, baseline: DataFrame, max_depth: int = 3) -> DataFrame:
    """Baseline diff of the findings in changed files and in those that depend on them.

    ``changes`` has path and change; findings and baseline name the path ``file``.
    """
    seeds = changes.where("change <> 'deleted'").select("path").distinct()
    near = gr.impact(edges, seeds, max_depth).select(F.col("path").alias("file"))
    scope = near.unionByName(changes.select(F.col("path").alias("file"))).distinct()
    return dd.baseline_diff(findings.join(scope, "file", "left_semi"), baseline.join(scope, "file", "left_semi"))


def vulnerability_scan(deps: DataFrame, advisories: DataFrame, cves: DataFrame) -> DataFrame:
    """Per dependency: its CVEs, whether one is exploited, and the highest severity."""
    from ..functions.versions import skip_reason
    from ..operators.dims import severity_rank

    known = deps.where(skip_reason(F.col("version"), F.col("version_confidence")).isNull())
    hits = it.vulnerable(known, advisories).join(cves, "cve_id")
    return hits.groupBy("input_seq").agg(
        F.count("*").alias("n"), F.bool_or("kev").alias("has_kev"), F.min_by("severity", severity_rank(F.col("severity"))).alias("highest"), F.array_join(F.sort_array(F.collect_set(F.col("cve_id").cast("string"))), ",").alias("cve_ids")
    )


def audit_plan(targets: DataFrame) -> DataFrame:
    """Targets with priority, level and task, without test and generated code, most urgent first."""
    score = st.priority(F.col("complexity"), F.col("history"))
    rows = targets.where(~st.skipped(F.col("file_path"))).withColumn("score", score)
    return rows.withColumn("level", dc.audit_level(F.col("score"))).where("level <> 'skip'").withColumn("task", st.file_task(F.col("file_path"))).orderBy(F.desc("score"), "id")


def export_scan(report: DataFrame, path: str) -> None:
    """Write a report as Parquet, a folder for each report status."""
    report.write.mode("overwrite").partitionBy("report_status").parquet(path)


def save_snapshot(df: DataFrame, path: str, version: int) -> None:
    """A baseline version; versions stay side by side, so a reader of one never sees another half written."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_snapshot(spark, path: str, version: int | None = None) -> DataFrame:
    """A version, or the latest."""
    table = spark.read.parquet(path)
    wanted = version if version is not None else table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == wanted).drop("version")


def markdown(report: DataFrame, limit: int = 50) -> DataFrame:
    """Lines of a Markdown table of the most urgent findings, as a DataFrame of text."""
    rows = fd.sort_by_score(report).limit(limit)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "severity", "report_status", "rule_id", "file", F.col("line").cast("string")), F.lit(" |"))
    return rows.select(line.alias("value"))


def sync_all(spark, feeds: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(source, n, error): rows of every feed; one that fails is reported and does not keep the others from running."""
    rows = []
    for name, read in feeds.items():
        try:
            rows.append((name, read().count(), ""))
        except Exception as error:  # noqa: BLE001 - the report names whatever a feed raised
            rows.append((name, 0, f"{type(error).__name__}: {error}"))
    return spark.createDataFrame(rows, "source string, n bigint, error string")


def due_jobs(times: DataFrame, jobs: dict[str, Column], column: str = "at") -> DataFrame:
    """(at, job) of the jobs, the caller's own among them, whose condition holds at a time."""
    due = F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in jobs.items()]))
    return times.select(column, F.explode(due).alias("job"))


def streamed_totals(df: DataFrame, column: str) -> DataFrame:
    """One row (n, last): rows and greatest value of a whole-number column, from one generator over the batches of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, last = 0, None
        for batch in batches:
            n += batch.num_rows
            top = pc.max(batch.column(0)).as_py()
            last = top if last is None or (top is not None and top > last) else last
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([last], pa.int64())], names=["n", "last"])

    return df.select(F.col(column).cast("bigint")).mapInArrow(run, "n bigint, last bigint").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
