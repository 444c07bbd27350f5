"""Semantic identity, merging, budgets and baseline diffs of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_code, normalize_function, normalize_path
from .dims import ENGINE_MERGE_WEIGHT, EXPLOITABILITY_LEVEL, lookup
from .findings import near_lines
from .rounds import numbered


def semantic_hash() -> Column:
    """Identity across engines: rule, file, function, sink, source, category and flow, without lines."""
    category = F.when(F.col("cwe").isNotNull(), F.concat(F.lit("cwe:"), "cwe")).otherwise(F.concat(F.lit("rule:"), F.coalesce("rule_id", F.lit("unknown"))))
    parts = [F.coalesce("rule_id", F.lit("unknown")), normalize_path(F.col("file")), normalize_function(F.col("function")), normalize_code(F.coalesce("sink", "function")), F.lit(""), category, F.lit("")]
    return F.concat(F.lit("ast_"), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16)))


def logical_id() -> Column:
    """Identity of a vulnerability at a place: rule, file with line, sink."""
    text = F.concat_ws("|", F.coalesce("rule_id", F.lit("unknown")), F.concat_ws(":", "file", F.col("line").cast("string")), F.coalesce("sink", F.lit("")))
    return F.left(F.sha2(text, 256), F.lit(16))


def merge_groups(df: DataFrame, key: str = "ast_hash", seq: str = "input_seq") -> DataFrame:
    """The best finding of every group, its merged engines in order of rank, and how many it absorbed.

    One aggregation: the best row is the greatest struct of score, engine
    weight, exploitability and earliness, so groups are combined map-side.
    """
    rank = F.struct(
        F.coalesce("final_score", F.lit(0.0)).alias("score"), lookup(F.lower("source"), ENGINE_MERGE_WEIGHT, 0.5).alias("weight"), lookup(F.lower("exploitability"), EXPLOITABILITY_LEVEL, 0).alias("level"), (-F.col(seq)).alias("early")
    )
    row = F.struct(*[F.col(c) for c in df.columns if c != key])
    groups = df.groupBy(key).agg(F.max_by(row, rank).alias("row"), (F.count("*") - 1).alias("duplicate_count"), F.sort_array(F.collect_set("source")).alias("related_engines"))
    return groups.select(key, "row.*", "duplicate_count", F.concat_ws(",", "related_engines").alias("related_engines"))


def duplicate_groups(df: DataFrame, key: str = "ast_hash") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


# Fixed limits of the finding budget.
PER_RULE, PER_FILE, TOTAL = 50, 80, 1000
MELT_RULE, MELT_FILE, MELT_TOTAL, THROTTLED_RULES = 200, 300, 1500, 3
GENERIC = ("generic", "audit", "best-practice")


def budget_mode(df: DataFrame, per_rule: int = PER_RULE, melt_rule: int = MELT_RULE, melt_file: int = MELT_FILE, melt_total: int = MELT_TOTAL) -> DataFrame:
    """One row: normal, throttled or meltdown, with the counts that decide."""
    rules = df.groupBy("rule_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_rule"), F.count_if(F.col("n") > per_rule).alias("rules_over"), F.sum("n").alias("total"))
    files = df.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_file"))
    both = rules.crossJoin(files)
    mode = F.when((F.col("total") > melt_total) | (F.col("max_rule") > melt_rule) | (F.col("max_file") > melt_file), "meltdown").when(F.col("rules_over") >= THROTTLED_RULES, "throttled").otherwise("normal")
    return both.select("total", "max_rule", "max_file", "rules_over", mode.alias("mode"))


#: Ranks up to this are cut before the shuffle.
WINDOW_LIMIT = 1000


def apply_budget(df: DataFrame, per_rule: int = PER_RULE, per_file: int = PER_FILE, total: int = TOTAL, seq: str = "input_seq") -> DataFrame:
    """The first ``per_rule`` findings of a rule, then ``per_file`` of a file, then ``total``; rules in order of first sight.

    Small limits are taken before rows are shuffled; a limit that large rules
    would pass is taken from numbers that no task counts alone.
    """
    if per_rule <= WINDOW_LIMIT:
        kept = df.withColumn("_rule_rank", F.row_number().over(Window.partitionBy("rule_id").orderBy(seq)))
    else:
        kept = numbered(df, [F.col(seq)], "rule_id", "_rule_rank")
    kept = kept.where(F.col("_rule_rank") <= per_rule)
    first = df.groupBy(F.col("rule_id").alias("_rule")).agg(F.min(seq).alias("_rule_seq"))
    kept = kept.join(first, F.col("rule_id").eqNullSafe(F.col("_rule"))).drop("_rule")
    kept = kept.withColumn("_file_rank", F.row_number().over(Window.partitionBy("file").orderBy("_rule_seq", seq))).where(F.col("_file_rank") <= per_file)
    return kept.orderBy("_rule_seq", seq).limit(total).drop("_rule_rank", "_rule_seq", "_file_rank")


def baseline_diff(current: DataFrame, baseline: DataFrame, band: int = 5) -> DataFrame:
    """(status, current id, baseline id): new, persistent, regressed or fixed.

    A finding takes the first baseline, in insertion order, of its file and
    rule within ``band`` lines; several may take the same one.
    """
    b = baseline.select(F.col("baseline_seq"), F.col("vuln_id"), F.col("rule_id"), F.col("file"), F.col("line").alias("base_line"), F.col("fixed"))
    near = near_lines(current, b, ["file", "rule_id"], band, other="base_line")
    best = near.groupBy("input_seq").agg(F.min_by(F.struct("vuln_id", "fixed"), "baseline_seq").alias("m"))
    matched = current.select("input_seq").join(best, "input_seq", "left")
    status = F.when(F.col("m").isNull(), "new").when(F.col("m.fixed"), "regressed").otherwise("persistent")
    now = matched.select(status.alias("status"), F.col("input_seq").alias("current_id"), F.col("m.vuln_id").alias("baseline_id"))
    gone = b.join(best.select(F.col("m.vuln_id").alias("vuln_id")).distinct(), "vuln_id", "left_anti")
    return now.unionByName(gone.select(F.lit("fixed").alias("status"), F.lit(None).cast("bigint").alias("current_id"), F.col("vuln_id").alias("baseline_id")))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` with rows of ``new`` added, and ``columns`` of matching rows taken from it."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    pick = lambda c: F.when(F.col(f"b.{key}").isNotNull() & (F.col(f"a.{key}").isNull() | F.lit(c in columns)), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[pick(c).alias(c) for c in old.columns if c != key])


def baseline_statistics(baseline: DataFrame, key: str = "rule_id") -> DataFrame:
    return baseline.groupBy(key).agg(F.count("*").alias("n"), F.count_if("fixed").alias("fixed"), F.countDistinct("file").alias("files"), F.min("vuln_id").alias("first_id"), F.max("vuln_id").alias("last_id"))
