"""Trends, convergence, batching and budgets over ordered rounds and tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut


def trend(df: DataFrame, key: str, order: str, value: str, span: int = 3) -> DataFrame:
    """increasing, decreasing or stable, from the last ``span`` rounds of every key."""
    w = Window.partitionBy(key).orderBy(order)
    moved = df.withColumn("_sign", F.signum(F.col(value) - F.lag(value).over(w))).withColumn("_late", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())))
    recent = moved.where(F.col("_late") < span).groupBy(key).agg(F.count_if(F.col("_sign") > 0).alias("ups"), F.count_if(F.col("_sign") < 0).alias("downs"))
    return recent.select(key, "ups", "downs", F.when(F.col("ups") > F.col("downs"), "increasing").when(F.col("downs") > F.col("ups"), "decreasing").otherwise("stable").alias("trend"))


def running_cost(df: DataFrame, key: str, order: str, cost: str, limit: int) -> DataFrame:
    """Running total by round, and whether it has reached the limit."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(cost).over(w)).withColumn("over", F.col("running") >= limit)


def no_progress(df: DataFrame, key: str, order: str, value: str, least: float = 0.05) -> DataFrame:
    """Whether the best of the last two rounds is within ``least`` of the round before them."""
    w = Window.partitionBy(key).orderBy(order)
    best = F.greatest(F.col(value), F.lag(value, 1).over(w))
    before = F.lag(value, 2).over(w)
    return df.withColumn("stalled", F.coalesce(best <= before + least, F.lit(False)))


def since_new(df: DataFrame, key: str, order: str, item: str) -> DataFrame:
    """Rounds since the last item that had not been seen before."""
    w = Window.partitionBy(key).orderBy(order)
    first = F.row_number().over(Window.partitionBy(key, item).orderBy(order)) == 1
    fresh = df.withColumn("_fresh", first).withColumn("_n", F.row_number().over(w))
    last = F.max(F.when(F.col("_fresh"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return fresh.withColumn("stable_rounds", F.col("_n") - last).drop("_fresh", "_n")


def numbered(df: DataFrame, order: list[Column], group: str | None = None, name: str = "n") -> DataFrame:
    """``df`` with the number, from 1, of each row in ``order``, by ``group`` if one is given.

    Rows are cut by a global range sort; a row's number is its place in its range
    after the rows of the ranges before, so neither one order nor one large group
    is one task. ``order`` should leave no ties: rows of a tie stay in one range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group)] if group else []
    laid = _cut(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    names = [*([group] if group else []), "_range"]
    place = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    # one row for each range of a group; nulls are a group
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = laid.groupBy(*names).count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    counts = counts.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(names)], "_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(names)])
    rows = laid.withColumn("_place", place).join(counts, same)
    return rows.withColumn(name, (F.col("_place") + F.col("_before")).cast("bigint")).select(*df.columns, name)


def running_total(df: DataFrame, order: list[Column], value: str, name: str = "total") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each one in ``order``, cut as in :func:`numbered`."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = _cut(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = laid.groupBy("_range").agg(F.sum(value).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return laid.withColumn("_own", own).join(F.broadcast(sums), "_range").withColumn(name, (F.col("_own") + F.col("_before")).cast("bigint")).select(*df.columns, name)


def batches(df: DataFrame, kind: str, order: list[Column], size: int = 5) -> DataFrame:
    """Batch number of every task: chunks of ``size`` within a kind, in priority order."""
    return numbered(df, order, kind, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("bigint")).drop("_n")


def ordered_scan(df: DataFrame, key: str, order: list[str], columns: list[str], fresh: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], schema: str) -> DataFrame:
    """A sequential recurrence over each key's rows in order: ``step`` gives the next state and an output row.

    Rows are sorted where their key is and stream through in batches; a task
    holds one state and one batch, however many rows a key has.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        types = None
        for batch in batches:
            types = types or pa.schema([(n, _ARROW[t]) for n, t in (part.split() for part in schema.split(", "))])
            out = []
            for k, *row in zip(*(batch.column(j).to_pylist() for j in range(batch.num_columns))):
                if k != last:
                    last, state = k, fresh()
                state, made = step(state, tuple(row))
                out.append((k, *made))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], names=names)

    rows = df.repartition(key).sortWithinPartitions(key, *order)
    return rows.select(key, *columns).mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}


def greedy_fit(df: DataFrame, key: str, order: list[str], cost: str, budget: int, item: str) -> DataFrame:
    """(key, item, cost, taken): in order, an item is taken if it still fits; later smaller ones may fit after a skip."""
    kinds = dict(df.dtypes)

    def step(used: int, row: tuple) -> tuple[int, tuple]:
        name, price = row
        fits = used + price <= budget
        return (used + price if fits else used), (name, price, fits)

    rows = df.withColumn("_cost", F.col(cost).cast("bigint"))
    return ordered_scan(rows, key, order, [item, "_cost"], int, step, f"{key} {kinds[key]}, {item} {kinds[item]}, cost bigint, taken boolean")


def fit_summary(fit: DataFrame, key: str, item: str) -> DataFrame:
    """(key, n_taken, used) of :func:`greedy_fit`, keys without any taken item included."""
    return fit.groupBy(key).agg(F.count_if("taken").alias("n_taken"), F.coalesce(F.sum(F.when(F.col("taken"), F.col("cost"))), F.lit(0)).alias("used"))


def daily_quota(df: DataFrame, ts: str, seq: str, limit: int, key: str | None = None) -> DataFrame:
    """Whether a request is among the first ``limit`` of its day (and key)."""
    parts = [F.to_date(ts)] + ([F.col(key)] if key else [])
    return df.withColumn("allowed", F.row_number().over(Window.partitionBy(*parts).orderBy(ts, seq)) <= limit)
