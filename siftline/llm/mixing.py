"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order fixed by a hash.
A document's virtual start and finish are the source's words queued before and
through it, divided by the source's target. All queues are merged by virtual
finish: a global range-sort, with running totals over its ranges, that is
truncated where the total budget is spent. A document in service at virtual time
1, when every queue has had its target, is served in two parts, so that the
budget ends with the first of them. A source whose target exceeds its size is
queued again, up to the repeat limit. DataFrame functions only: running totals
are taken in two levels, so that no task holds a whole source or the whole order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
#: Sources that may travel to every executor.
SHIPPED_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) of a table of (source, source_size).

    Sources rank by code point, null last, and take the weights in turn. Each
    target is the weight's share of all words; what exceeds ``repeats`` times
    the source's size goes to the others by weight until none exceeds it. One
    row per source: this small table alone is ordered in a single task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    table = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    table = table.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    table = table.withColumn("share", left / F.sum("weight").over(rest))
    # the first source, by level, whose share of what is left fits below its cap sets the level of all after it
    table = table.withColumn("water", F.max(F.when(F.col("share") <= F.col("level"), F.col("share"))).over(whole))
    target = F.least("cap", F.coalesce(F.col("weight") * F.col("water"), F.col("cap")))
    return table.select("source", "source_size", "weight", target.alias("target"))


def _order_key(seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string")))


def _queued(docs: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """(name, id, size, copies, at) of the distinct (id, size) of each source with the words queued before the first copy; and the targets.

    ``docs`` has id, source and size. Rows alike in all three are one entry of
    the queue with several copies, so a row repeated without end is no window.
    """
    # nulls get a name of their own, so that joins are plain equalities
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    rows = docs.withColumn("name", name).groupBy("name", "source", "id", "size").agg(F.count("*").alias("copies"))
    rows = Scratch(docs.sparkSession).table(rows.withColumn("key", _order_key(seed)), "sizes")
    sizes = rows.groupBy("name").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("copies")).cast("bigint").alias("source_size"), F.count("*").alias("n"))
    table = targets(sizes.select("source", "source_size")).withColumn("name", name).join(sizes.select("name", "n"), "name")
    table = Scratch(docs.sparkSession).table(table.withColumn("budget", F.round("target").cast("bigint")), "targets")
    few = table.count() <= SHIPPED_SOURCES
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    rows = rows.drop("source").join(F.broadcast(table.select("name", "n")) if few else table.select("name", "n"), "name")
    # as many ranges as rows in a range: both grow with the root of the source
    rows = rows.withColumn("range", F.floor(spot * F.ceil(F.sqrt("n")) / F.lit(2**32)))
    words = F.col("size") * F.col("copies")
    ranges = rows.groupBy("name", "range").agg(F.sum(words).alias("range_size"))
    ahead = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("name", "range", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("name", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(ranges, ["name", "range"])
    return rows.select("name", "id", "size", "copies", (F.col("ahead") + F.col("within")).alias("at")), table


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1") -> DataFrame:
    """The mix in order: one row per document, pass and part, with ``taken`` words of it.

    Columns: id, source, size, source_size, target, turn (0 for the first
    pass), copy (repeated rows count from 0), head (false for the second part
    of a document in service at virtual time 1), start and finish (virtual
    times), before (words of the whole order ahead), taken. What the budget does
    not reach has taken 0; of it only the first pass is listed, so every document
    has a row. Null or empty texts have size 0. ``before`` gives the order. An
    empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"))
    rows, table = _queued(own, seed)
    few = table.count() <= SHIPPED_SOURCES
    rows = rows.join(F.broadcast(table) if few else table, "name")
    passes = F.greatest(F.lit(1), F.ceil(F.col("target") / F.greatest("source_size", F.lit(1)))).cast("int")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).withColumn("turn", F.explode(F.sequence(F.lit(0), passes - 1)))
    begin = F.col("at") + F.col("copy") * F.col("size") + F.col("turn") * F.col("source_size")
    head = F.greatest(F.lit(0), F.least("size", F.col("budget") - begin)).cast("bigint")
    rows = rows.withColumn("begin", begin).withColumn("fits", head)
    one = F.struct(F.lit(True).alias("head"), F.col("begin").alias("from"), F.col("fits").alias("words"))
    two = F.struct(F.lit(False).alias("head"), (F.col("begin") + F.col("fits")).alias("from"), (F.col("size") - F.col("fits")).alias("words"))
    whole = F.struct((F.col("fits") == F.col("size")).alias("head"), F.col("begin").alias("from"), F.col("size").alias("words"))
    split = (F.col("fits") > 0) & (F.col("fits") < F.col("size"))
    rows = rows.withColumn("part", F.explode(F.when(split, F.array(one, two)).otherwise(F.array(whole))))
    over = F.greatest(F.col("budget").cast("double"), F.lit(1e-9))
    rows = rows.select("id", "source", "size", "source_size", "target", "turn", "copy", "part.head", "part.words", (F.col("part.from") / over).alias("start"), ((F.col("part.from") + F.col("part.words")) / over).alias("finish"))
    order = ["finish", "start", "source", "id", "size", "turn", "copy"]
    parts = max(1, rows.sparkSession._jsparkSession.sessionState().conf().numShufflePartitions())
    ordered = scratch.table(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "order")
    sums = ordered.groupBy("range").agg(F.sum("words").alias("range_words"))
    # one row for each range of the sort
    sums = sums.select("range", F.coalesce(F.sum("range_words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ordered = ordered.withColumn("within", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(F.broadcast(sums), "range")
    total = table.agg(F.coalesce(F.sum("budget"), F.lit(0)).alias("total")).first()["total"]
    before = (F.col("ahead") + F.col("within")).cast("bigint")
    taken = F.greatest(F.lit(0), F.least("words", F.lit(total) - before)).cast("bigint")
    out = ordered.withColumn("before", before).withColumn("taken", taken).where("turn = 0 or taken > 0")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "turn", "copy", "head", "start", "finish", "before", "taken")


def digest(schedule: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of :func:`mix`, its passes and parts summed."""
    keys = [id_col, "source", "size", "source_size", "target", "copy"]
    return schedule.groupBy(*keys).agg(F.sum("taken").alias("taken")).select(id_col, "size", "source_size", "target", "taken")
