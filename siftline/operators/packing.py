"""Greedy packing of one global order into batches, without one task that holds the order.

Where a batch ends depends on where it begins, so the batches of n rows are a
chain. The order is cut into blocks by its running total; a block turns each
place where a batch may first begin in it into the first such place of the next
block. These maps are composed in pairs, then in pairs of pairs, and the begins
are read back down, so a chain of n blocks takes 2 log n joins of halving size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _cut
from .rounds import running_total

#: Least running total of a block; a block of tiny limits holds many batches.
SPAN = 1 << 20
#: The begin in a last block that only holds more rows of the batch before.
NONE = 1 << 62


def packed(df: DataFrame, order: list[Column], cost: str, limit: int, span: int = SPAN) -> DataFrame:
    """``df`` with ``batch``, from 1: a row joins the batch before it unless their costs together exceed ``limit``.

    A row dearer than ``limit`` is a batch of its own. Null and negative costs
    count as 0; rows that cost nothing join the batch that is open, or the next
    one after a row dearer than the limit. ``order`` should leave no ties. A
    block holds the rows of max(2 * limit, ``span``) of cost, each costing one
    at least.
    """
    # a dear row is alone whatever it costs, so no row reaches beyond the next block
    price = F.least(F.greatest(F.coalesce(F.col(cost).cast("bigint"), F.lit(0)), F.lit(0)), F.lit(limit + 1)).cast("bigint")
    rows = _cut(running_total(df.withColumn("_cost", price), order, "_cost", "_end").withColumn("_start", F.col("_end") - F.col("_cost")))
    wide = max(2 * (limit + 1), span)
    # free rows between two dear ones, or before a first dear one, are a batch too: the dear row after them opens two
    dear = rows.where(F.col("_cost") > limit)
    apart = dear.select(F.col("_end").alias("_start")).unionByName(df.sparkSession.range(1).select(F.col("id").alias("_start")))
    alone = dear.select("_start").join(rows.where("_cost = 0").select("_start").distinct(), "_start", "left_semi").join(apart, "_start", "left_semi").withColumn("_opens", F.lit(2).cast("bigint"))
    paid = rows.where("_cost > 0").join(alone, "_start", "left").select(F.floor(F.col("_start") / wide).cast("bigint").alias("_block"), "_start", "_cost", F.coalesce("_opens", F.lit(1).cast("bigint")).alias("_opens"))
    last = paid.agg(F.max("_block")).first()[0]
    if last is None:
        return rows.withColumn("batch", F.lit(1).cast("bigint")).select(*df.columns, "batch")
    # a block also sees the rows in which a batch that leaves it can end
    beyond = paid.where((F.col("_start") - F.col("_block") * wide <= limit + 1) & (F.col("_block") > 0)).withColumn("_block", F.col("_block") - 1)
    blocks = _cut(paid.unionByName(beyond))
    hops = _cut(blocks.groupBy("_block").applyInArrow(_hops(limit, wide, last), "_block bigint, entry bigint, exit bigint, n bigint"))
    begins = _begins(hops, last)
    starts = blocks.join(begins, "_block").groupBy("_block").applyInArrow(_walk(limit, wide), "_start bigint, batch bigint")
    paying = rows.where("_cost > 0").join(starts, "_start")
    ends = paying.select(F.col("_end").alias("_start"), (F.col("batch") + (F.col("_cost") > limit).cast("int")).alias("batch"))
    # rows before all costs need no join, however many they are
    free = rows.where("_cost = 0 and _start > 0").join(ends, "_start")
    first = rows.where("_cost = 0 and _start = 0").withColumn("batch", F.lit(1).cast("bigint"))
    names = [*df.columns, "batch"]
    return paying.select(*names).unionByName(free.select(*names)).unionByName(first.select(*names))


def _begins(hops: DataFrame, last: int) -> DataFrame:
    """(_block, entry, n): where the first batch of a block begins, and the batches begun before it."""
    levels = []
    step, table = 1, hops
    while step <= last:
        levels.append((step, table))
        left = table.where(F.col("_block") % (2 * step) == 0)
        right = table.where(F.col("_block") % (2 * step) == step).select((F.col("_block") - step).alias("_block"), F.col("entry").alias("exit"), F.col("exit").alias("_to"), F.col("n").alias("_n"))
        step *= 2
        if step <= last:
            table = _cut(left.join(right, ["_block", "exit"]).select("_block", "entry", F.col("_to").alias("exit"), (F.col("n") + F.col("_n")).alias("n")))
    known = hops.where("_block = 0 and entry = 0").select("_block", "entry", F.lit(0).cast("bigint").alias("n"))
    for step, table in reversed(levels):
        hop = table.where(F.col("_block") % (2 * step) == 0).select("_block", "entry", "exit", F.col("n").alias("_n"))
        more = known.join(hop, ["_block", "entry"]).where(F.col("_block") + step <= last).select((F.col("_block") + step).alias("_block"), F.col("exit").alias("entry"), (F.col("n") + F.col("_n")).alias("n"))
        known = _cut(known.unionByName(more))
    return known


def _next(start: np.ndarray, cost: np.ndarray, limit: int) -> np.ndarray:
    """Index of the row that begins the batch after the one that each row would begin."""
    fits = np.searchsorted(start + cost, start + limit, side="right")
    return np.maximum(fits, np.arange(len(start)) + 1)


def _arrays(block: pa.Table) -> list[np.ndarray]:
    order = np.argsort(block["_start"].to_numpy())
    return [block[c].to_numpy()[order] for c in ("_start", "_cost", "_opens")]


def _hops(limit: int, wide: int, last: int):
    def run(block: pa.Table) -> pa.Table:
        number = block["_block"][0].as_py()
        start, cost, opens = _arrays(block)
        inside = int(np.searchsorted(start, (number + 1) * wide))
        after = _next(start, cost, limit)
        leaves, count = after.copy(), opens.copy()
        for i in range(inside - 1, -1, -1):
            if after[i] < inside:
                leaves[i], count[i] = leaves[after[i]], opens[i] + count[after[i]]
        entries = int(np.searchsorted(start[:inside], number * wide + limit + 1, side="right"))
        columns = [np.full(entries, number), start[:entries], np.append(start, NONE)[leaves[:entries]], count[:entries]]
        if number == last:
            columns = [np.append(c, v) for c, v in zip(columns, (number, NONE, NONE, 0))]
        return pa.table(dict(zip(("_block", "entry", "exit", "n"), columns)))

    return run


def _walk(limit: int, wide: int):
    def run(block: pa.Table) -> pa.Table:
        number, entry, n = (block[c][0].as_py() for c in ("_block", "entry", "n"))
        start, cost, opens = _arrays(block)
        inside = int(np.searchsorted(start, (number + 1) * wide))
        after, begin = _next(start, cost, limit), np.zeros(inside, np.int64)
        at = int(np.searchsorted(start, entry))
        while at < inside:
            begin[at] = opens[at]
            at = int(after[at])
        # rows before the entry belong to the last batch of the blocks before
        return pa.table({"_start": pa.array(start[:inside]), "batch": pa.array(n + np.cumsum(begin))})

    return run
