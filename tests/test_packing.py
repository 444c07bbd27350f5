"""Packed batches against a plain loop, over blocks of many and few batches."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.operators.packing import packed


def plain(costs, limit):
    out, batch, used, open_ = [], 1, 0, False
    for c in costs:
        c = max(c or 0, 0)
        if open_ and used + c > limit:
            batch, used = batch + 1, 0
        out.append(batch)
        used, open_ = used + c, True
    return out


def batches(spark, costs, limit, span):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(costs)], "id int, cost int")
    return [r.batch for r in packed(df, [F.col("id")], "cost", limit, span).orderBy("id").collect()]


@pytest.mark.parametrize("limit, span", [(10, 1), (40, 200), (7, 1 << 20)])
def test_batches_are_those_of_a_loop(spark, limit, span):
    draw = random.Random(limit)
    costs = [0, None, 0] + [draw.choice([0, 0, 1, 2, 5, limit, limit + 1, 3 * limit, None, -4]) for _ in range(700)] + [0, 0]
    assert batches(spark, costs, limit, span) == plain(costs, limit)


def test_rows_without_cost_and_no_rows(spark):
    assert batches(spark, [0, None, 0], 5, 1) == [1, 1, 1]
    assert batches(spark, [], 5, 1) == []
    assert batches(spark, [99], 5, 1) == [1]
    assert batches(spark, [99, 0, 0, 3, 99, 0], 5, 1) == plain([99, 0, 0, 3, 99, 0], 5)
