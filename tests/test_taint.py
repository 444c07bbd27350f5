import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import graph


def by_closure(edges, entries, sinks, guards, depth):
    """One breadth-first search backwards from each sink."""
    back = {}
    for a, b in edges:
        back.setdefault(b, set()).add(a)
    out = {}
    for sink in sinks:
        dist, level = {sink: 0}, [sink]
        for d in range(1, depth + 1):
            level = sorted({p for n in level for p in back.get(n, ())} - set(dist))
            dist |= dict.fromkeys(level, d)
        hit = min(((d, n) for n, d in dist.items() if n in entries), default=None)
        guarded = hit is not None and any(n in guards and d < hit[0] for n, d in dist.items())
        out[sink] = (hit and hit[1], hit and hit[0], guarded)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_equal_a_search_from_each_sink(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(110)]
    entries, guards, sinks = {n for n in range(60) if n % 9 == seed}, {n for n in range(60) if n % 7 == 3}, [n for n in range(60) if n % 4 == 0] + [99]
    out = graph.taint(
        spark.createDataFrame(edges, "src long, dst long"),
        spark.createDataFrame([(n, k) for n in entries for k in ("rpc", "http")], "node long, kind string"),
        spark.createDataFrame([(n,) for n in sinks + sinks], "sink long"),
        spark.createDataFrame([(n, 0.6) for n in guards] + [(n, 0.5) for n in range(60)], "node long, confidence double"),
        4,
    )
    assert {r.sink: (r.entry, r.path_length, r.sanitized) for r in out.collect()} == by_closure(edges, entries, sinks, guards, 4)


def test_labels_hold_a_row_per_node_and_end_early(spark):
    edges = spark.range(200).select((F.col("id") % 50).alias("src"), ((F.col("id") * 7 + 1) % 50).alias("dst"))
    seeds = spark.range(40).select(F.lit("a").alias("label"), F.col("id").alias("seed"))
    out = graph.labels(edges, seeds, 1000)
    assert out.count() == out.select("node").distinct().count() <= 50
    assert graph.labels(edges, seeds.limit(0), 5).count() == 0
