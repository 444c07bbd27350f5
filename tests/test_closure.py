import random

from pyspark.sql import functions as F

from siftline.operators import graph as gr
from siftline.plans import source_queries, table_queries


def brute(edges, seeds, depth):
    out = {}
    for seed in seeds:
        level = {seed}
        for k in range(depth + 1):
            for node in level:
                out.setdefault((seed, node), k)
            level = {d for s, d in edges if s in level}
    return out


def test_blocks_of_seeds_meet_every_node_at_its_least_depth(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(420)]
    seeds = [f"n{k}" for k in range(150)]
    found = gr.closure(spark.createDataFrame(edges * 2, "src string, dst string"), spark.createDataFrame([(s,) for s in seeds * 2], "seed string"), 4).collect()
    assert len(found) == len({(r.seed, r.node) for r in found})
    assert {(r.seed, r.node): r.depth for r in found} == brute(edges, seeds, 4)


def test_edges_are_computed_once_and_are_one_row_for_many_seeds(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    widths, cut = [], gr._cut
    monkeypatch.setattr(gr, "_cut", lambda df: widths.append((df.columns, (out := cut(df)).count())) or out)
    edges = spark.range(60).select(F.col("id").alias("src")).crossJoin(spark.range(60).select(F.col("id").alias("dst"))).where("src <> dst").select(counted("src").alias("src"), "dst")
    seeds = spark.range(60).select(F.col("id").alias("seed"))
    assert gr.closure(edges, seeds, 3).count() == 3600
    assert seen.value <= 3600
    assert max(n for columns, n in widths if "mask" in columns) <= 60
    seen.value = 0
    assert gr.nearest(edges, seeds.where("seed = 1"), 3).count() == 60
    assert seen.value <= 3600


def test_hundreds_of_seeds_share_a_row_and_only_wanted_nodes_are_kept(spark, monkeypatch):
    widths, cut = [], gr._cut
    monkeypatch.setattr(gr, "_cut", lambda df: widths.append((df.columns, (out := cut(df)).count())) or out)
    n = 200
    ends = spark.range(n).select(F.col("id").alias("src")).crossJoin(spark.range(n).select(F.col("id").alias("dst"))).where("src <> dst")
    found = gr.closure(ends, spark.range(n).select(F.col("id").alias("seed")), 2, F.col("node") % 10 == 4).collect()
    assert sorted((r.seed, r.node, r.depth) for r in found) == [(s, k, int(s != k)) for s in range(n) for k in range(4, n, 10)]
    assert max(rows for columns, rows in widths if "mask" in columns) <= n


def test_more_seeds_than_a_row_holds(spark):
    rng = random.Random(6)
    n = 2 * gr.SEEDS + 100
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)]
    found = gr.closure(spark.createDataFrame(edges, "src bigint, dst bigint"), spark.range(n).select(F.col("id").cast("int").alias("seed")), 2)
    assert dict(found.dtypes)["seed"] == "int"
    rows = found.collect()
    assert len(rows) == len({(r.seed, r.node) for r in rows})
    assert {(r.seed, r.node): r.depth for r in rows} == brute(edges, range(n), 2)


def test_queries_compute_their_edges_once_for_seeds_and_search(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    edges = spark.range(600).select((F.col("id") % 60).alias("src"), counted(F.col("id") * 7 % 60).alias("dst"))
    monkeypatch.setattr(table_queries, "view", lambda *_: edges)
    for part, name in ((table_queries, "grf7_backward_closure"), (table_queries, "grf6_grf12_forward_closure"), (source_queries, "grf16_critical_paths")):
        seen.value = 0
        assert part.QUERIES[name](spark, "").count() > 0
        assert seen.value <= 600
