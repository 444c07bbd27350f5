import pytest
from pyspark.sql import functions as F

from siftline.operators import dedup, rounds


@pytest.mark.parametrize("group", [None, "g"])
def test_numbers_equal_a_plain_count(spark, group):
    rows = [(i * 37 % 101, "hot" if i % 3 else None if i % 5 else f"k{i}") for i in range(101)]
    df = spark.createDataFrame(rows, "v int, g string").repartition(7)
    out = rounds.numbered(df, [F.desc("v")], group).collect()
    want = {}
    for v, g in sorted(rows, reverse=True, key=lambda r: r[0]):
        seen = [r for r in want if group is None or r[1] == g]
        want[(v, g)] = len(seen) + 1
    assert {(r.v, r.g): r.n for r in out} == want
    assert rounds.numbered(df.limit(0), [F.desc("v")], group).count() == 0


def test_a_limit_that_passes_large_rules_gives_the_same_rows(spark, monkeypatch):
    rows = [(i, f"r{i % 3}", f"f{i % 4}") for i in range(300)]
    df = spark.createDataFrame(rows, "input_seq long, rule_id string, file string").repartition(5)
    few = sorted(map(tuple, dedup.apply_budget(df, 40, 5, 100).collect()))
    monkeypatch.setattr(dedup, "WINDOW_LIMIT", 1)
    assert sorted(map(tuple, dedup.apply_budget(df, 40, 5, 100).collect())) == few and len(few) == 20
