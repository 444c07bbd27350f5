"""Versions in ranges by bins against every pair compared, and rows without a meaning."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions.versions import in_range, version_key, version_place
from siftline.operators.intel import exposure, versions_in_ranges, vulnerable

V = "ecosystem string, name string, version string"
R = "ecosystem string, name string, spec string"


def plain(versions, ranges):
    both = versions.distinct().join(ranges.distinct(), ["ecosystem", "name"])
    return sorted(map(tuple, both.where(in_range(F.col("version"), F.col("spec"))).select("ecosystem", "name", "version", "spec").collect()))


@pytest.mark.parametrize("span", [3, 60, 2_000_000_000])
def test_bins_give_what_all_pairs_give(spark, span):
    draw = random.Random(span)
    number = lambda: f"{draw.randrange(span)}.{draw.randrange(4)}.{draw.randrange(span)}"
    versions = [("npm", draw.choice("ab"), draw.choice(["v", ""]) + number()) for _ in range(1500)]
    forms = [lambda: f">={number()}", lambda: f">{number()},<={number()}", lambda: f"<{number()}", lambda: f"={number()}", number]
    ranges = [("npm", draw.choice("ab"), draw.choice(forms)()) for _ in range(120)] + [("npm", "a", f"={v[2].lstrip('v')}") for v in versions[:40]]
    left, right = spark.createDataFrame(versions, V), spark.createDataFrame(ranges, R)
    found = sorted(map(tuple, versions_in_ranges(left, right).collect()))
    assert found == plain(left, right)
    assert len(found) == len(set(found)) > 40


def test_unparsed_and_missing_values_meet_nothing(spark):
    deps = spark.createDataFrame([(1, "npm", "a", "1.2.3"), (1, "npm", "a", "1.2.3"), (2, "npm", "a", None), (3, "npm", "a", "x.y"), (4, None, "a", "1.2.3"), (5, "npm", "a", "*")], "input_seq int, " + V)
    advisories = spark.createDataFrame([(7, "npm", "a", ">=1.0.0"), (8, "npm", "a", None), (9, "npm", "a", "any"), (10, None, "a", ">=1.0.0"), (11, "npm", "a", ">=2.0.0,<1.0.0"), (12, "npm", "a", "<=0.0")], "cve_id int, " + R)
    assert sorted(map(tuple, vulnerable(deps, advisories).collect())) == [(1, 7), (1, 7), (5, 12)]
    assert vulnerable(deps.limit(0), advisories).count() == 0
    assert vulnerable(deps, advisories.limit(0)).count() == 0


def test_place_never_falls(spark):
    draw = random.Random(5)
    part = lambda: draw.choice([0, 1, 2, 2**31 - 1, draw.randrange(2**31)])
    rows = sorted(tuple(part() for _ in range(4)) for _ in range(3000))
    texts = spark.createDataFrame([(i, ".".join(map(str, r))) for i, r in enumerate(rows)], "i int, v string")
    places = [r.p for r in texts.select("i", version_place(version_key(F.col("v"))).alias("p")).orderBy("i").collect()]
    assert places == sorted(places)


def test_dependencies_of_one_version_are_counted_before_they_meet_advisories(spark):
    deps = spark.createDataFrame([(k, "pip" if k % 3 else None, "core", f"v{k % 7}.{k % 2}") for k in range(400)], "input_seq long, ecosystem string, name string, version string")
    advisories = spark.createDataFrame([(k, "pip", "core", f">={k % 5}.0,<{k % 5 + 2}.1") for k in range(40)] + [(1, "pip", "core", ">=0.1"), (1, "pip", "core", ">=0.1")], "cve_id long, ecosystem string, name string, spec string")
    rows = vulnerable(deps, advisories)
    met = rows.join(deps.select("input_seq", "ecosystem", "name"), "input_seq").groupBy("ecosystem", "name", "cve_id").agg(F.count("*").alias("versions"), F.min("input_seq").alias("first"))
    assert sorted(exposure(deps, advisories).collect()) == sorted(met.collect())
