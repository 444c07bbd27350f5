import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import detectors, intel, phrases


def plain(texts, names):
    return sorted((k, n) for k, t in texts for n in set(names) if n and t is not None and n in t)


@pytest.mark.parametrize("slices", [1 << 18, 40])
def test_all_phrases_are_found_in_all_texts(spark, slices, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", slices)
    monkeypatch.setattr(phrases, "LANES", 3)
    monkeypatch.setattr(phrases, "HEAD", 6)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé你 ") for _ in range(n))
    names = [word(rng.randint(1, 5)) for _ in range(60)] + ["abaab" * 3, "abaababaabx", "a", "aa", "aaa", "", None] + ["aa"] * 3
    texts = [(i, word(rng.randint(0, 200))) for i in range(80)] + [(900, None), (901, ""), (5, "aaaa"), (902, "abaab" * 40), (903, "b" * 5000 + "abaab" * 3)]
    library = phrases.numbered(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    rows = spark.createDataFrame(texts, "id long, body string").repartition(3)
    found = phrases.holders(rows, library, "id", "body", "name").join(library, "phrase_id").select("id", "name").collect()
    assert sorted(map(tuple, found)) == plain(texts, names)
    assert phrases.holders(rows, library.limit(0), "id", "body", "name").count() == 0
    assert phrases.holders(rows.limit(0), library, "id", "body", "name").count() == 0


def test_automaton_reads_lanes_without_losing_matches():
    names = [b"he", b"she", b"his", b"hers", b"ers", b"s" * 200]
    found = phrases.Automaton(names)
    texts = [b"ushers", b"", b"his hershey" * 3000, b"s" * 300, b"x" * 50_000 + b"she"]
    text, phrase = found.search(texts)
    assert sorted(zip(text.tolist(), phrase.tolist())) == sorted((i, k) for i, t in enumerate(texts) for k, n in enumerate(names) if n in t)


def test_text_joins_keep_repeated_rows_and_patterns(spark):
    texts = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "two"), (3, None)], "id long, text string")
    patterns = spark.createDataFrame([(7, "two"), (8, "two"), (9, "one two"), (10, "")], "item long, needle string")
    out = detectors.text_joins(texts, patterns, "id").select("id", "item").collect()
    assert sorted(map(tuple, out)) == [(1, 7), (1, 7), (1, 8), (1, 8), (1, 9), (1, 9), (2, 7), (2, 8)]


def test_names_do_not_cross_products(spark):
    cves = spark.createDataFrame([(1, "Spring MVC", ["Core", "Web kit"], [], False), (2, "x", ["spring"], [">=1.0.0,<2.0.0"], True), (3, "x", ["spring-web"], [], True)], "cve_id long, description string, products array<string>, ranges array<string>, from_advisory boolean")
    deps = spark.createDataFrame([(1, "pip", "mvc core", None), (2, "maven", "g:Spring", "1.5.0"), (3, "go", "h.org/web", "9.0.0"), (4, "pip", "", None), (5, "maven", "g:spring", "3.0.0")], "input_seq long, ecosystem string, name string, version string")
    assert sorted(map(tuple, intel.relevant(deps, cves).collect())) == [(2, 1), (2, 2), (3, 1), (5, 1)]
    names = spark.createDataFrame([("SPRING",), ("Kit",), ("core web",)], "name string")
    assert sorted(map(tuple, intel.framework_cves(names, cves).select("framework", F.col("cve_id")).collect())) == [("Kit", 1), ("SPRING", 1), ("SPRING", 2), ("SPRING", 3)]
