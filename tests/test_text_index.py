import random
import re

import pytest

from siftline.operators import text_index


def plain(docs, query):
    words = set(query.lower().split())
    count = lambda t: [re.split(r"[\W_]+", (t or "").lower()).count(w) for w in words]
    hits = {k: sum(c) for k, t in docs.items() if all(c := count(t)) and words}
    return hits or {k: 0 for k, t in docs.items() if t is not None and query.lower() in t.lower()}


@pytest.mark.parametrize("chunk", [1 << 14, 5])
def test_searches_equal_a_scan_after_updates(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(text_index, "CHUNK", chunk)
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["Alpha", "beta,", "gamma-delta", "été", "x1", "zeta"]) for _ in range(rng.randint(0, 8)))
    index = text_index.TextIndex(spark, str(tmp_path / "index"), "id", "body", buckets=4)
    assert index.holders("alpha").count() == 0
    docs = {}
    for number in range(3):
        batch = {rng.randrange(-5, 60): text() for _ in range(25)} | {200 + number: None}
        docs |= batch
        for _ in range(1 + (number == 1)):
            index.add(spark.createDataFrame(list(batch.items()), "id long, body string"), number)
        for query in ("alpha", "beta GAMMA", "été x1 zeta", "alpha nowhere", "amma-d", "-", "x1 x1"):
            assert {r.id: r.score for r in index.search(query).collect()} == plain(docs, query), query


def test_a_search_reads_only_the_folders_of_its_terms(spark, tmp_path):
    index = text_index.TextIndex(spark, str(tmp_path / "index"), "id", "body", buckets=16)
    index.add(spark.createDataFrame([(k, f"word{k} common") for k in range(100)], "id long, body string"), 0)
    read = {f.split("_bucket=")[1].split("/")[0] for f in index._postings(["word7"]).inputFiles()}
    plan = index._postings(["word7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters:")[1].split("]")[0] and len(read) > 1


def test_a_chunk_is_read_without_a_fold_over_its_ids(spark, tmp_path):
    index = text_index.TextIndex(spark, str(tmp_path / "index"), "id", "body", buckets=2)
    index.add(spark.range(12_000).selectExpr("id * 3 as id", "'alpha beta' as body"), 0)
    found = index.holders("alpha beta")
    assert "aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().replace("Aggregate", "")
    assert found.agg({"id": "sum", "score": "sum"}).first().asDict() == {"sum(id)": 3 * 11_999 * 6_000, "sum(score)": 24_000}
