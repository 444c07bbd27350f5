import random

import duckdb
import numpy as np
import pytest

from siftline.llm import components as components_of
from siftline.llm import embed_dedup, order_minhash
from siftline.llm.components import connected_components

from . import brute


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("finish", [0, 20, 100_000])
def test_components_of_chains_and_stars(spark, finish, monkeypatch):
    monkeypatch.setattr(components_of, "FINISH", finish)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[k] for k in range(61)}) == 1 and len({got[k] for k in range(100, 160)}) == 1 and len(set(got.values())) == 2
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    docs = {}
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 400]))]
        docs[len(docs)] = " ".join(base)
        for edits in (0, 1, 2, 4, 9):
            copy = list(base)
            for _ in range(edits * len(base) // 200 + (edits > 0)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if edits == 4:
                copy = copy + [rng.choice(words) for _ in range(len(copy) // 10)]
            if edits == 9:
                copy = copy[len(copy) // 2 :] + copy[: len(copy) // 2]
            docs[len(docs)] = " ".join(copy)
    docs |= {1000: None, 1001: "", 1002: " ... ", 1003: "a b", 1004: "A, b!", 1005: "x " * 5000, 1006: "x " * 5000}
    return docs


def test_near_duplicates_equal_brute_force(spark):
    docs = _corpus()
    rows = [(i, t, "extra") for i, t in docs.items()]
    out = {r.doc_id: r for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()}
    grams = {i: brute.kmers(t) for i, t in docs.items()}
    links = []
    for a in grams:
        for b in grams:
            if a < b and grams[a] and grams[b] and len(set(grams[a]) & set(grams[b])) >= 0.8 / 1.8 * (len(grams[a]) + len(grams[b])):
                if len(grams[a]) < 2000 and brute.aligned(grams[a], grams[b]) >= 0.8 or grams[a] == grams[b]:
                    links.append((a, b))
    want = components(list(docs), links)
    assert {i: r.class_id for i, r in out.items()} == want
    assert all(r.kept == (r.class_id == i) for i, r in out.items())
    assert len(links) > 60 and out[1003].class_size == 2


def test_a_bucket_of_several_groups_keeps_all_links(spark):
    rng = random.Random(9)
    base = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    docs = {}
    for k in range(120):
        copy = list(base)
        for j in rng.sample(range(0, 200, 10), 3):
            copy[j] = f"z{rng.randrange(10**6)}"
        docs[k] = " ".join(copy)
    grams = {i: brute.kmers(t) for i, t in docs.items()}
    links = [(a, b) for a in docs for b in docs if a < b and len(set(grams[a]) & set(grams[b])) >= 0.8 / 1.8 * (len(grams[a]) + len(grams[b])) and brute.aligned(grams[a], grams[b]) >= 0.8]
    out = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert out == components(list(docs), links)


def test_near_duplicates_of_ties_and_nothing(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (None, None), (2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((str(r.doc_id), str(r.class_id), r.kept) for r in order_minhash.near_duplicates(df).collect())
    assert sorted(out) == sorted([("1", "1", True), ("1", "1", False), ("2", "2", True), ("None", "1", False), ("None", "None", True)])
    assert order_minhash.near_duplicates(df.limit(0)).count() == 0
    mixed = spark.createDataFrame([(3, "aa bb cc dd ee ff"), (5, "AA bb cc dd ee ff"), (5, "gg hh ii jj kk ll mm"), (None, "aa bb cc dd ee ff")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:2]) for r in order_minhash.keep_one(mixed).collect()) == [(3, "aa"), (5, "gg")]
    same = spark.createDataFrame([(None, "aa bb cc dd ee ff", 1)] * 3 + [(None, "AA bb cc dd ee ff", 2), (7, "", 1), (7, "", 1), (8, "gg hh ii jj kk ll", 4), (8, "gg hh ii jj kk ll", 5)], "doc_id long, text string, kept int")
    left = order_minhash.keep_one(same)
    assert left.columns == same.columns
    assert sorted((str(r.doc_id), r.text.lower()) for r in left.collect()) == [("7", ""), ("7", ""), ("8", "gg hh ii jj kk ll"), ("None", "aa bb cc dd ee ff")]
    assert order_minhash.keep_one(same.limit(0)).count() == 0


def test_short_texts_a_word_apart_are_found(spark):
    rng = random.Random(3)
    docs = {}
    for k in range(150):
        words = [f"s{rng.randrange(10**6)}" for _ in range(8 + k % 4)]
        docs[2 * k], docs[2 * k + 1] = " ".join(words), " ".join([*words, "more"] if k % 2 else ["more", *words])
    out = order_minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert all(r.class_size == 2 and r.class_id == r.doc_id // 2 * 2 for r in out)


def test_the_band_follows_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**60, 60).astype(np.uint64)
    b = np.concatenate((rng.integers(0, 2**60, 50).astype(np.uint64), a))
    assert order_minhash.aligned_similarity(a, b, 0.5) == pytest.approx(60 / 110)


@pytest.mark.parametrize("block", [4096, 64])
def test_vectors_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "LEAF", 32)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + rng.normal(scale=0.15, size=(30, 16)), base[:30] + rng.normal(scale=0.3, size=(30, 16)), np.repeat(base[:1], 200, axis=0), base[5:6] * 3])
    rows = [(k, [float(v) for v in r], 1) for k, r in enumerate(x.astype(np.float32))]
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [None] + [1.0] * 15, 1), (9005, [float("inf")] * 16, 1), (None, rows[0][1], 1), (9006, [1.0, 2.0], 1), (9007, [1.0, 2.0], 1), (9008, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, node long").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect() if r.vec_id is not None}
    v = x.astype(np.float32).astype(np.float64)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = unit @ unit.T >= 0.9
    np.fill_diagonal(sim, False)
    comp = components(range(len(x)), [tuple(p) for p in np.argwhere(sim).tolist()])
    for k in range(len(x)):
        assert got[k] == (int(sim[k].sum()), comp[k], comp[k] == k)
    for k in (9001, 9002, 9003, 9004, 9005, 9008):
        assert got[k] == (0, k, True)
    assert got[9006] == (1, 9006, True) and got[9007] == (1, 9006, False)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_distant_intervals_are_skipped():
    x = np.concatenate([np.tile([1.0, 0.0], (600, 1)), np.tile([0.0, 1.0], (600, 1))])
    v = embed_dedup.Vectors(x, x)
    leaves = list(embed_dedup.join_intervals(v, v, True, 0.9))
    assert sum(l.sum() for _, _, l in leaves) == 2 * (600 * 599 // 2)
    assert all((r.start < 600) == (c.start < 600) for r, c, _ in leaves if r.stop <= 512 or r.start >= 1024)


def test_vectors_at_the_threshold_itself_link(spark):
    # cosine 9/10 exactly; then a little below and above
    rows, want = [], {}
    for k in range(21):
        scale = 3.0 ** (k % 5)
        one, two = [0.0] * 40, [0.0] * 40
        one[k] = scale
        two[k] = 9.0
        for j in [i for i in range(40) if i != k][:19]:
            two[j] = 1.0
        two[k] += (0, -1e-6, 1e-6)[k % 3]
        rows += [(2 * k, one), (2 * k + 1, two)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    con = duckdb.connect()
    con.execute("create table v (i bigint, e double[])")
    con.executemany("insert into v values (?, ?)", rows)
    want = {i: 0 for i, _ in rows} | dict(con.sql("select a.i, count(*) from v a join v b on a.i <> b.i and list_cosine_similarity(a.e, b.e) >= 0.9e0 group by 1").fetchall())
    assert got == want
    assert all(got[2 * k] == (k % 3 != 1) for k in range(21))


def test_a_dense_corpus_deals_every_block_alike(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = 1 + rng.normal(scale=0.01, size=(16 * 40, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = embed_dedup.near_duplicates(df).collect()
    assert all(r.n_links == len(x) - 1 and r.component_id == 0 for r in out)
