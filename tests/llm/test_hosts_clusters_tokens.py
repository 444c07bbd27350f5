"""Host quality, ball-tree clusters and token alignment against plain versions."""

import bisect
import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
import sentencepiece
import tokenizers

from siftline.llm import ball_tree, host_quality, queries, token_align

FOLDER = "/root/testdata/sf0.001"


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


ODD = [
    None,
    "",
    " \n\t ",
    "a b",
    "a a a a a",
    "x y z x y z",
    "one\none\n one\n\n\n#*$%&|<>",
    "\U0001f600é     b\x0bc\x0cd\r\ne",
    "lorem ipsum dolor " * 40,
    " ".join(f"w{i}" for i in range(60)),
    " ".join(f"w{i % 700}" for i in range(30_000)),
    "\n".join(["same line here"] * 500),
    "q" * 200_000,
]


def test_measures_equal_plain_ones(spark):
    docs = spark.createDataFrame([(i, t, "h", 5) for i, t in enumerate(ODD)], "doc_id long, text string, source string, n_words int")
    out = host_quality.measure(docs).collect()
    assert {r.doc_id: tuple(r[m] for m in host_quality.MEASURES) for r in out} == {i: measures(t) for i, t in enumerate(ODD)}


def test_hosts_shrink_and_reject(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), "too short"
    rows = [(k, good if k % 10 else bad, "fine", 1) for k in range(200)] + [(1000 + k, bad if k % 5 > 1 else good, "spam", 1) for k in range(200)]
    rows += [(2000 + k, bad, f"small{k}", 1) for k in range(3)] + [(None, good, None, 1), (None, good, None, 1), (3000, good, "spam", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")
    out = host_quality.judge(docs)
    assert out.count() == len(rows)
    by = collections.defaultdict(list)
    for r in out.collect():
        by[r.doc_id].append(r)
    assert by[3000][0].host_rule == "short" and not by[3000][0].kept and not by[3000][0].base_failed
    assert by[1][0].kept and by[0][0].base_failed and not by[0][0].kept
    assert [r.kept for r in by[None]] == [True, True]
    rates = {r.host: r for r in host_quality.host_rates(host_quality.measure(docs.withColumnRenamed("source", "host")), "host")[0].collect()}
    k, n, f = len(rates), len(rows), sum(measures(r[1])[0] < 50 for r in rows)
    count = collections.Counter(r[2] for r in rows)
    fails = collections.Counter(r[2] for r in rows if measures(r[1])[0] < 50)
    mean = f / n
    over = mean * (1 - mean) * (n - sum(c * c for c in count.values()) / n - (k - 1))
    rho = (sum(fails[h] ** 2 / c for h, c in count.items()) - n * mean**2 - mean * (1 - mean) * (k - 1)) / over
    m = (1 - rho) / rho
    for h, c in count.items():
        assert rates[h].rate_short == pytest.approx((fails[h] + mean * m) / (c + m))
    assert rates["small0"].rate_short < 1.0
    assert host_quality.judge(docs.limit(0)).count() == 0


def test_many_hosts_join_by_key(spark, monkeypatch):
    monkeypatch.setattr(host_quality, "SHIPPED_HOSTS", 3)
    rows = [(k, "word " * 60 if k % 2 else "no", f"h{k % 7}" if k % 3 else "hot") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = sorted(map(tuple, host_quality.judge(docs).collect()))
    monkeypatch.undo()
    assert few == sorted(map(tuple, host_quality.judge(docs).collect()))


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    text = lambda i: "" if i is None else str(i)
    at = [c for _, c in sorted(((hashlib.sha256(f"1:{text(i)}".encode()).hexdigest(), c) for i, c in kept))[:k]]

    def nearest(c):
        return min((sum((a - b) ** 2 for a, b in zip(c, z)), j) for j, z in enumerate(at))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, c in kept:
            groups[nearest(c)[1]].append(c)
        at = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if groups[j] else z for j, z in enumerate(at)]
    found = [(i, *reversed(nearest(c))) for i, c in kept]
    inertia = collections.Counter()
    for _, j, d in found:
        inertia[j] += d
    return sorted((text(i), j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, j, d in found)


@pytest.mark.parametrize("kind", ["table", "copies", "few", "ties"])
def test_clusters_equal_plain_ones(spark, kind):
    schema = "vec_id long, embedding array<float>, cluster int"
    rng = np.random.default_rng(3)
    if kind == "table":
        df = spark.read.parquet(f"{FOLDER}/embeddings.parquet").repartition(3)
    else:
        centers = rng.normal(size=(5, 64))
        rows = [(i, [float(np.float32(x)) for x in centers[i % 5] + 0.01 * rng.normal(size=64)], 0) for i in range(120)]
        if kind == "copies":
            rows += [(7, rows[7][1], 0)] * 300 + [(None, rows[3][1], 0), (500, None, 0), (501, [1.0] * 63, 0), (502, [float("nan")] + [0.0] * 63, 0), (503, [None] + [0.0] * 63, 0), (504, [0.0] * 64, 0), (505, [float("inf")] * 64, 0)]
        if kind == "few":
            rows = rows[:5]
        if kind == "ties":
            rows = [(i, [float(i % 2 - 0.5)] * 64, 0) for i in range(90)]
        df = spark.createDataFrame(rows, schema).repartition(2)
    out = ball_tree.cluster(df)
    want = plain_clusters([(r.vec_id, r.embedding) for r in df.collect()])
    assert sorted(("" if r[0] is None else str(r[0]), *r[1:]) for r in map(tuple, out.collect())) == want


def test_whole_balls_are_assigned_and_nothing_kept_gives_nothing(spark):
    rng = np.random.default_rng(1)
    centers = rng.integers(-500, 500, (4, 64))
    rows = (centers[rng.integers(0, 4, 2000)] + rng.integers(-3, 4, (2000, 64))).astype(np.int64)
    order, tree = ball_tree.build(rows)
    assert sorted(order) == list(range(2000)) and (tree.rows == rows[order]).all()
    for b, (begin, end, _, _) in enumerate(tree.links):
        assert (tree.sums[b] == tree.rows[begin:end].sum(0)).all()
    balls, owners, lone, nearest = ball_tree.walk(tree, centers)
    assert len(lone) == 0 and tree.counts[balls].sum() == 2000
    assert ball_tree.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert ball_tree.cluster(spark.createDataFrame([(1, [2.0])], "vec_id long, embedding array<float>")).collect() == []


TEXTS = [
    None,
    "",
    " ",
    "   lead and  two   three\n\nlines\n one\tTab\r\nend  ",
    "<|endoftext|> and <s> </s> <unk> <0x0A> plain",
    "a ▁ b",
    "café  x y \x1c z \U0001f600\U0001f600 你好世界 مرحبا",
    "don't we'll I'm 12345 3.14 $%^&* ,. (x) [y]\nnew\nline",
    "\nstart",
    "é Å ﬁ Ａ ​ zero​width ﻿ bom",
    "\x00nul \x7f del \x85nel\x85 x",
    "the the the the",
    "z" * 3000,
    "word " * 5000 + "\n" + "ab cd\n" * 3000,
    " \n \n x \n y",
    "tail\n",
    " " * 3000 + "x" + "\n" * 2000 + "y",
]


def whole_text(texts):
    byte_json = open(f"{token_align.FOLDER}/{token_align.BYTE_FILE}").read()
    a = tokenizers.Tokenizer.from_str(byte_json)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{token_align.FOLDER}/{token_align.PIECE_FILE}")
    own = token_align.Tokenizers(byte_json, open(f"{token_align.FOLDER}/{token_align.PIECE_FILE}", "rb").read())
    rows, held = [], collections.Counter()
    for text in texts:
        links, groups, x, y = collections.Counter(), [], [], []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bx, by = [own.bytes_a[t] for t in x], [own.bytes_b[t] for t in y]
            if b"".join(bx) != (" " + text).encode() or b"".join(by) != (" " + text).encode():
                x, y = [], []
        if x:
            ex, ey = np.cumsum([len(t) for t in bx]).tolist(), np.cumsum([len(t) for t in by]).tolist()
            i = j = 0
            for cut in sorted(set(ex) & set(ey)):
                i_end, j_end = bisect.bisect_right(ex, cut), bisect.bisect_right(ey, cut)
                groups.append((x[i:i_end], y[j:j_end]))
                links.update(itertools.product(*groups[-1]))
                i, j = i_end, j_end
        n_a, n_b = sum(len(g) for g, _ in groups), sum(len(g) for _, g in groups)
        digest = hashlib.sha256(";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups).encode()).hexdigest() if groups else ""
        rows.append((n_a, n_b, len(groups), links, digest))
        held.update(links.keys())
    most = collections.Counter()
    other = collections.Counter()
    for (p, q), n in held.items():
        most[p], other[q] = max(most[p], n), max(other[q], n)
    return [
        (n_a, n_b, g, sum(l.values()), sum(m for (p, q), m in l.items() if held[p, q] == most[p]), sum(m for (p, q), m in l.items() if held[p, q] == other[q]), sum(m * held[k] for k, m in l.items()), s)
        for n_a, n_b, g, l, s in rows
    ]


@pytest.mark.parametrize("kind", ["odd", "table", "joined", "parts"])
def test_alignment_equals_whole_texts(spark, kind, monkeypatch):
    texts = TEXTS + ["the cat sat", "the cat sat", "on the mat"]
    if kind in ("table", "joined"):
        texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    if kind == "joined":
        monkeypatch.setattr(token_align, "SHIPPED_PAIRS", 50)
    if kind == "parts":
        monkeypatch.setattr(token_align, "PART", 7)
        monkeypatch.setattr(token_align, "LAID_OUT", 1)
    docs = spark.createDataFrame([(i, t, 1, None) for i, t in enumerate(texts)], "doc_id long, text string, n_a int, pairs array<bigint>").repartition(3)
    out = {r.doc_id: tuple(r)[1:] for r in token_align.align(docs).collect()}
    want = whole_text(texts)
    assert [out[i] for i in range(len(texts))] == want
    assert kind != "table" or sum(r[0] > 0 for r in want) > 150


def test_alignment_of_random_texts(spark):
    rng = np.random.default_rng(5)
    letters = list("ab  \n\n\t.,'s1é你\U0001f600▁\r\x1c <>")
    texts = ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: tuple(r)[1:] for r in token_align.align(docs).collect()}
    assert [out[i] for i in range(len(texts))] == whole_text(texts)
    assert token_align.align(docs.limit(0)).collect() == []
    twice = token_align.align(docs.limit(1).union(docs.limit(1)).selectExpr("cast(null as bigint) doc_id", "text")).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_queries_read_whole_tables(spark):
    for name, table in (("op11_host_quality", "documents"), ("op13_token_alignment", "documents")):
        assert queries.QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
