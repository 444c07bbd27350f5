import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm import decontaminate, language_id, masked_lm, mixing, queries, textscan, url_filter, warc_fixity

from . import brute

FOLDER = "/root/testdata/sf0.001"


def water(sizes, repeats=3):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(repeats * sizes[s] for s in capped)
        w = sum(weight[s] for s in sizes if s not in capped)
        target = {s: repeats * sizes[s] if s in capped else left * weight[s] / w for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > repeats * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("kind", ["table", "odd"])
def test_mix_meets_its_targets(spark, kind):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source")
    if kind == "odd":
        rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "x " * 500, None), (4, "y", "b"), (5, "\u00a0 z\u2003q", "c"), (None, "a b", "c"), (6, "", "empty")]
        docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size long, target double")
    out = mixing.digest(mixing.mix(docs)).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = docs.collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += words(r.text)
    want = water(dict(sizes))
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(r.doc_id), words(r.text)) for r in rows)
    by_size = {(str(r.doc_id), words(r.text)): r.source for r in rows}
    taken = collections.Counter()
    for r in out:
        source = by_size[(str(r.doc_id), r.size)]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.digest(mixing.mix(docs.repartition(3)))
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_is_in_order_of_virtual_finish(spark):
    order = sorted(mixing.mix(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect(), key=lambda r: (r.before, r.finish))
    finish = [r.finish for r in order]
    assert finish == sorted(finish)
    # the truncation by words is the one by virtual time
    assert all((r.finish <= 1) == (r.taken > 0) for r in order if r.finish > r.start)
    budget = sum(t for _, t in {(r.source, round(r.target)) for r in order})
    assert sum(r.taken for r in order) == budget


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_language_edges(spark):
    rows = [(k, w * 20, lang, "l") for k, (w, lang) in enumerate([("haus und hof ", "de"), ("house and yard ", "en")] * 20)]
    rows += [(100, None, None, "l"), (101, "", "de", "l"), (102, "123 !?\U0001f600\u3000", "en", "l"), (103, "HAUS UND HOF", None, "l"), (103, "haus und hof", None, "l"), (None, "house and yard", None, "l"), (104, "house and yard " * 3000, None, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    out = [(r.doc_id, r.lang_pred) for r in language_id.identify(df).collect() if r.doc_id is None or r.doc_id >= 100]
    assert sorted(out, key=str) == sorted([(100, "und"), (101, "und"), (102, "und"), (103, "de"), (103, "de"), (None, "en"), (104, "en")], key=str)
    assert language_id.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(df.where("lang is null")).collect()} == {"und"}


def test_languages_of_many_copies_are_learned(spark):
    few = [(f"haus und hof nummer {w}", "de") for w in ("eins", "zwei", "drei")]
    texts = spark.createDataFrame([*few, ("house and yard", "en")], "text string, lang string")
    docs = texts.crossJoin(spark.range(5000).select())
    assert language_id.fit(docs).languages == ["de", "en"]


def test_leaks_equal_brute_force(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(80).collect()}
    names = sorted(items)
    for k, n in enumerate(names[:12]):
        words = items[n].upper().split()
        if k % 3 == 1 and len(words) > 45:
            words[20] = "changed"
        docs[5000 + k] = "before it " * k + " ".join(words) + " after it" * 30
    docs |= {6000: None, 6001: "", 6002: "word"}
    rows = [(i, t, 1) for i, t in docs.items()] + [(5000, docs[5000], 1)]
    bench = spark.createDataFrame([(i, t) for i, t in items.items()] + [(900, None), (901, ""), (902, "word")], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string, similarity int")
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect())

    def bag(words):
        return collections.Counter(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1))))

    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    want = collections.Counter()
    for i, t, _ in rows:
        words = split(t)
        for j, it in [*items.items(), (902, "word")]:
            item = split(it)
            own = bag(item)
            for a in range(max(len(words) - len(item), 0) + 1 if words else 0):
                if len(item) < 5 and len(words) != len(item):
                    break
                other = bag(words[a : a + len(item)])
                both = sum((own & other).values())
                if both / (sum(own.values()) + sum(other.values()) - both) >= 0.8:
                    want[(i, j)] += 1
                    break
    assert got == want and len(want) > 12
    kept = decontaminate.drop_leaks(df, bench)
    assert {r.doc_id for r in kept.collect()} == set(docs) - {i for i, _ in want}
    assert kept.columns == df.columns
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_repeated_items_are_searched_once(spark, monkeypatch):
    one, two = (" ".join(f"{w}{k}" for k in range(12)) for w in "ab")
    rows = spark.range(25_000).selectExpr("id as item_id", f"'{one}' as text")
    more = spark.createDataFrame([(None, one), (30_000, two), (30_001, two.upper()), (30_002, "c d e f g h")], "item_id long, text string")
    bench, docs = rows.unionByName(more), spark.createDataFrame([(1, "x " + one), (2, two), (2, two), (3, "z"), (None, one)], "doc_id long, text string")
    shipped = []
    real = decontaminate.Pass.__init__
    monkeypatch.setattr(decontaminate.Pass, "__init__", lambda self, ids, texts: (shipped.append(len(texts)), real(self, ids, texts))[1])
    for size in (decontaminate.ITEMS_A_PASS, 2):
        monkeypatch.setattr(decontaminate, "ITEMS_A_PASS", size)
        found = {(r.doc_id, r.item_id is None): r["count"] for r in decontaminate.find_leaks(docs, bench).groupBy("doc_id", F.expr("if(item_id is null, null, 1)").alias("item_id")).count().collect()}
        assert found == {(1, False): 25_000, (1, True): 1, (2, False): 4, (None, False): 25_000, (None, True): 1}
        assert [r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()] == [3]
    assert sum(shipped) == 4 * 4 and len(shipped) == 2 + 4


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    items = decontaminate.Items(list(range(50)), [" ".join(f"t{rng.integers(10**6)}" for _ in range(30)) for _ in range(50)])
    for k in range(50):
        for flips in (0, 5, decontaminate.RADIUS):
            value = int(items.prints[k])
            for bit in rng.choice(64, flips, replace=False):
                value ^= 1 << int(bit)
            assert k in items.within(value)


def test_scores_beat_the_uniform_and_cover_edges(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9000, None), (9001, ""), (9002, "..."), (9003, "und der die"), (9003, "und der die")], "doc_id long, text string")
    out = masked_lm.pseudo_likelihood(docs.unionByName(extra)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == docs.count() + 5
    assert all(by[k].n_words == 0 and by[k].mean_log is None and by[k].log_likelihood == 0 for k in (9000, 9001, 9002))
    words = collections.Counter(w for r in docs.collect() for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", r.text.lower()))
    total = sum(words.values())
    uniform = np.log(masked_lm.VOCABULARY)
    mean = -sum(r.log_likelihood for r in out) / sum(r.n_words for r in out)
    assert sum(r.n_words for r in out) == total + 6 and mean < uniform
    assert masked_lm.pseudo_likelihood(docs.limit(0)).count() == 0


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    net = masked_lm.Network(seed=4)
    context, target = rng.integers(0, masked_lm.VOCABULARY + 1, (4, 64)), rng.integers(0, masked_lm.VOCABULARY, 64)
    g = net.gradient(context, target)
    loss = lambda flat: -masked_lm.Network(flat).log_probs(context, target).mean()
    direction = rng.normal(size=net.length)
    eps = 1e-2
    numeric = (loss(net.flat + eps * direction) - loss(net.flat - eps * direction)) / (2 * eps)
    assert numeric == pytest.approx(float(g.flat @ direction), rel=0.05)


def test_training_learns_context(spark):
    words = [f"a{k % 7} b{k % 7} c{k % 7}" for k in range(4000)]
    docs = spark.createDataFrame([(k, " ".join(words[k * 40 : k * 40 + 40])) for k in range(100)], "doc_id long, text string")
    out = masked_lm.pseudo_likelihood(docs).collect()
    assert -np.mean([r.mean_log for r in out]) < np.log(21)


def test_every_word_is_a_target_of_one_round():
    first = np.array([0, 1, 3, 3, 6, 25])
    rounds = [masked_lm.targets(first, turn, masked_lm.ROUNDS) for turn in range(masked_lm.ROUNDS)]
    assert sorted(np.concatenate(rounds)) == list(range(25))
    assert {0, 1, 3, 6} <= set(rounds[0])


@pytest.mark.parametrize("head", [masked_lm.HEAD_WORDS, 20, 0])
def test_rare_words_are_told_apart_within_their_id(spark, monkeypatch, head):
    monkeypatch.setattr(masked_lm, "HEAD_WORDS", head)
    common = " ".join(f"c{k}" for k in range(masked_lm.VOCABULARY - masked_lm.SHARED_IDS))
    rare = [f"x{k}" for k in range(200)]
    docs = spark.createDataFrame([(k, common) for k in range(9)] + [(10, " ".join(rare)), (11, "x0 x0 x0 x0"), (12, "x0"), (12, "x1"), (13, "c1")], "doc_id long, text string")
    counts = collections.Counter(rare + ["x0"] * 5 + ["x1"])
    hashes = {w: next(textscan.scan_words(pa.array([w]))).hashes[0] for w in counts}
    shared = {w: int(h >> np.uint64(40)) % masked_lm.SHARED_IDS for w, h in hashes.items()}
    total = collections.Counter()
    for w, n in counts.items():
        total[shared[w]] += n
    share = {w: np.log(n / total[shared[w]]) for w, n in counts.items()}
    out = masked_lm.pseudo_likelihood(docs).collect()
    got = sorted((r.doc_id, r.word_log_likelihood - r.log_likelihood) for r in out if r.doc_id > 9)
    want = sorted([(10, sum(share[w] for w in rare)), (11, 4 * share["x0"]), (12, share["x0"]), (12, share["x1"]), (13, 0.0)])
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [v for _, v in got] == pytest.approx([v for _, v in want])
    assert all(r.word_log_likelihood == pytest.approx(r.mean_log * r.n_words) for r in out)


def test_urls(spark, tmp_path):
    urls = ["http://A.example.org/es/x?y#z", "https://example.org/en/19", "https://sub.example.org/en/2", "http://x.com/fr/a", "http://x.com/de/a", "http://x.com/en/", "http://org/", "http://org", "no scheme", None, "", "a://b://c/d", "http://spam-farm.example.net/q", "http://w.spam-farm.example.net", "http://HOST.NET/p/q/r", "http://host.net/p", "http://xorg/"]
    want = []
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    listed = ["spam-farm.example.net", "host.net/p/q/", "casino.example.com"]
    for u in urls:
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        parts = host.split(".")
        bad = any(".".join(parts[k:]) in listed for k in range(len(parts))) or (host + path).startswith("host.net/p/q/")
        want.append((host, path, best and best[0] + best[1], best[2] if best else "block" if bad and host else "allow"))
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = sorted(url_filter.judge(df, listed).collect())
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == want
    table = spark.createDataFrame([(x,) for x in listed], "entry string")
    assert sorted(url_filter.judge(df, table).collect()) == got
    limit, url_filter.FILE_BYTES = url_filter.FILE_BYTES, 1
    try:
        assert sorted(url_filter.judge(df, table).collect()) == got
    finally:
        url_filter.FILE_BYTES = limit
    assert url_filter.judge(df.limit(0)).count() == 0


def test_digest_array_confirms_strings(tmp_path):
    path = str(tmp_path / "d")

    def write(strings, digest):
        url_filter.DigestArray.write(path, sorted((digest(s), k, s) for k, s in enumerate(strings)))
        return url_filter.DigestArray(path)

    stored = [f"host{k}.example".encode() for k in range(5000)]
    asked = [b"host7.example", b"host5000.example", b"", b"host4999.example"]
    assert write(stored, url_filter.digest).find(asked) == [[7], [], [], [4999]]
    clash = lambda raw: xxhash.xxh64_intdigest(raw) % 3
    assert write(stored[:50], clash).find([b"host49.example", b"host50.example"], clash) == [[49], []]
    assert write([], url_filter.digest).find([b"a"]) == [[]]


def test_spark_sorts_the_digests_that_workers_ask_for(spark):
    texts = ["", "a", "org/", "example.org/es/", "ü" * 40]
    got = [r.d % 2**64 for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("d")).collect()]
    assert got == [url_filter.digest(t.encode()) for t in texts]


def test_long_urls_ask_for_few_prefixes():
    keys = list(url_filter.candidates("a.b.c", "/x" * 100_000, [0, 1, 4, 9]))
    assert len(keys) == 12 and max(map(len, keys)) == len("a.b.c") + 9


def test_audit_finds_all_planted_faults(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: r.status for r in queries.op6_warc_fixity(spark, "/root/testdata/sf0.01").collect()}
    assert len(out) == pages.count()
    for k, status in out.items():
        assert status == ("missing" if k % 389 == 7 else "damaged" if k % 97 == 13 else "ok")


def test_segments_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x\r\n\r\ny"), (1, "http://a/", "x\r\n\r\ny"), (2, None, None), (None, "u\nv", "ü"), (3, "http://b", "")]
    records = warc_fixity.records(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int"))
    ours = warc_fixity.lay_out(records)
    path = str(tmp_path / "warc")
    warc_fixity.write_segments(ours, records, path)
    back = warc_fixity.read_segments(spark, path)
    assert sorted(map(str, back.drop("record").collect())) == sorted(map(str, ours.collect()))
    assert sorted(r.record for r in back.collect()) == sorted(r.record for r in records.collect())
    assert [r.status for r in warc_fixity.audit(ours, back).collect()] == ["ok"] * 5
    more = warc_fixity.audit(ours.where("seq > 0"), back)
    assert sorted(r.status for r in more.collect()) == ["ok"] * 4 + ["surplus"]
    nothing = warc_fixity.lay_out(warc_fixity.records(spark.createDataFrame([], "page_id long, url string, html string")))
    assert nothing.count() == 0 and warc_fixity.audit(nothing, nothing).count() == 0
    assert {r.status for r in warc_fixity.audit(ours, nothing).collect()} == {"missing"}


def test_faults_in_files_are_located_one_by_one(spark, tmp_path):
    records = warc_fixity.records(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    ours = warc_fixity.lay_out(records).cache()
    path = tmp_path / "warc"
    warc_fixity.write_segments(ours, records, str(path))
    file = next(path.rglob("part-*"))
    raw = file.read_bytes()
    spots = [(r.id, r.offset, r.length) for r in ours.where("segment = 0").orderBy("seq").collect()]
    cut = {k: raw[o : o + n] for k, (_, o, n) in enumerate(spots)}

    def bend(part, at, value):
        return part[:at] + value + part[at + len(value) :]

    length_at = lambda k: cut[k].index(b"Content-Length: ") + len(b"Content-Length: ")
    faults = {
        "lost": ({20: b""}, {20: "missing"}),
        "inserted": ({30: cut[30] + cut[30].replace(f":{spots[30][0]}>".encode(), b":990001>")}, {990001: "surplus"}),
        "truncated": ({40: cut[40][:-60]}, {40: "damaged"}),
        "flipped": ({50: bend(cut[50], len(cut[50]) - 20, b"\xff")}, {50: "damaged"}),
        "length": ({60: bend(cut[60], length_at(60), b"x")}, {60: "damaged"}),
        "longer": ({61: bend(cut[61], length_at(61), b"9")}, {61: "damaged"}),
        "magic": ({70: bend(cut[70], 2, b"?")}, {70: "damaged"}),
        "name": ({80: bend(cut[80], cut[80].index(b"<urn:page:") + 10, b"?")}, {80: "damaged"}),
        "end": ({85: cut[85][:-2] + b"??"}, {85: "damaged"}),
        "first": ({0: b"junk", 1: cut[1]}, {0: "damaged"}),
        "all": ({20: b"", 40: cut[40][:-60], 50: bend(cut[50], len(cut[50]) - 20, b"\xff"), 80: bend(cut[80], cut[80].index(b"<urn:page:") + 10, b"?")}, {20: "missing", 40: "damaged", 50: "damaged", 80: "damaged"}),
    }
    for name, (new, want) in faults.items():
        file.write_bytes(b"".join(new.get(k, part) for k, part in cut.items()))
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
        out = warc_fixity.audit(ours, warc_fixity.read_segments(spark, str(path))).where("status <> 'ok'").collect()
        assert {r.id: r.status for r in out} == {(spots[k][0] if k < 1000 else k): s for k, s in want.items()}, name


def _odd_documents(spark, docs):
    """A few documents with nulls, ties, repeats, an empty and a long text, and columns that clash with the operators' own."""
    rows = [(None, "the house and the yard of the man " * 3, "en", None, None), (None, "the house and the yard of the man " * 3, "en", None, None), (1, None, None, "s", 0), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5)]
    rows += [(4, "long words in a row " * 20_000, "en", "s", 1), (5, "write to ab.c@example.org now please, all of you", None, "s", 1), (5, "write to ab.c@example.org now please, all of you", None, "s", 1)]
    names = ("score", "lang_pred", "n_letters", "row", "key", "kept", "tag", "spans", "base", "ids", "n", "name", "size", "target", "copy", "taken", "_siftline_id")
    df = spark.createDataFrame(rows, docs.schema)
    return df.select(*df.columns, *[F.lit(f"own {k}").alias(k) for k in names])


def test_stages_keep_odd_rows_and_clashing_columns(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = _odd_documents(spark, docs)
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    everything = ids(odd)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, FOLDER)
        assert out.columns == odd.columns, name
        gone = {"language_id": {"1", "2", "3"}, "order_minhash": set()}.get(name, set())
        want = [i for i in everything if i not in gone]
        if name == "order_minhash":
            want = sorted([*(i for i in everything if i not in ("None", "5")), "5", "None"])
        assert ids(out) == want, name
        assert out.where("score <> 'own score' or row <> 'own row' or kept <> 'own kept'").count() == 0
        assert stage(spark, odd.limit(0), FOLDER).count() == 0
    mixed = cp.mixing_stage(spark, odd, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in mixed) == everything and all(r.taken <= 3 * r.size for r in mixed)
    assert cp.mixing_stage(spark, odd.limit(0), FOLDER).count() == 0


def test_an_unlabelled_corpus_passes_the_language_stage(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(k, f"some words {k}", None, "s", 1) for k in range(9)] + [(9, "...", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.language_stage(spark, docs, FOLDER).collect()
    assert sorted(r.doc_id for r in kept) == list(range(9)) and {r.lang for r in kept} == {None}


def plain_costs(samples, text):
    """Greedy phrases of a text by substring search, at the logarithm of each sample's length."""
    code = lambda t: "".join(map(chr, language_id.normalise([t])[0]))
    word, out = code(text), {}
    for lang, sample in samples.items():
        own, at, n = code("\n".join(sample))[: language_id.SAMPLE_CHARS], 0, 1
        while at < len(word):
            end = at
            while end < len(word) and word[at : end + 1] in own:
                end += 1
            # the letter that fails begins the next phrase
            if end == len(word):
                break
            n, at = n + 1, end if word[end] in own else end + 1
        out[lang] = n * np.log2(len(own) + 2.0)
    return out


def test_languages_equal_the_plain_cross_parsing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    letters = {lang: rng.permutation(list("abcdefgh")) for lang in ("aa", "bb", "cc", "dd", "ee")}
    words = lambda lang, n: " ".join("".join(rng.choice(letters[lang][: 3 + k % 4], 4)) for k in range(n))
    samples = {lang: [words(lang, 40)] for lang in letters}
    texts = [words(lang, 12) for lang in letters for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id.predict(df, language_id.Model(samples), ["doc_id"]).collect()}
    for k, text in enumerate(texts):
        costs = plain_costs(samples, text)
        first, following = sorted(costs.values())[:2]
        assert one[k] == (min(costs, key=lambda x: (costs[x], x)), round(max(0.0, 1 - first / following), 9))
    monkeypatch.setattr(language_id, "PASS_LANGUAGES", 2)
    some = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id.predict(df, language_id.Model(samples), ["doc_id"]).collect()}
    assert some == one


def test_log_probabilities_equal_a_plain_softmax():
    rng = np.random.default_rng(5)
    net = masked_lm.Network(seed=7)
    ids, first = rng.integers(0, masked_lm.VOCABULARY, 23), np.array([0, 1, 1, 9, 23])
    got = net.log_probs(masked_lm.contexts(ids, first, np.arange(23)), ids)
    for a, b in zip(first[:-1], first[1:]):
        for at in range(a, b):
            hidden = net.bias.astype(float).copy()
            for k, offset in enumerate(masked_lm.OFFSETS):
                hidden += net.embed[k][ids[at + offset] if a <= at + offset < b else masked_lm.VOCABULARY]
            hidden = np.tanh(hidden)
            group, word = divmod(int(ids[at]), masked_lm.PER_CLASS)
            one = np.exp(hidden @ net.cls + net.cls_bias)
            two = np.exp(hidden @ net.word[group] + net.word_bias[group])
            assert got[at] == pytest.approx(np.log(one[group] / one.sum() * two[word] / two.sum()), abs=1e-4)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    extra = spark.createDataFrame([(9000, None, "en", "s", 0), (9001, "12 34", "en", "s", 5), (9002, "mail to ab.c@example.org now please", "en", "s", 34), (9003, "so it is: " + benchmark[0], None, None, 9)], docs.schema)
    first = docs.unionByName(extra)
    kept = cp.language_stage(spark, first, FOLDER)
    ids = {r.doc_id for r in kept.collect()}
    assert {9002, 9003} <= ids and not {9000, 9001} & ids
    assert kept.where("lang is null").count() == 0 and kept.columns == docs.columns
    one = cp.dedup_stage(spark, kept, FOLDER)
    grams = {r.doc_id: frozenset(brute.kmers(r.text)) for r in one.collect()}
    assert len(set(grams.values())) == len(grams)
    clean = cp.decontamination_stage(spark, one, FOLDER)
    assert 9003 not in {r.doc_id for r in clean.collect()} and 9002 in {r.doc_id for r in clean.collect()}
    safe = cp.pii_stage(spark, clean, FOLDER)
    row = safe.where("doc_id = 9002").first()
    assert row.text == "mail to [EMAIL] now please" and row.n_chars == len(row.text)
    assert safe.columns == docs.columns and safe.count() == clean.count()
    assert cp.mixing_stage(spark, safe, FOLDER).count() == safe.count()
    assert cp.run(spark, FOLDER).count() > 100
