"""Near-duplicate documents by Order MinHash with banded alignment.

Every document becomes the sequence of its five-word k-mers, each labelled by
its occurrence. A sketch takes the ``ELL`` least k-mers under one hash function
and keeps them in text order, so it agrees only where two texts hold the same
passages in the same order. Texts that share a sketch are candidates. A banded
alignment of the two k-mer sequences decides: aligned k-mers over all distinct
k-mers must reach the threshold. The band follows from it, a ninth of both
lengths at 0.8, and is exact: no alignment that reaches the threshold leaves
more k-mers unmatched. Short texts, for which few k-mers decide a sketch, also
meet by sketches that leave out one k-mer at a time (SHORT).

Exact copies are one node. Members of a bucket are first compared with its
least member only; then every member outside that member's component meets
the members of other components in blocks. So a bucket of any size costs one
comparison per member while it is one group, and links between groups are
still found.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import by_root, connected_components
from .scratch import Scratch
from .textscan import digest128, label_occurrences, mix, scan_words, shingles, tidy

WIDTH = 5
THRESHOLD = 0.8
ELL = 4
SKETCHES = 20
#: Texts of up to so many k-mers get further sketches: every run of their k-mers but one, which finds all pairs a k-mer apart.
SHORT = 12
#: Pairs of one head that a task aligns, and parts that rows of one key are dealt to where they are joined.
HEAD_PAIRS = 256
PARTS = 16
#: Rows of two keys that may travel to every executor.
SHIPPED_ROWS = 50_000
#: Texts, and words in all, in a block of the comparison across groups.
BLOCK = 256
BLOCK_WORDS = 2_000_000
#: Expected k-mers below the cut of a hash function; documents with fewer than ELL below it are sketched in full.
BELOW = 16.0


def _parts(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, rows, at = shingles(words, WIDTH)
    return label_occurrences(keys, rows), rows, at


def sketch_words(words, n_sketches: int, ell: int) -> np.ndarray:
    """int64 sketches (rows x n_sketches); rows without words get zeros."""
    keys, rows, at = _parts(words)
    n = np.bincount(rows, minlength=words.rows)
    out = np.zeros((words.rows, n_sketches), np.uint64)
    share = np.minimum(BELOW / np.maximum(n, 1), 1.0)
    limit = np.where(share >= 1.0, np.uint64(2**64 - 1), (share * 2.0**64 * (1 - 2**-50)).astype(np.uint64))
    limits = limit[rows]
    need = np.minimum(n, ell)
    for f in range(n_sketches):
        salt = mix(np.array([f * 2 + 1], np.uint64))[0]
        values = (keys ^ salt) * (mix(np.array([f + 77], np.uint64))[0] | np.uint64(1))
        values ^= values >> np.uint64(29)
        values *= np.uint64(0x94D049BB133111EB)
        near = np.flatnonzero(values <= limits)
        lacking = np.bincount(rows[near], minlength=words.rows) < need
        if lacking.any():
            near = np.flatnonzero((values <= limits) | lacking[rows])
        order = near[np.lexsort((values[near], rows[near]))]
        first = np.concatenate(([0], np.cumsum(np.bincount(rows[order], minlength=words.rows))))
        rank = np.arange(len(order)) - first[rows[order]]
        least = order[rank < ell]
        least = least[np.lexsort((at[least], rows[least]))]
        first = np.concatenate(([0], np.cumsum(need)))
        rank = np.arange(len(least)) - first[rows[least]]
        acc = np.zeros(words.rows, np.uint64)
        for k in range(ell):
            some = rank == k
            acc[rows[least[some]]] = mix(acc[rows[least[some]]] + keys[least[some]] + np.uint64(k + 1))
        out[:, f] = acc
    return out.view(np.int64)


def short_sketches(words) -> list[np.ndarray]:
    """For each row of 2 to SHORT k-mers the hashes of its sequence and of each sequence with one k-mer left out, else none.

    At 0.8 two texts of which the longer has at most nine k-mers differ by one
    k-mer added or left out, or by one changed where both have nine or more; both
    cases share one of these sequences.
    """
    keys, rows, _ = _parts(words)
    n = np.bincount(rows, minlength=words.rows)
    first = np.concatenate(([0], np.cumsum(n)))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * words.rows
    for size in range(2, SHORT + 1):
        own = np.flatnonzero(n == size)
        if not len(own):
            continue
        table = keys[first[own][:, None] + np.arange(size)]
        found = []
        for skip in range(-1, size):
            acc = np.zeros(len(own), np.uint64)
            for k in range(size):
                if k != skip:
                    acc = mix(acc + table[:, k] + np.uint64(17))
            found.append(acc)
        for r, row in zip(own.tolist(), np.stack(found, 1).view(np.int64)):
            out[r] = np.unique(row)
    return out


def sketch_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, key, n_words, buckets) of every row; tag is a hash of the raw text, key is null where a text has no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in scan_words(batch.column(1)):
                some = words.counts > 0
                keys = digest128(words)
                sketches = sketch_words(words, SKETCHES, ELL)
                n = words.rows
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(np.ascontiguousarray(keys))])
                key = pa.array([k if s else None for k, s in zip(raw.to_pylist(), some.tolist())], pa.binary())
                # a bucket is a hash of the number of a sketch and its value; sketches of short texts share one number
                numbered = mix(sketches.view(np.uint64) + np.arange(SKETCHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                short = short_sketches(words)
                buckets = [np.concatenate(x) for x in zip(numbered, short)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in buckets]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(buckets) if buckets else np.zeros(0, np.int64))
                own = [batch.column(0).slice(words.row0, n), batch.column(2).slice(words.row0, n), key, pa.array(words.counts.astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(own, names=["id", "tag", "key", "n_words", "buckets"])

    return _tagged(docs, id_col, text_col).mapInArrow(tidy(run), f"id {kind}, tag bigint, key binary, n_words bigint, buckets array<bigint>")


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), text_tag(text).alias("tag"))


def text_tag(text: Column) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(text)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every class of :func:`near_duplicates`, whatever ids repeat or are null.

    Rows alike in id and text are one row in the result, any of them; texts
    without words are in no class and all stay. Columns keep their names.
    """
    classes = near_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("own_id"), F.col("text_tag").alias("own_tag"), "kept", "n_words")
    gone = classes.groupBy("own_id", "own_tag").agg(F.max("kept").alias("stays"), F.count("*").alias("n"), F.max("n_words").alias("words"))
    gone = Scratch(docs.sparkSession).table(gone.where("not stays or (n > 1 and words > 0)"), "gone")
    # whole rows travel in one column, so that no name can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), text_tag(F.col(text_col).cast("string")).alias("tag"))
    same = lambda other: rows["id"].eqNullSafe(other["own_id"]) & rows["tag"].eqNullSafe(other["own_tag"])
    few = gone.count() <= SHIPPED_ROWS
    out = rows.join(F.broadcast(gone) if few else gone, same(gone), "left_anti").select("row")
    again = gone.where("stays")
    if not again.isEmpty():
        out = out.union(rows.join(F.broadcast(again) if few else again, same(again)).groupBy("own_id", "own_tag").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")


def band(threshold: float) -> float:
    """Share of both lengths together that an alignment reaching the threshold may leave unmatched on either side."""
    return (1 - threshold) / (1 + threshold)


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned over distinct k-mers of two sequences whose k-mers are unique each, within the band."""
    if not len(a) or not len(b):
        return 0.0
    order = np.argsort(b)
    spot = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    hit = order[spot]
    i = np.flatnonzero(b[hit] == a)
    j = hit[i]
    close = np.abs(i - j) <= (len(a) + len(b)) * band(threshold) + 1
    j = j[close]
    if len(j) > 1 and (np.diff(j) < 0).any():
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        aligned = len(tails)
    else:
        aligned = len(j)
    return aligned / (len(a) + len(b) - aligned)


def _sequences(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    for words in scan_words(column):
        keys, rows, _ = _parts(words)
        yield from np.split(keys, np.cumsum(np.bincount(rows, minlength=words.rows))[:-1])


def _spread(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of ``rows`` with one row of ``facts`` for a key; rows of one key go to PARTS tasks."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    facts = facts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    return rows.join(facts, [key, "part"]).drop("part")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of keys whose texts align to the threshold, with their similarity; a head b travels once for HEAD_PAIRS pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            leaders = batch.column(3)
            encoded = leaders.dictionary_encode()
            known = list(_sequences(encoded.dictionary))
            which = encoded.indices.to_pylist()
            sim = [aligned_similarity(x, known[w], threshold) for x, w in zip(_sequences(batch.column(2)), which)]
            keep = [k for k, s in enumerate(sim) if s >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.binary()), pa.array([b[k] for k in keep], pa.binary()), pa.array([sim[k] for k in keep], pa.float64())], names=["a", "b", "similarity"])

    heads = pairs.groupBy("b").agg(F.ceil(F.count("*") / HEAD_PAIRS).cast("int").alias("shares"))
    heads = scratch.table(heads.where("shares > 1"), "heads")
    few = heads.count() <= SHIPPED_ROWS
    shares = F.coalesce("shares", F.lit(1))
    dealt = pairs.join(F.broadcast(heads) if few else heads, "b", "left").select("a", "b", F.pmod(F.xxhash64("a", F.lit(7)), shares).cast("int").alias("share"))
    one = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")).join(pairs.select("b").distinct(), "b", "left_semi").join(F.broadcast(heads) if few else heads, "b", "left")
    two = two.select("b", "text_b", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    both = dealt.join(one, "a").join(two, ["b", "share"]).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(tidy(run), "a binary, b binary, similarity double")


def _shared_counts(lefts: list[np.ndarray], rights: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """k-mers that each left and each right sequence have in common, by products of incidence matrices."""
    out = np.zeros((len(lefts), len(rights)), np.float32)
    if not lefts or not rights:
        return out
    a, b = np.concatenate(lefts), np.concatenate(rights)
    row_a = np.repeat(np.arange(len(lefts)), [len(x) for x in lefts])
    row_b = np.repeat(np.arange(len(rights)), [len(x) for x in rights])
    common = np.intersect1d(a, b)
    for begin in range(0, len(common), columns):
        part = common[begin : begin + columns]
        sides = []
        for values, rows, n in ((a, row_a, len(lefts)), (b, row_b, len(rights))):
            spot = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[spot] == values
            side = np.zeros((n, len(part)), np.float32)
            side[rows[hit], spot[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _across(odd: DataFrame, hot: DataFrame, families: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Verified links (a, b, similarity) between groups that meet in a bucket.

    Families are texts that chains of shared buckets join. Inside a family the
    members outside their bucket's first group meet all others, block by block:
    a text travels once per block pair, not per pair. Counts of shared k-mers
    bound the alignment, so only pairs that can reach the threshold are
    aligned; once two groups are linked in a block, their further pairs are
    passed over.
    """
    family = families.select(F.col("node").alias("key"), F.col("root").alias("family"))
    rows = hot.select("key", "root").distinct().join(family, "key").join(odd.select("key", F.lit(True).alias("odd")).distinct(), "key", "left")
    rows = scratch.table(rows.withColumn("odd", F.coalesce("odd", F.lit(False))).join(nodes.select("key", "n_words"), "key"), "families")
    parts = lambda n, words: F.ceil(F.greatest(n / BLOCK, words / BLOCK_WORDS)).cast("int")
    odd_words = F.sum(F.when(F.col("odd"), F.col("n_words")))
    sizes = rows.groupBy("family").agg(parts(F.count("*"), F.sum("n_words")).alias("blocks"), parts(F.count_if("odd"), odd_words).alias("odd_blocks"))
    sizes = scratch.table(sizes.where("odd_blocks > 0"), "sizes")
    rows = _spread(rows.drop("n_words"), sizes, "family", "key").join(texts, "key")
    spot = F.xxhash64("key")
    right = rows.withColumn("block", F.pmod(spot, F.col("blocks"))).withColumn("odd_block", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)))
    left = rows.where("odd").withColumn("odd_block", F.pmod(spot, F.col("odd_blocks"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["family", F.col("block").cast("int"), F.col("odd_block").cast("int"), "key", "root", "text"]
    both = left.select(F.lit(True).alias("left"), *columns).unionByName(right.select(F.lit(False).alias("left"), *columns))

    def run(table: pa.Table) -> pa.Table:
        keys, roots = table["key"].to_pylist(), table["root"].to_pylist()
        sequences = list(_sequences(table["text"]))
        is_left = np.array(table["left"].to_pylist(), bool)
        lefts, rights = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        sizes = np.array([len(x) for x in sequences])
        shared = _shared_counts([sequences[i] for i in lefts], [sequences[j] for j in rights])
        enough = shared >= threshold * (sizes[lefts][:, None] + sizes[rights][None, :] - shared)
        parent: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while x in parent:
                x = parent[x]
            return x

        out: list[tuple] = []
        for u, v in np.argwhere(enough).tolist():
            i, j = int(lefts[u]), int(rights[v])
            x, y = find(roots[i]), find(roots[j])
            if x != y and (similarity := aligned_similarity(sequences[i], sequences[j], threshold)) >= threshold:
                parent[x] = y
                out.append((keys[i], keys[j], similarity))
        one, two, three = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(one, pa.binary()), "b": pa.array(two, pa.binary()), "similarity": pa.array(three, pa.float64())})

    return both.groupBy("family", "block", "odd_block").applyInArrow(run, "a binary, b binary, similarity double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, class_id, class_size, n_words, text_tag (xxhash64 of the text), kept.

    ``class_id`` is the least id among documents joined by chains of exact
    copies (equal words in equal order, whatever case and punctuation) and of
    pairs that align to ``threshold``; a null id names a class only where all
    its ids are null. ``kept`` marks one row of each class: the one of the least
    id, then text hash; of rows alike in both, one. Null texts and texts
    without words are alone in their class and kept. A text of fewer than five
    words is one k-mer, so it joins equal texts only. Other columns are not
    read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    table = sketch_table(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.table(table, "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "tag", "row"))
    nodes = scratch.table(
        rows.where("key is not null").groupBy("key").agg(first.alias("first"), F.count("*").alias("copies"), F.first("buckets").alias("buckets"), F.first("n_words").alias("n_words")),
        "nodes",
    )
    bucket = nodes.select("key", F.explode("buckets").alias("bucket"))
    heads = bucket.groupBy("bucket").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", "head")
    members = scratch.table(bucket.join(heads, "bucket"), "members")
    starts = scratch.table(members.where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct(), "starts")

    texts = scratch.table(_texts(docs, members.select("key").distinct(), nodes, id_col, text_col), "texts")
    links = scratch.table(_verified(starts, texts, threshold, scratch), "links")
    groups = connected_components(links)

    placed = members.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    head_root = groups.select(F.col("node").alias("head"), F.col("root").alias("head_root"))
    placed = scratch.table(placed.join(head_root, "head", "left").withColumn("head_root", F.coalesce("head_root", "head")), "placed")
    odd = placed.where("root <> head_root")
    if not odd.isEmpty():
        hot = placed.join(odd.select("bucket").distinct(), "bucket", "left_semi")
        families = connected_components(hot.where("key <> head"), "key", "head")
        links = scratch.table(_across(odd, hot, families, nodes, texts, threshold, scratch).unionByName(links), "all-links")
        groups = connected_components(links)

    named = nodes.join(groups.withColumnRenamed("node", "key"), "key", "left").select("key", "first", "copies", F.coalesce("root", "key").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("chosen"), F.sum("copies").alias("class_size"))
    classes = scratch.table(by_root(named.select("key", "root"), names).select("key", "chosen", "class_size"), "classes")
    plain = rows.select("id", "key", "n_words", "tag", "row")
    some = plain.where("key is not null").join(classes, "key").select(
        "id", F.col("chosen.id").alias("class_id"), "class_size", "n_words", "tag", (F.col("row") == F.col("chosen.row")).alias("kept")
    )
    none = plain.where("key is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), "n_words", "tag", F.lit(True).alias("kept"))
    scratch.drop(members, starts, texts, placed, nodes, links)
    return some.unionByName(none).select(F.col("id").alias(id_col), "class_id", "class_size", "n_words", F.col("tag").alias("text_tag"), "kept")


def _texts(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text) of the wanted keys, one text each, found again by the id and raw-text hash of one row of the key."""
    chosen = nodes.join(wanted, "key").select("key", F.col("first.id").alias("own_id"), F.col("first.tag").alias("own_tag"))
    docs = _tagged(docs, id_col, text_col)
    found = docs.join(chosen, docs["id"].eqNullSafe(chosen["own_id"]) & (docs["tag"] == chosen["own_tag"]))
    return found.select("key", "text").dropDuplicates(["key"])
