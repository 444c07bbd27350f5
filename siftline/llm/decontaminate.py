"""Benchmark decontamination by SimHash over item-sized windows.

Documents are cut into windows of as many words as an item has. A window that
reaches the threshold shares a five-word shingle with the item, so only windows
over such a shingle are fingerprinted. Their SimHashes meet the items' in a
multi-index: a fingerprint of 64 bits has four blocks of 16, and two within
RADIUS bits agree to within a quarter of it in one block, so looking up the
items near each block value finds all of them. The exact similarity of both
bags of shingles, weighted by their counts, then decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textscan import scan_words, shingles, tidy

WIDTH = 5
THRESHOLD = 0.8
#: At a similarity of 0.8 fingerprints differ in ten of 64 bits on average (deviation three).
RADIUS = 23
BLOCKS = 4
#: Items a pass; more are taken in further passes over the documents.
ITEMS_A_PASS = 20_000
BYTES_A_PASS = 32 << 20
#: Rows with a leak that may travel to every executor.
SHIPPED_ROWS = 50_000
_BLOOM_BITS = 22
_SEEN = 20_000
_POP16 = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)


def fingerprint(keys: np.ndarray) -> int:
    """SimHash: bit by bit, the majority of the keys, each as often as it occurs."""
    bits = np.unpackbits(np.ascontiguousarray(keys, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(keys), bitorder="little").tobytes(), "little")


def _distance(a: int, b: np.ndarray) -> np.ndarray:
    x = b ^ np.uint64(a)
    return sum(_POP16[((x >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)].astype(int) for k in range(BLOCKS))


class Items:
    """Shingles, fingerprints and the multi-index of one pass of items."""

    def __init__(self, ids: list, texts: list[str], width: int = WIDTH, radius: int = RADIUS):
        self.width, self.radius, self.ids = width, radius, []
        self.keys: list[np.ndarray] = []
        self.sizes: list[int] = []
        for words in scan_words(pa.array(texts, pa.string())):
            keys, rows, _ = shingles(words, width)
            for r in range(words.rows):
                if words.counts[r]:
                    self.ids.append(ids[words.row0 + r])
                    self.keys.append(keys[rows == r])
                    self.sizes.append(int(words.counts[r]))
        self.counts = [Counter(k.tolist()) for k in self.keys]
        everything = np.concatenate(self.keys) if self.keys else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.keys)), [len(k) for k in self.keys]).astype(np.int64)
        pairs = np.unique(np.stack([everything, owner.astype(np.uint64)], 1), axis=0) if len(everything) else np.zeros((0, 2), np.uint64)
        self.known, self.first, self.holders = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        self.owner = pairs[:, 1].astype(np.int64)
        self.bloom = np.zeros(1 << _BLOOM_BITS, bool)
        self.bloom[(self.known >> np.uint64(64 - _BLOOM_BITS)).astype(np.int64)] = True
        self.prints = np.array([fingerprint(k) for k in self.keys], np.uint64)
        blocks = [((self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64) for b in range(BLOCKS)]
        self.blocks = []
        for values in blocks:
            order = np.argsort(values, kind="stable")
            distinct, begin = np.unique(values[order], return_index=True)
            self.blocks.append((distinct, np.split(order, begin[1:]) if len(order) else []))
        self.seen: dict[tuple, list] = {}
        self.near: list[dict[int, np.ndarray]] = [{} for _ in range(BLOCKS)]

    def within(self, value: int) -> np.ndarray:
        """Items whose fingerprints are within the radius: block lookups first, whole distances after."""
        found: list[np.ndarray] = []
        for b in range(BLOCKS):
            part = (value >> (16 * b)) & 0xFFFF
            if part not in self.near[b]:
                distinct, groups = self.blocks[b]
                close = np.flatnonzero(_POP16[distinct ^ part] <= self.radius // BLOCKS)
                self.near[b][part] = np.concatenate([groups[g] for g in close]) if len(close) else np.zeros(0, np.int64)
            found.append(self.near[b][part])
        items = np.unique(np.concatenate(found))
        return items[_distance(value, self.prints[items]) <= self.radius] if len(items) else items

    def similarity(self, item: int, keys: np.ndarray) -> float:
        """Jaccard similarity of two bags of shingles, each weighted by its count."""
        own = self.counts[item]
        bag = Counter(keys.tolist())
        both = sum(min(n, bag[k]) for k, n in own.items() if k in bag)
        return both / (len(self.keys[item]) + len(keys) - both)

    def matches(self, size: int, window: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Items of ``size`` words that the window reaches; equal windows are looked up once."""
        name = (size, window.tobytes())
        if name not in self.seen:
            if len(self.seen) >= _SEEN:
                self.seen.clear()
            items = [i for i in self.within(fingerprint(window)).tolist() if self.sizes[i] == size]
            self.seen[name] = [(i, s) for i in items if (s := self.similarity(i, window)) >= threshold]
        return self.seen[name]

    def search(self, keys: np.ndarray, n_words: int, threshold: float) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item that reaches the threshold."""
        spots = np.flatnonzero(self.bloom[(keys >> np.uint64(64 - _BLOOM_BITS)).astype(np.int64)])
        where = np.searchsorted(self.known, keys[spots])
        hit = self.known[np.minimum(where, len(self.known) - 1)] == keys[spots] if len(self.known) else np.zeros(0, bool)
        starts: dict[int, set[int]] = {}
        need: dict[int, int] = {}
        for at, k in zip(spots[hit].tolist(), where[hit].tolist()):
            for item in self.owner[self.first[k] : self.first[k] + self.holders[k]].tolist():
                size = self.sizes[item]
                starts.setdefault(size, set()).update(range(max(0, at - max(size - self.width, 0)), min(at, max(n_words - size, 0)) + 1))
        best: dict[int, tuple[int, float, int, int]] = {}
        for size, begins in starts.items():
            span = max(size - self.width + 1, 1)
            if size < self.width and n_words != size:
                continue
            for begin in sorted(begins):
                for item, s in self.matches(size, keys[begin : begin + span], threshold):
                    if item not in best or s > best[item][1]:
                        best[item] = (item, s, begin, min(size, n_words))
        return [best[i] for i in sorted(best)]


class Pass:
    """Items of one pass as they travel; a worker builds their index once, for all its tasks."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.texts = ids, texts

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "texts": self.texts}

    @cached_property
    def items(self) -> Items:
        return Items(self.ids, self.texts)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item found in it: id, item id, similarity, first_word, n_words of the best window.

    The threshold holds for the bags of five-word shingles of the item and of a
    window of the item's length; a shorter document is one window. Items of
    fewer than five words match documents of the same words only. Null or empty
    texts and items match nothing; repeated rows are searched, and listed, each
    for itself; an empty table on either side gives an empty result. Other
    columns are not read. Items travel to the executors in passes of bounded
    size, equal ones once, so a benchmark of any size and any repeats is
    searched whole; so are documents of any length.
    """
    known = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("_item"), F.sha2(F.col(item_text).cast("string"), 256).alias("_key"))
    found = _found(docs, items, id_col, text_col, item_text, threshold)
    return found.join(known, "_key").select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "similarity", "first_word", "n_words")


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_text: str, threshold: float) -> DataFrame:
    """(_id, _key, similarity, first_word, n_words): as :func:`find_leaks`, by the digest of an item's text.

    Equal texts are one item, so a pass holds each once, however often it is repeated.
    """
    spark = docs.sparkSession
    texts = items.where(F.col(item_text).isNotNull()).select(F.col(item_text).cast("string").alias("text")).distinct()
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(-(-size["n"] // ITEMS_A_PASS), -(-size["bytes"] // BYTES_A_PASS), 1)
    if passes > 1:
        texts = Scratch(spark).table(texts, "items")
    out = None
    for k in range(passes):
        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).select(F.sha2("text", 256).alias("key"), "text").orderBy("key").collect()
        shared = spark.sparkContext.broadcast(Pass([r["key"] for r in part], [r["text"] for r in part]))
        found = _search(docs, shared, id_col, text_col, threshold)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, shared, id_col: str, text_col: str, threshold: float) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "_key", "similarity", "first_word", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = shared.value.items
            for words in scan_words(batch.column(1)):
                keys, rows, _ = shingles(words, WIDTH)
                touched = np.unique(rows[items.bloom[(keys >> np.uint64(64 - _BLOOM_BITS)).astype(np.int64)]])
                begin, end = np.searchsorted(rows, touched), np.searchsorted(rows, touched, "right")
                where, found = [], []
                for r, a, b in zip(touched.tolist(), begin.tolist(), end.tolist()):
                    for hit in items.search(keys[a:b], int(words.counts[r]), threshold):
                        where.append(words.row0 + r)
                        found.append(hit)
                if found:
                    which, similarity, first, size = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(where)), pa.array([items.ids[i] for i in which]), pa.array(similarity), pa.array(first, pa.int64()), pa.array(size, pa.int64())], names=names
                    )

    schema = f"_id {kind}, _key string, similarity double, first_word bigint, n_words bigint"
    return docs.select(id_col, F.col(text_col).cast("string").alias("_siftline_text")).mapInArrow(tidy(run), schema)


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and text hold an item; rows with a null id are judged by their text.

    Null and empty texts stay; repeated rows go or stay together; an empty table
    gives an empty one, and without items all stay. Other columns do not count,
    whatever their names; texts of any length are searched whole.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tag")).alias("own"), F.col(text_col).alias("text"))
    leaks = Scratch(docs.sparkSession).table(_found(row, items, "own", "text", "text", THRESHOLD).select(F.col("_id").alias("own")).distinct(), "leaks")
    return row.join(F.broadcast(leaks) if leaks.count() <= SHIPPED_ROWS else leaks, "own", "left_anti").select("row.*")
