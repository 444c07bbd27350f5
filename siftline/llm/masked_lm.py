"""Masked pseudo-likelihood scores from a bidirectional window network.

Word counts over all documents make the vocabulary: the most frequent words
have an id each, all others share hashed ids. The network predicts every word
from the two words on either side, never from itself: position-wise embeddings
are summed, squashed, and feed a softmax over word classes and one over the
words of the class. It is trained in numpy, in rounds over every document, each
on its own share of the words, so that every word is a target once: each
partition starts from the shared weights, takes steps on its words, and the
weights are averaged by the words seen. A score is the sum of the conditional
log-probabilities of all words of a document; a word that shares an id adds the
log-probability of the word within its id, from the counts of the corpus: a
bounded head of frequent words is looked up, all others are joined by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import treesum
from .scratch import Scratch
from .textscan import scan_words, tidy

CLASSES = 32
PER_CLASS = 32
VOCABULARY = CLASSES * PER_CLASS
#: Ids for words outside the vocabulary, by hash.
SHARED_IDS = 32
#: Most words that travel to every worker with their share (16 bytes each); the shares of all others are joined.
HEAD_WORDS = 1 << 16
DIM = 24
OFFSETS = (-2, -1, 1, 2)
ROUNDS = 4
STEP = 0.1
BATCH = 4096
CHUNK = 1 << 16
_EDGE = VOCABULARY


class Network:
    """Weights, forward pass and training step."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 1):
        shapes = {"embed": (len(OFFSETS), VOCABULARY + 1, DIM), "bias": (DIM,), "cls": (DIM, CLASSES), "cls_bias": (CLASSES,), "word": (CLASSES, DIM, PER_CLASS), "word_bias": (CLASSES, PER_CLASS)}
        sizes = {k: int(np.prod(v)) for k, v in shapes.items()}
        self.length = sum(sizes.values())
        if flat is None:
            flat = np.random.default_rng(seed).normal(0, 0.1, self.length)
        self.flat = np.array(flat, np.float32)
        at = 0
        for name, shape in shapes.items():
            setattr(self, name, self.flat[at : at + sizes[name]].reshape(shape))
            at += sizes[name]

    def hidden(self, context: np.ndarray) -> np.ndarray:
        return np.tanh(self.bias + sum(self.embed[k][context[k]] for k in range(len(OFFSETS))))

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target given its context (offsets x targets)."""
        h = self.hidden(context)
        group, word = target // PER_CLASS, target % PER_CLASS
        scores = _scores(h, self.cls, self.cls_bias)
        out = scores[group, np.arange(len(h))] - _logsum(scores)
        for c, rows in _by_class(group):
            scores = _scores(h[rows], self.word[c], self.word_bias[c])
            out[rows] += scores[word[rows], np.arange(len(rows))] - _logsum(scores)
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> Network:
        """Gradient of the mean negative log-probability, shaped as the weights."""
        g = Network(np.zeros(self.length, np.float32))
        h = self.hidden(context)
        n = len(target)
        group, word = target // PER_CLASS, target % PER_CLASS
        p = _softmax(_scores(h, self.cls, self.cls_bias))
        p[group, np.arange(n)] -= 1
        p /= n
        g.cls += (p @ h).T
        g.cls_bias += p.sum(1)
        back = (self.cls @ p).T
        for c, rows in _by_class(group):
            p = _softmax(_scores(h[rows], self.word[c], self.word_bias[c]))
            p[word[rows], np.arange(len(rows))] -= 1
            p /= n
            g.word[c] += (p @ h[rows]).T
            g.word_bias[c] += p.sum(1)
            back[rows] += (self.word[c] @ p).T
        back *= 1 - h * h
        g.bias += back.sum(0)
        for k in range(len(OFFSETS)):
            near = context[k].astype(np.uint16)
            order = np.argsort(near, kind="stable")
            near = near[order]
            first = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1])))
            g.embed[k][near[first]] += np.add.reduceat(back[order], first, axis=0)
        return g


def _scores(h: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Choices x positions, so that sums over the choices run along whole rows."""
    return weights.T @ h.T + bias[:, None]


def _by_class(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of each class that has any."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=CLASSES))
    for c in range(CLASSES):
        rows = order[ends[c - 1] if c else 0 : ends[c]]
        if len(rows):
            yield c, rows


def _logsum(scores: np.ndarray) -> np.ndarray:
    top = scores.max(axis=0)
    return top + np.log(np.exp(scores - top).sum(axis=0))


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=0))
    e /= e.sum(axis=0)
    return e


def contexts(ids: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Neighbours (offsets x positions) of the words at ``at``; the edge id beyond a document's ends."""
    row = np.searchsorted(first, at, "right") - 1
    out = np.empty((len(OFFSETS), len(at)), np.int64)
    for k, offset in enumerate(OFFSETS):
        where = at + offset
        inside = (where >= first[row]) & (where < first[row + 1])
        out[k] = np.where(inside, ids[np.clip(where, 0, len(ids) - 1)], _EDGE)
    return out


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): hash and count of every distinct word of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in scan_words(batch.column(0)):
                values, n = np.unique(words.hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(count), "word bigint, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """Most frequent of the words that share ids, sorted by hash, with the log of their share."""

    words: np.ndarray
    log_share: np.ndarray


def vocabulary(counts: DataFrame, most: int | None = None) -> tuple[np.ndarray, Head, DataFrame]:
    """Hashes of the most frequent words, most frequent first; shares of the next words; (word, log_share) of all others.

    A share is the log of a word's part of the id it shares. The head holds at
    most ``most`` words (HEAD_WORDS unless given): all of the upper frequency
    levels, eighths of an octave each, that fit as a whole.
    """
    most = HEAD_WORDS if most is None else most
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - SHARED_IDS).collect()
    rest = counts.where(F.lit(False))
    if top:
        n, word = F.lit(top[-1]["n"]), F.lit(top[-1]["word"])
        rest = counts.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > word)))
    rest = rest.withColumn("shared", F.pmod(F.shiftrightunsigned("word", 40), F.lit(SHARED_IDS)))
    rest = rest.withColumn("level", F.floor(F.log2("n") * 8))
    sizes = rest.groupBy("shared").agg(F.sum("n").alias("all"))
    shares = rest.join(F.broadcast(sizes), "shared").select("word", "level", (F.log("n") - F.log("all")).alias("log_share"))
    lowest, held = 1 << 10, 0
    for row in rest.groupBy("level").count().orderBy(F.desc("level")).collect():
        held += row["count"]
        if held > most:
            break
        lowest = row["level"]
    head = shares.where(F.col("level") >= lowest).drop("level").toArrow()
    words, logs = (head.column(k).to_numpy() for k in range(2))
    words = words.view(np.uint64)
    order = np.argsort(words)
    return np.array([r["word"] for r in top], np.int64).view(np.uint64), Head(words[order], logs[order]), shares.where(F.col("level") < lowest).drop("level")


def encode(hashes: np.ndarray, words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ids of hashed words; ``order`` sorts the vocabulary ``words``."""
    shared = (VOCABULARY - SHARED_IDS + (hashes >> np.uint64(40)) % np.uint64(SHARED_IDS)).astype(np.uint16)
    if not len(words):
        return shared
    spot = order[np.minimum(np.searchsorted(words, hashes, sorter=order), len(words) - 1)]
    return np.where(words[spot] == hashes, spot, shared).astype(np.uint16)


def _encoded(docs: DataFrame, words: np.ndarray, head: Head, id_col: str, text_col: str) -> DataFrame:
    """(id, row, ids, known, rare) of every row; known sums the shares of its words of the head, rare holds the hashes of the other words that share an id."""
    shared = docs.sparkSession.sparkContext.broadcast((words, head.words, head.log_share))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, head_words, log_share = shared.value
        order = np.argsort(own)
        for batch in batches:
            for part in scan_words(batch.column(1)):
                ids = encode(part.hashes, own, order)
                offsets = (part.first * 2).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), part.rows, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                alike = np.flatnonzero(ids >= VOCABULARY - SHARED_IDS)
                known = np.zeros(part.rows)
                if len(head_words):
                    hashes = part.hashes[alike]
                    spot = np.minimum(np.searchsorted(head_words, hashes), len(head_words) - 1)
                    held = head_words[spot] == hashes
                    rows = np.searchsorted(part.first, alike[held], "right") - 1
                    known = np.bincount(rows, weights=log_share[spot[held]], minlength=part.rows).astype(np.float64)
                    alike = alike[~held]
                bounds = np.searchsorted(alike, part.first).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(bounds), pa.array(part.hashes[alike].view(np.int64)))
                own_rows = [batch.column(k).slice(part.row0, part.rows) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own_rows, column, pa.array(known), rare], names=["id", "row", "ids", "known", "rare"])

    columns = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row")]
    return docs.select(*columns).mapInArrow(tidy(run), f"id {kind}, row bigint, ids binary, known double, rare array<bigint>")


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first word of each row and the end) of a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(np.uint16).astype(np.int64), (offsets - offsets[0]) // 2


def targets(first: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Positions that round ``turn`` predicts: those of each document that are ``turn`` modulo ``rounds``."""
    at = np.arange(first[-1])
    within = at - np.repeat(first[:-1], np.diff(first))
    return at[within % rounds == turn]


def train(encoded: DataFrame, rounds: int = ROUNDS) -> Network:
    """Average, round by round, of the weights that each partition reaches on its own words."""
    net = Network()
    for turn in range(rounds):
        shared = encoded.sparkSession.sparkContext.broadcast(net.flat)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            own = Network(shared.value)
            speed = np.full(own.length, 0.1, np.float32)
            seen = 0
            for batch in batches:
                ids, first = _unpack(batch.column(0))
                where = targets(first, turn, rounds)
                for a in range(0, len(where), BATCH):
                    at = where[a : a + BATCH]
                    g = own.gradient(contexts(ids, first, at), ids[at]).flat
                    speed += (g * 100) ** 2
                    own.flat -= STEP / (turn + 1) * 100 * g / np.sqrt(speed)
                    seen += len(at)
            yield treesum.payload(np.concatenate((own.flat.astype(np.float64) * seen, [seen])))

        total = treesum.tree_sum(encoded.select("ids").mapInArrow(tidy(learn), treesum.SCHEMA), net.length + 1)
        shared.unpersist()
        # texts of a word or two give later rounds nothing
        if total[-1] > 0:
            net = Network(total[:-1] / total[-1])
    return net


def score(encoded: DataFrame, net: Network, id_col: str = "doc_id") -> DataFrame:
    """(id, row, known, n_words, log_likelihood) of every encoded document, the last by the ids of its words."""
    shared = encoded.sparkSession.sparkContext.broadcast(net.flat)
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(shared.value)
        for batch in batches:
            ids, first = _unpack(batch.column(2))
            logs = np.zeros(len(ids) + 1)
            for a in range(0, len(ids), CHUNK):
                at = np.arange(a, min(a + CHUNK, len(ids)))
                logs[at] = own.log_probs(contexts(ids, first, at), ids[at])
            n = np.diff(first)
            some = n > 0
            sums = np.zeros(len(n))
            if some.any():
                sums[some] = np.add.reduceat(logs, first[:-1][some])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(n.astype(np.int64)), pa.array(sums)], names=[id_col, "_siftline_row", "_siftline_known", "n_words", "log_likelihood"])

    return encoded.select("id", "row", "ids", "known").mapInArrow(tidy(run), f"`{id_col}` {kind}, _siftline_row bigint, _siftline_known double, n_words bigint, log_likelihood double")


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, log_likelihood, word_log_likelihood, mean_log, perplexity.

    ``log_likelihood`` is of the ids of the network, where rare words share
    some. ``word_log_likelihood`` is of the words themselves: it adds the log of
    each rare word's share of its id, by counts of all documents, which leave no
    word unseen. Means are of the words. Null texts and texts without words
    have 0 words, likelihood 0 and null means. Equal texts have equal scores
    within one call, up to rounding; another partitioning of the same documents
    averages other steps and gives somewhat other scores. Repeated rows are scored each; an empty table gives an empty
    result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    words, head, shares = vocabulary(scratch.table(word_counts(docs, text_col), "words"))
    encoded = scratch.table(_encoded(docs, words, head, id_col, text_col), "ids")
    rare = encoded.select(F.col("row").alias("_siftline_row"), F.explode("rare").alias("word")).join(shares, "word")
    rare = rare.groupBy("_siftline_row").agg(F.sum("log_share").alias("_siftline_rare"))
    out = score(encoded, train(encoded), id_col).join(rare, "_siftline_row", "left")
    total = F.col("log_likelihood") + F.col("_siftline_known") + F.coalesce("_siftline_rare", F.lit(0.0))
    out = out.withColumn("word_log_likelihood", total).drop("_siftline_row", "_siftline_known", "_siftline_rare")
    mean = F.col("word_log_likelihood") / F.nullif(F.col("n_words"), F.lit(0))
    return out.withColumn("mean_log", mean).withColumn("perplexity", F.exp(-mean))
