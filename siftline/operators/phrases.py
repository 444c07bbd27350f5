"""Which texts hold which phrases, for libraries and tables of any size.

Phrases are dealt by hash to slices of bounded size. Each slice becomes one
automaton (goto, failure and output tables) in every worker, and the texts pass
it once: equal phrases count once, nothing but (text key, phrase id) is shuffled,
and a library beyond one slice takes more passes over the texts, not more memory.
The automaton reads a batch as many lanes of bytes side by side; a lane begins
one phrase length early, so no match is lost between lanes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _cut

#: Bytes of phrases in a slice, and of a phrase in the automaton; what is longer is looked up whole where its head is found.
SLICE_BYTES, HEAD = 1 << 18, 128
#: Bytes of text scanned at a time, and lanes they are read in.
SCAN_BYTES, LANES = 1 << 22, 1 << 13
#: A byte that no UTF-8 text has; it stands between texts.
GAP = b"\xff"


class Automaton:
    """Finds all of some distinct, non-empty byte strings."""

    def __init__(self, phrases: list[bytes]):
        self.phrases = phrases
        heads = [p[:HEAD] for p in phrases]
        flat = np.frombuffer(b"".join(heads), np.uint8)
        size = np.array([len(h) for h in heads], np.int64)
        begin = np.cumsum(size) - size
        used = np.unique(flat)
        self.code = np.zeros(256, np.int64)
        self.code[used] = np.arange(1, len(used) + 1)
        self.width, self.reach = len(used) + 1, int(size.max(initial=1))
        # the trie level by level: nodes of a level are the distinct (parent, byte) of the phrases that reach it
        node, levels, count = np.zeros(len(heads), np.int64), [], 1
        for depth in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > depth)
            ways, where = np.unique(node[live] * self.width + self.code[flat[begin[live] + depth]], return_inverse=True)
            node[live] = count + where
            levels.append((ways // self.width, ways % self.width, count + np.arange(len(ways))))
            count += len(ways)
        self.order = np.argsort(node, kind="stable")
        self.first = np.searchsorted(node[self.order], np.arange(count + 1))
        own = np.diff(self.first) > 0
        # a node goes where its failure goes, but to its children by their bytes
        goto, self.fail, self.link = np.zeros((count, self.width), np.int32), np.zeros(count, np.int64), np.zeros(count, np.int32)
        for parents, ways, nodes in levels:
            self.fail[nodes] = goto[parents, ways]
            goto[parents, ways] = nodes
            goto[nodes] = goto[self.fail[nodes]]
            self.link[nodes] = np.where(own[nodes], nodes, self.link[self.fail[nodes]])
        self.goto = goto.ravel()

    def _ends(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, node) of phrase ends; a node stands for all phrases on its chain of links."""
        lane = max(-(-len(flat) // LANES), 4 * self.reach)
        starts = np.arange(0, len(flat), lane)
        codes = np.zeros(self.reach + len(flat) + lane, np.int64)
        codes[self.reach : self.reach + len(flat)] = self.code[flat]
        state, at, nodes = np.zeros(len(starts), np.int64), [], []
        for step in range(1, self.reach + lane):
            state = self.goto[state * self.width + codes[starts + step]].astype(np.int64)
            if step >= self.reach and len(hit := np.flatnonzero(self.link[state])):
                at.append(starts[hit] + (step - self.reach))
                nodes.append(self.link[state[hit]])
        none = np.zeros(0, np.int64)
        return (np.concatenate(at), np.concatenate(nodes).astype(np.int64)) if at else (none, none)

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, phrase) numbers, each pair once."""
        none = np.zeros(0, np.int64)
        if not self.phrases or not texts:
            return none, none
        size = np.array([len(t) + 1 for t in texts], np.int64)
        at, nodes = self._ends(np.frombuffer(GAP.join(texts) + GAP, np.uint8))
        # once for each text and node, then along the links to the shorter phrases that end there too
        pairs = np.unique(np.searchsorted(np.cumsum(size), at, "right") << 32 | nodes)
        found = []
        while len(pairs):
            text, node = pairs >> 32, pairs & 0xFFFFFFFF
            n = self.first[node + 1] - self.first[node]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.repeat(text, n) << 32 | self.order[np.repeat(self.first[node], n) + within])
            after = self.link[self.fail[node]].astype(np.int64)
            pairs = np.unique((text << 32 | after)[after > 0])
        if not found:
            return none, none
        pairs = np.unique(np.concatenate(found))
        text, phrase = pairs >> 32, pairs & 0xFFFFFFFF
        keep = np.array([len(self.phrases[p]) <= HEAD or self.phrases[p] in texts[t] for t, p in zip(text.tolist(), phrase.tolist(), strict=True)], bool)
        return text[keep], phrase[keep]


def numbered(phrases: DataFrame, phrase: str) -> DataFrame:
    """(phrase, phrase_id) of the distinct phrases; null and empty ones are none."""
    wanted = phrases.select(phrase).where(F.col(phrase) != "").distinct()
    return _cut(wanted.withColumn("phrase_id", F.monotonically_increasing_id()))


def _pass(texts: DataFrame, library: list, key_type: str) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(library)  # one slice: bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Automaton([p.encode() for p, _ in shared.value])
        ids = np.array([i for _, i in shared.value], np.int64)
        for batch in batches:
            column, begin, held, n = batch.column(1), 0, [], 0
            for row in range(batch.num_rows + 1):
                if row == batch.num_rows or n >= SCAN_BYTES:
                    text, phrase = found.search(held)
                    if len(text):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + begin)), pa.array(ids[phrase])], names=["key", "phrase_id"])
                    begin, held, n = row, [], 0
                if row < batch.num_rows:
                    held.append((column[row].as_py() or "").encode())
                    n += len(held[-1])

    out = _cut(texts.mapInArrow(run, f"key {key_type}, phrase_id bigint"))
    shared.unpersist()
    return out


def holders(texts: DataFrame, library: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """(key, phrase_id) for each row of ``texts`` and each phrase of ``library`` (see :func:`numbered`) that stands in its text.

    Comparison is by bytes; null texts hold nothing; a row is listed once for
    each phrase, rows of equal keys each. Long texts are read in lanes, so they
    cost what their bytes cost.
    """
    size = F.octet_length(phrase)
    total = library.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    slices = max(1, -(-total // SLICE_BYTES))
    library = library.withColumn("slice", F.pmod(F.xxhash64(phrase), F.lit(slices)))
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    key_type = rows.schema["key"].dataType.simpleString()
    out = None
    for k in range(slices):
        own = [(r[0], r[1]) for r in library.where(F.col("slice") == k).select(phrase, "phrase_id").collect()]
        if own or (k == slices - 1 and out is None):
            hits = _pass(rows, own, key_type)
            out = hits if out is None else out.unionByName(hits)
    return out.withColumnRenamed("key", key)
