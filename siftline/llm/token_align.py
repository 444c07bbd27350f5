"""Alignment of two tokenizers over the bytes they share.

Token ends of both tokenizers are cumulative byte offsets, two sorted runs that
are merged: a text is cut where both end, which gives groups and the links
inside them. Long texts are taken in parts, cut where neither tokenizer's tokens
can cross (a single space or line feed between two non-spaces). Spark counts the
documents of each pair of ids and joins counts and per-side maxima back.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textscan import release

FOLDER = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A place that no token of either crosses, and characters before a part of a text ends at the next one.
SAFE, PART = re.compile(r"(?<=\S)(?=[ \n]\S)"), 1 << 16
#: The pattern by which the byte-level vocabulary cuts words (a fixed value), and runs of spaces too long for its matcher.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_SPACE = re.compile(r"\s{1000}")
#: Links of a group up to which they are laid out one by one; of larger groups only distinct pairs are, with counts.
LAID_OUT = 256
#: Rows of one output batch.
BATCH = 256
#: Pairs of ids, the most frequent ones, that may travel to every executor.
SHIPPED_PAIRS = 1 << 16
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_level() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, byte_json: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        import tokenizers

        spec, letters = json.loads(byte_json), byte_level()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        # the same vocabulary twice: the fast one, and one for texts that its matcher cannot take
        self.fast = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.steady = tokenizers.Tokenizer.from_str(byte_json)
        self.steady.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        self.long_a, self.long_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        #: Decimal ids with what follows: a comma, or at the end of a group's side | or ;.
        self.names = [f"{i}{end}" for n, last in ((len(self.bytes_a), "|"), (len(pieces), ";")) for i in range(n) for end in (",", last)]
        #: Whether no piece crosses the places where texts are cut.
        self.cuts = not any(re.search("[^▁]▁|\n", p) for p, byte in pieces if not byte)

    def parts(self, text: str) -> Iterator[str]:
        """``text`` after a space, in parts cut where neither tokenizer's tokens cross."""
        text, begin = " " + text, 0
        while self.cuts and len(text) - begin > PART and (found := SAFE.search(text, begin + PART)):
            yield text[begin : found.start()]
            begin = found.start()
        yield text[begin:]

    def encode(self, part: str) -> tuple[list[int], list[int]] | None:
        """Ids of both for a part, which begins with a space or a line feed; None where bytes are not kept."""
        if LONG_SPACE.search(part):
            a = self.steady.encode(part, add_special_tokens=False).ids
        else:
            a = self.fast.encode_ordinary(part)
        # the second tokenizer puts its space before a line feed too; no piece joins the two
        b = self.b.encode(part[1:]) if part[0] == " " else self.b.encode(part)[1:]
        raw = part.encode()
        if b"".join([self.bytes_a[t] for t in a]) != raw or b"".join([self.bytes_b[t] for t in b]) != raw:
            return None
        return a, b


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of either side before the end of each group: the runs of ends are merged, equal neighbours are ends of both."""
    both = np.concatenate((ends_a, ends_b))
    both.sort(kind="stable")
    ends = both[1:][both[1:] == both[:-1]]
    return np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1


def links(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, times): distinct linked id pairs, first id << 32 | second, and how many links each has."""
    first_a, first_b = np.concatenate(([0], last_a[:-1])), np.concatenate(([0], last_b[:-1]))
    n_a, n_b = last_a - first_a, last_b - first_b
    small = n_a * n_b <= LAID_OUT
    # each token of the first side meets the second side's tokens of its group, a run
    reps = np.repeat(np.where(small, n_b, 0), n_a)
    begin = np.repeat(first_b, n_a)
    step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    pairs, times = np.unique(np.repeat(a << 32, reps) | b[np.repeat(begin, reps) + step], return_counts=True)
    if small.all():
        return pairs, times
    more = [(pairs, times)]
    for g in np.flatnonzero(~small):
        x, m = np.unique(a[first_a[g] : last_a[g]], return_counts=True)
        y, n = np.unique(b[first_b[g] : last_b[g]], return_counts=True)
        more.append((((x << 32)[:, None] | y).ravel(), (m[:, None] * n).ravel()))
    return summed(more)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of all parts, their times added."""
    if len(parts) == 1:
        return parts[0]
    pairs, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    times = np.zeros(len(pairs), np.int64)
    np.add.at(times, where, np.concatenate([t for _, t in parts]))
    return pairs, times


def spelled(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, names: list[str], base: int) -> str:
    """Groups as text, each with a semicolon behind it."""
    end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    end_a[last_a - 1], end_b[last_b - 1] = 1, 1
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    words = np.empty(len(a) + len(b), np.int64)
    words[np.arange(len(a)) + np.concatenate(([0], last_b))[group_a]] = 2 * a + end_a
    words[np.arange(len(b)) + last_a[group_b]] = 2 * b + end_b + base
    return "".join([names[w] for w in words.tolist()])


def align_text(text: str | None, tokenizers: Tokenizers) -> tuple:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of a text."""
    none = np.zeros(0, np.int64)
    nothing = (0, 0, 0, 0, "", none, none)
    if not text:
        return nothing
    digest, held, n_a, n_b, n_groups, before = hashlib.sha256(), [], 0, 0, 0, ""
    for part in tokenizers.parts(text):
        ids = tokenizers.encode(part)
        if ids is None:
            return nothing
        a, b = (np.array(x, np.int64) for x in ids)
        last_a, last_b = groups(np.cumsum(tokenizers.long_a[a]), np.cumsum(tokenizers.long_b[b]))
        held.append(links(a, b, last_a, last_b))
        n_a, n_b, n_groups = n_a + len(a), n_b + len(b), n_groups + len(last_a)
        own = spelled(a, b, last_a, last_b, tokenizers.names, 2 * len(tokenizers.bytes_a))
        digest.update(before.encode() + own[:-1].encode())
        before = ";"
    pairs, times = summed(held)
    return n_a, n_b, n_groups, int(times.sum()), digest.hexdigest(), pairs, times


def aligned(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """id, counts, groups_sha256 and the distinct linked id pairs (first id << 32 | second id) with their links, per row of (id, text)."""
    spark = docs.sparkSession
    read = lambda name, mode: open(f"{folder}/{name}", mode).read()  # noqa: E731, SIM115
    models = spark.sparkContext.broadcast((read(BYTE_FILE, "r"), read(PIECE_FILE, "rb")))  # two files of fixed size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizers = Tokenizers(*models.value)
        for frame in frames:
            for begin in range(0, len(frame), BATCH):
                part = frame.iloc[begin : begin + BATCH]
                rows = [align_text(text, tokenizers) for text in part["text"]]
                yield pd.DataFrame(rows, columns=[*COUNTS, "groups_sha256", "pairs", "times"]).assign(id=part["id"].values)
        release()

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>, id {kind}"
    return docs.mapInPandas(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best_a, best_b): documents that hold a pair, and whether no pair of its first, or second, id has more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    a, b = F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # at most as many pairs to a window as the other vocabulary has ids
    most = lambda side: F.max("n").over(Window.partitionBy(side))
    return counts.withColumn("best_a", F.col("n") == most(a)).withColumn("best_b", F.col("n") == most(b))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum and groups_sha256 of every row.

    Texts that are null, empty or not kept byte by byte by a tokenizer have no
    tokens: zeros and ''. Repeated rows are documents each; null ids have a row
    too; very long texts are merged in parts, with the same result; an empty
    table gives an empty one; other columns are not read. Pairs that many
    documents hold are looked up in a table of at most SHIPPED_PAIRS rows, all
    others joined by pair, where no key is frequent any more.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    rows = aligned(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), folder)
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = scratch.table(pair_counts(rows), "pairs")
    head = scratch.table(pairs.orderBy(F.desc("n"), "pair").limit(SHIPPED_PAIRS), "head")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    seen = links.join(F.broadcast(head), "pair")
    rest = links.join(F.broadcast(head.select("pair")), "pair", "left_anti").join(pairs, "pair")
    sums = [F.sum(F.when(F.col("best_a"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.when(F.col("best_b"), F.col("times")).otherwise(0)).alias("n_best_b"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    found = seen.groupBy("row").agg(*sums)
    if pairs.count() > SHIPPED_PAIRS:
        again = [F.sum(c).alias(c) for c in ("n_best", "n_best_b", "count_sum")]
        found = found.unionByName(rest.groupBy("row").agg(*sums)).groupBy("row").agg(*again)
    out = rows.drop("pairs", "times").join(found, "row", "left")
    sums = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "n_best_b", "count_sum")]
    return out.select(F.col("id").alias(id_col), *COUNTS, *sums, "groups_sha256")
