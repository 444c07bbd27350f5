"""URL rules and blocklists as a sorted digest array.

Rules and list entries become one file: sorted 64-bit xxhash keys, a verdict for
each, offsets, then the strings. Executors map the file into memory and probe
whole batches by binary search; a key that is found is confirmed by comparing
the stored string, so a collision never decides a URL. A URL asks for its host
and parent domains, each with those prefixes of its path whose lengths occur in
the file. Lists beyond ``FILE_BYTES`` are not shipped but joined by digest and
string instead.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_BYTES = 64 << 20
#: Seed of the digests, that of Spark's xxhash64.
SEED = 42
#: Verdict of list entries; rules have their positions.
LISTED = -1


@dataclass(frozen=True)
class Rule:
    """Verdict for a host, all its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str


#: Fixed rules.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def digest(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw, SEED)


class DigestArray:
    """Sorted digests with their values and strings in one memory-mapped file."""

    def __init__(self, path: str):
        n = int(np.memmap(path, np.uint64, "r", shape=(1,))[0])
        part = lambda kind, at, size: np.memmap(path, kind, "r", offset=at, shape=(size,)) if size else np.zeros(0, kind)
        self.keys = part(np.uint64, 8, n)
        self.values = part(np.int64, 8 + 8 * n, n)
        self.ends = part(np.uint64, 8 + 16 * n, n + 1)
        self.text = part(np.uint8, 16 + 24 * n, int(self.ends[-1]))

    @staticmethod
    def write(path: str, rows: Iterable[tuple[int, int, bytes]]) -> None:
        """Write (digest, value, string) rows that come in order of digest; strings go to the disk as they come."""
        keys, values, ends = array("Q"), array("q"), array("Q", [0])
        with open(f"{path}.text", "wb") as text:
            for key, value, raw in rows:
                keys.append(key)
                values.append(value)
                ends.append(ends[-1] + len(raw))
                text.write(raw)
        with open(path, "wb") as out:
            array("Q", [len(keys)]).tofile(out)
            for part in (keys, values, ends):
                part.tofile(out)
            with open(f"{path}.text", "rb") as text:
                shutil.copyfileobj(text, out)
        os.remove(f"{path}.text")

    def find(self, strings: list[bytes], digest=digest) -> list[list[int]]:
        """Values stored for each string."""
        keys = np.array([digest(s) for s in strings], np.uint64)
        first = np.searchsorted(self.keys, keys, "left")
        last = np.searchsorted(self.keys, keys, "right")
        out: list[list[int]] = [[] for _ in strings]
        for i in np.flatnonzero(last > first).tolist():
            out[i] = [int(self.values[k]) for k in range(first[i], last[i]) if self.text[int(self.ends[k]) : int(self.ends[k + 1])].tobytes() == strings[i]]
        return out


#: Rows of a batch of hosts with what they could be listed as.
EXPANDED = 1 << 12


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, ASCII lower-cased, and path after the first ``://``; both empty without it."""
    rest = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(rest) + 4, F.length(url))
    known = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, host).otherwise(""), F.when(known, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def candidates(host: str, path: str, lengths: list[int], most: int = 1 << 20) -> Iterator[str]:
    """The host and its parent domains of at most ``most`` labels, each with the prefixes of the path that have one of ``lengths``."""
    labels = host.rsplit(".", most)
    # what is left of the labels asked for has dots of its own and is no label
    labels = labels[1:] if len(labels) > most else labels
    for k in range(len(labels)):
        name = ".".join(labels[k:])
        for n in lengths:
            if n <= len(path):
                yield name + path[:n]


def judge(pages: DataFrame, blocked: Iterable[str] | DataFrame = (), rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    The longest rule that fits decides; ties go to the earlier one. Without a
    rule a page is blocked if its host or a parent domain is listed, or one of
    them with a leading part of its path that ends in a slash or with the path,
    else allowed. Null URLs and those without ``://`` have empty host and path
    and are allowed. Repeated rows are judged each; an empty table gives an empty
    result; other columns are not read. ``blocked`` is a list of strings, or a
    table with a column ``entry``, which is shipped as a file if it is small
    enough and else joined.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(x,) for x in blocked], "entry string")
    listed = blocked.where("entry is not null and entry <> ''").select("entry").distinct()
    size = listed.agg(F.coalesce(F.sum(F.octet_length("entry") + 24), F.lit(0)).alias("b")).first()["b"]
    if size > FILE_BYTES:
        return _joined(rows, listed, rules, id_col)
    return _probed(rows, listed, rules).select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block"), F.lit("allow")).alias("verdict"))


def path_lengths(listed: DataFrame, rules: tuple[Rule, ...] = ()) -> list[int]:
    """Lengths that the paths of entries and rules have; 0 for bare hosts."""
    found = listed.select(F.length(F.regexp_extract("entry", "(/.*)?$", 0)).alias("n")).distinct()
    return sorted({r["n"] for r in found.collect()} | {len(r.path) for r in rules})


def most_labels(listed: DataFrame, rules: tuple[Rule, ...] = ()) -> int:
    """Labels of the longest host among entries and rules; longer suffixes of a host meet nothing."""
    found = listed.select(F.size(F.split(F.regexp_extract("entry", "^([^/]*)", 1), r"\.")).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return max([found or 1, *(r.host.count(".") + 1 for r in rules)])


def _file(listed: DataFrame, rules: tuple[Rule, ...]) -> str:
    """Name of a shipped file of all entries and rules; sorted by Spark, it is written as its rows come."""
    spark = listed.sparkSession
    fixed = spark.createDataFrame([(r.host + r.path, k) for k, r in enumerate(rules)], "entry string, value long")
    rows = fixed.union(listed.select("entry", F.lit(LISTED).cast("long"))).withColumn("key", F.xxhash64("entry"))
    # digests are unsigned: those with the highest bit come last
    ordered = rows.orderBy(F.col("key") < 0, "key", "entry", "value")
    folder = tempfile.mkdtemp(prefix="siftline-urls-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"{os.path.basename(folder)}.digests")
    DigestArray.write(path, ((r["key"] % 2**64, r["value"], r["entry"].encode()) for r in ordered.toLocalIterator()))
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _probed(rows: DataFrame, listed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` with rule, ruled (its verdict) and listed."""
    name, lengths, most = _file(listed, rules), path_lengths(listed, rules), most_labels(listed, rules)
    kind = rows.schema["id"].dataType.simpleString()
    rank = {k: (len(r.host + r.path), -k) for k, r in enumerate(rules)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = (batch.column(k).to_pylist() for k in (1, 2))
            keys: list[bytes] = []
            owner: list[int] = []
            whole: list[bool] = []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                if h:
                    for key in candidates(h, p, lengths, most):
                        keys.append(key.encode())
                        owner.append(i)
                        # a list entry ends with its host, at a slash, or with the path
                        whole.append("/" not in key or key.endswith("/") or key.endswith(p))
            best: list[int | None] = [None] * len(hosts)
            listed = [False] * len(hosts)
            for values, i, fits in zip(known.find(keys), owner, whole):
                for v in values:
                    if v == LISTED:
                        listed[i] |= fits
                    elif best[i] is None or rank[v] > rank[best[i]]:
                        best[i] = v
            rule = [None if v is None else rules[v].host + rules[v].path for v in best]
            ruled = [None if v is None else rules[v].verdict for v in best]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(rule, pa.string()), pa.array(ruled, pa.string()), pa.array(listed, pa.bool_())], names=["id", "host", "path", "rule", "ruled", "listed"])

    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, ruled string, listed boolean")


def _joined(rows: DataFrame, listed: DataFrame, rules: tuple[Rule, ...], id_col: str) -> DataFrame:
    """The same verdicts for a list of any size: rules are probed, and distinct hosts and paths without one meet the list by digest and string."""
    lengths, most = path_lengths(listed), most_labels(listed)
    ruled = _probed(rows, listed.where(F.lit(False)), rules).drop("listed")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, str]] = []
            for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(h, p, k) for k in candidates(h, p, lengths, most) if "/" not in k or k.endswith("/") or k.endswith(p)]
                if len(out) >= EXPANDED:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["host", "path", "entry"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["host", "path", "entry"])

    keys = ruled.where("ruled is null and host <> ''").select("host", "path").distinct().mapInArrow(expand, "host string, path string, entry string")
    hit = keys.withColumn("digest", F.xxhash64("entry")).join(listed.withColumn("digest", F.xxhash64("entry")), ["digest", "entry"], "left_semi").select("host", "path").distinct()
    out = ruled.join(hit.withColumn("hit", F.lit("block")), ["host", "path"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "hit", F.lit("allow")).alias("verdict"))
