"""Merkle fixity audit of WARC records.

Records are laid out in segments, in order of a hash of their ids, so every
node of a segment's tree, named by the leading digits of that hash, covers one
range of offsets. A leaf hashes its records' digests, an inner node its
children's digests together with the bytes they cover. Ranges count from their
node's begin, so a record lost or added changes the nodes above it and no other.
Two replicas are compared from their roots down: only nodes below a mismatching
parent are looked at, so the cost of a comparison follows the damage. Records of
mismatching leaves are matched by digest, then by id, then by what stands before
them, so what follows a loss, or a header that cannot be read, is sound again.
The tree and its comparison are DataFrame functions; files are parsed in Python.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Hex digits of the hash that name a leaf; one digit a level, so nodes have 16 children.
LEVELS = 3
#: Records and bytes that a segment holds on average.
SEGMENT_ROWS = 1024
SEGMENT_BYTES = 64 << 20
END = "\r\n\r\n"
_BEGIN = b"WARC/1.0\r\nWARC-Type: "
_FIELDS = ("id", "segment", "seq", "offset", "length", "digest")


def record(id_: Column, url: Column, body: Column) -> Column:
    """A WARC response record, without the blank lines that end it."""
    lines = ["WARC/1.0", "WARC-Type: response"]
    head = F.concat(
        F.lit("\r\n".join(lines) + "\r\nWARC-Record-ID: <urn:page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " "),
        F.lit("\r\nContent-Length: "), F.octet_length(F.coalesce(body, F.lit(""))).cast("string"), F.lit(END),
    )
    return F.concat(head, F.coalesce(body, F.lit("")))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, record, digest) of every page; null ids, URLs and bodies count as empty."""
    rows = pages.select(F.col(id_col).alias("id"), record(F.col(id_col), F.col(url_col).cast("string"), F.col(body_col).cast("string")).alias("record"))
    return rows.withColumn("digest", F.sha2("record", 256))


def _text(id_: Column) -> Column:
    return F.coalesce(id_.cast("string"), F.lit(""))


def lay_out(rows: DataFrame) -> DataFrame:
    """(id, segment, seq, offset, length, digest) of every record of :func:`records`: the manifest.

    A hash of id, digest and the number of the copy deals records to segments,
    so repeated rows are records of their own and spread like all others; inside
    a segment records stand in order of the hash of the id, then digest, then
    copy. Only digests travel. An empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession)
    own = rows.select("id", "digest", (F.octet_length("record").cast("bigint") + len(END)).alias("length"))
    own = scratch.table(own.groupBy("id", "digest", "length").agg(F.count("*").alias("copies")), "digests")
    size = own.agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("length")).alias("bytes")).first()
    segments = max(-(-(size["n"] or 0) // SEGMENT_ROWS), -(-(size["bytes"] or 0) // SEGMENT_BYTES), 1)
    own = own.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    dealt = F.md5(F.concat_ws("|", _text(F.col("id")), "digest", F.col("copy").cast("string")))
    own = own.withColumn("segment", F.conv(F.left(dealt, F.lit(8)), 16, 10).cast("bigint") % segments).withColumn("spot", F.md5(_text(F.col("id"))))
    order = Window.partitionBy("segment").orderBy("spot", "id", "digest", "copy")
    own = own.withColumn("seq", (F.row_number().over(order) - 1).cast("bigint"))
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    return own.withColumn("offset", offset).select(*_FIELDS)


def write_segments(manifest: DataFrame, rows: DataFrame, path: str) -> None:
    """Write the records of a manifest as WARC files, one per segment, in order of offset."""
    texts = rows.select("id", "digest", "record").groupBy("id", "digest").agg(F.first("record").alias("record"))
    same = manifest["id"].eqNullSafe(texts["id"]) & (manifest["digest"] == texts["digest"])
    lines = manifest.join(texts, same).select("segment", "seq", F.col("record").alias("value"))
    lines.repartition("segment").sortWithinPartitions("segment", "seq").select("segment", "value").write.partitionBy("segment").option("lineSep", END).text(path)


def parse_segment(raw: bytes) -> Iterator[tuple[int | None, int, int, int, str, str]]:
    """(id, seq, offset, length, digest, record) of the records of a file, whatever is damaged in it.

    Where a header cannot be read, or its length does not lead to the blank
    lines that end a record, everything up to the next header counts as one
    record, with the id if that is legible. Bytes that are no UTF-8 are replaced
    in the text only; digests are of the bytes.
    """
    end_mark = END.encode()
    at = seq = 0
    while at < len(raw):
        head = raw.find(end_mark, at)
        fields = raw[at : head if head >= 0 else len(raw)]
        size = re.search(rb"\r\nContent-Length: (\d{1,15})$", fields)
        stop = head + len(end_mark) + int(size[1]) if size and head >= 0 else -1
        sound = raw.startswith(_BEGIN, at) and stop >= 0 and raw[stop : stop + len(end_mark)] == end_mark
        if sound:
            body, after = raw[at:stop], stop + len(end_mark)
        else:
            after = raw.find(_BEGIN, at + 1)
            after = after if after >= 0 else len(raw)
            body = raw[at:after]
        name = re.search(rb"<urn:page:(-?\d{1,18})>", fields if sound else body)
        yield int(name[1]) if name else None, seq, at, after - at, hashlib.sha256(body).hexdigest(), body.decode(errors="replace")
        at, seq = after, seq + 1


def read_segments(spark, path: str) -> DataFrame:
    """(id, segment, seq, offset, length, digest, record) of the WARC files below ``path``, parsed by :func:`parse_segment`."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        for batch in batches:
            for segment, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                out: list[tuple] = []
                for id_, *rest in parse_segment(raw.as_py()):
                    out.append((id_, segment, *rest))
                    if len(out) == SEGMENT_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[*_FIELDS, "record"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[*_FIELDS, "record"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    named = files.select(F.regexp_extract("path", r"segment=(\d+)", 1).cast("bigint").alias("segment"), "content")
    return named.mapInArrow(parse, "id bigint, segment bigint, seq bigint, offset bigint, length bigint, digest string, record string")


def trees(both: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Levels of (ours, segment, node, bytes, digest) of both replicas, roots first, leaves last; each is written."""
    child = F.struct("spot", "digest", "length")
    leaf = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["digest"], c["length"].cast("string"))), "|"), 256)
    levels = [scratch.table(both.groupBy("ours", "segment", "node").agg(F.sum("length").alias("bytes"), leaf.alias("digest")), "leaves")]
    for digits in reversed(range(LEVELS)):
        child = F.struct("node", F.concat_ws(":", "node", F.col("bytes").cast("string"), "digest").alias("text"))
        inner = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["text"]), "|"), 256)
        up = levels[0].groupBy("ours", "segment", F.left("node", F.lit(digits)).alias("up")).agg(F.sum("bytes").alias("bytes"), inner.alias("digest"))
        levels.insert(0, scratch.table(up.withColumnRenamed("up", "node"), f"level-{digits}"))
    return levels


def descend(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(segment, node) of the leaves that differ, found from the roots down."""
    bad = None
    for digits, level in enumerate(levels):
        if bad is not None:
            level = level.withColumn("up", F.left("node", F.lit(digits - 1))).join(bad.withColumnRenamed("node", "up"), ["segment", "up"], "left_semi")
        side = lambda ours: F.max(F.when(F.col("ours") == ours, F.struct("bytes", "digest")))
        sides = level.groupBy("segment", "node").agg(side(True).alias("a"), side(False).alias("b"))
        bad = scratch.table(sides.where(~F.col("a").eqNullSafe(F.col("b"))).select("segment", "node"), f"differ-{digits}")
    return bad


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every record of both replicas with its status: ok, damaged, missing or surplus.

    ``ours`` is the manifest, ``theirs`` a manifest or what :func:`read_segments`
    made of files. A record of another digest in place of one with the same id,
    or with the same neighbour before it, is damaged and listed once, as the
    manifest has it; one that only a replica has is missing, or surplus with its
    place in the second. A segment that one replica lacks is so record by record.
    Repeated records count one by one; two empty replicas give an empty result.
    """
    scratch = Scratch(ours.sparkSession)
    sides = [df.select(F.lit(flag).alias("ours"), *_FIELDS) for flag, df in ((True, ours), (False, theirs))]
    both = sides[0].unionByName(sides[1]).withColumn("spot", F.md5(_text(F.col("id"))))
    both = scratch.table(both.withColumn("node", F.left("spot", F.lit(LEVELS))), "records")
    bad = descend(trees(both, scratch), scratch)
    # only segments with damage are read again
    hit = both.join(bad.select("segment").distinct(), "segment", "left_semi")
    before = F.lag(F.concat("spot", "digest")).over(Window.partitionBy("ours", "segment").orderBy("seq"))
    hit = hit.withColumn("before", F.coalesce(before, F.lit("")))
    left = scratch.table(hit.join(bad, ["segment", "node"], "left_semi"), "differing")
    for keys in (["spot", "digest"], ["spot"], ["before"]):
        left = scratch.table(_paired(left, keys, "ok" if "digest" in keys else "damaged"), f"by-{'-'.join(keys)}")
    status = left.withColumn("status", F.coalesce("status", F.when(F.col("ours"), "missing").otherwise("surplus")))
    found = status.where("ours or status = 'surplus'").select("ours", "segment", "seq", "status")
    known = both.where("ours").join(found.where("ours").drop("ours"), ["segment", "seq"], "left")
    extra = both.where("not ours").join(found.where("not ours").drop("ours"), ["segment", "seq"])
    columns = [*_FIELDS, F.coalesce("status", F.lit("ok")).alias("status")]
    return known.select(*columns).unionByName(extra.select(*columns))


def _paired(rows: DataFrame, keys: list[str], status: str) -> DataFrame:
    """``rows`` with ``status`` set where the n-th record of a segment with these keys has a partner in the other replica."""
    if "status" not in rows.columns:
        rows = rows.withColumn("status", F.lit(None).cast("string"))
    free = rows.where("status is null")
    nth = Window.partitionBy("segment", *keys, "ours").orderBy("seq")
    free = free.withColumn("nth", F.row_number().over(nth))
    pair = Window.partitionBy("segment", *keys, "nth")
    free = free.withColumn("status", F.when(F.count("*").over(pair) == 2, status)).drop("nth")
    return rows.where("status is not null").unionByName(free)
