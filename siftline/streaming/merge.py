"""A keyed table that streams merge into, by buckets that are copied when written.

Rows are hashed to buckets by their key. A batch rewrites only the buckets that
its keys fall in, as new files; a manifest names the files of every bucket and is
put in place by one rename. A reader keeps the manifest it began with, so it
sees one version whatever is written meanwhile. One stream writes a table.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Manifest:
    """``files`` maps a bucket to the version that wrote it last; ``batches`` are those applied."""

    version: int
    buckets: int
    files: dict[str, int]
    batches: list[int]


class MergedTable:
    """A table below ``path`` with one row per ``key``; of two rows of a key the one of the greater ``sequence`` counts.

    ``updated`` are the columns that a later row replaces; others keep what the
    first row of the key brought, and all are replaced where it is not given.
    Rows of equal sequence: the later batch's counts, inside a batch the greater
    row. ``buckets`` holds for the table's life: take as many as make a bucket a
    task's work.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, sequence: str, updated: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.key, self.sequence, self.updated, self.buckets = spark, path.rstrip("/"), key, sequence, updated, buckets

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The manifest of a version, the last one if none is named."""
        system, root = self._files()
        found = system.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
        versions = sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))
        if not versions:
            return None
        own = versions[-1] if version is None else version
        return Manifest(**json.loads(system.open_input_stream(f"{root}/manifests/{own}.json").read()))

    def _commit(self, manifest: Manifest) -> None:
        system, root = self._files()
        system.create_dir(f"{root}/manifests", recursive=True)
        with system.open_output_stream(f"{root}/manifests/{manifest.version}.tmp") as out:
            out.write(json.dumps(vars(manifest)).encode())
        system.move(f"{root}/manifests/{manifest.version}.tmp", f"{root}/manifests/{manifest.version}.json")

    def _read(self, manifest: Manifest, buckets: list[str] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/data/v{v}/_bucket={b}" for b, v in manifest.files.items() if buckets is None or b in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """Rows of a version, the last one if none is named; None before the first."""
        manifest = self.manifest(version)
        return manifest and self._read(manifest)

    def _bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(count)).cast("int")

    def merge(self, batch: DataFrame, number: int) -> int:
        """Merge a batch; one whose number was applied changes nothing. Gives the version after it.

        Null keys are no rows. The batch's last rows per key are found before the
        shuffle; only touched buckets are read and written.
        """
        last = self.manifest() or Manifest(-1, self.buckets, {}, [])
        if number in last.batches:
            return last.version
        columns = batch.columns
        newest = F.max_by(F.struct(*columns), F.struct(F.col(self.sequence), F.struct(*columns)))
        new = batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(newest.alias("row")).select("row.*").withColumn("_bucket", self._bucket(last.buckets))
        # read once to find the buckets, once to be merged
        new = new.persist()
        try:
            touched = sorted(str(r[0]) for r in new.select("_bucket").distinct().collect())
            old = self._read(last, touched)
            version = last.version + 1
            rows = new if old is None else self._merged(old, new.drop("_bucket"), last.buckets)
            if touched:
                rows.repartition(min(len(touched), 1 << 12), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/v{version}")
            self._commit(Manifest(version, last.buckets, last.files | dict.fromkeys(touched, version), [*last.batches[-999:], number]))
        finally:
            new.unpersist()
        return version

    def _merged(self, old: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
        both = old.select(self.key, F.struct(*old.columns).alias("_old")).join(new.select(self.key, F.struct(*new.columns).alias("_new")), self.key, "full")
        later = F.col("_old").isNull() | (F.col(f"_new.{self.sequence}") >= F.col(f"_old.{self.sequence}"))
        changed = set(self.updated or old.columns) | {self.sequence}
        value = lambda c: F.when(F.col("_new").isNotNull() & (later if c in changed else F.col("_old").isNull()), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
        rows = both.select(self.key, *[value(c).alias(c) for c in old.columns if c != self.key])
        return rows.select(*old.columns).withColumn("_bucket", self._bucket(buckets))

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a batch that a restart runs again changes nothing."""

        def merge(batch: DataFrame, number: int) -> None:
            self.merge(batch, number)

        return merge

    def vacuum(self, keep: int = 2) -> list[int]:
        """Drop all but the last ``keep`` manifests and the data that only they name; gives the data versions dropped."""
        system, root = self._files()
        last = self.manifest()
        kept = [self.manifest(v) for v in range(max(0, last.version - keep + 1), last.version + 1)]
        named = {v for m in kept for v in m.files.values()}
        found = system.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True))
        gone = sorted(v for f in found if (v := int(f.base_name[1:])) not in named and v <= last.version)
        for v in gone:
            system.delete_dir(f"{root}/data/v{v}")
        for v in range(kept[0].version - 1, -1, -1):
            name = f"{root}/manifests/{v}.json"
            if system.get_file_info(name).type != fs.FileType.File:
                break
            system.delete_file(name)
        return gone
