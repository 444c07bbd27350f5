"""File-level plans: source hashes, exclusion plans, rule validity, caches and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import ordered_scan

# Fixed lists.
TEST_DIRS = ("test", "tests", "__tests__", "spec")
ENTRY_NAMES = ("main", "app", "server", "index", "router", "routes", "controller", "handler", "views", "api")


def source_hash(files: DataFrame, path: str = "path", modified: str = "mtime", size: str = "size") -> DataFrame:
    """One row: a hash of all names, times and sizes in order of path.

    Rows are hashed where they are, then per bucket, so no task holds all names.
    """
    rows = files.select(F.col(path).alias("p"), F.sha2(F.concat_ws(":", path, F.col(modified).cast("string"), F.col(size).cast("string")), 256).alias("h"))
    buckets = rows.groupBy(F.left(F.sha2("p", 256), F.lit(3)).alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("h"), F.count("*").alias("n"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("source_hash"), F.sum("n").alias("files"))


def kept_files(files: DataFrame, languages: list[str], http_endpoints: int, path: str = "path", language: str = "language") -> DataFrame:
    """Files that an exclusion plan leaves: wanted languages, no tests, and no static assets where there is no endpoint."""
    parts = F.split(F.lower(path), "/")
    keep = F.col(language).isin(languages) & ~F.arrays_overlap(parts, F.array(*map(F.lit, TEST_DIRS)))
    if http_endpoints == 0:
        keep = keep & ~F.regexp_like(F.lower(path), F.lit(r"/(static|public|assets)/"))
    return files.where(keep)


def prioritised(files: DataFrame, limit: int = 50, path: str = "path", seq: str = "input_seq") -> DataFrame:
    """Entry-like files first, then the others in order, up to the limit."""
    stem = F.regexp_extract(F.lower(path), r"([a-z_]+)\.[a-z]+$", 1)
    return files.withColumn("is_entry", stem.isin(*ENTRY_NAMES)).orderBy(F.desc("is_entry"), seq).limit(limit)


def rule_validity(pattern: Column, has_either: Column, has_inside: Column) -> Column:
    """valid where a rule has structure (metavariables, ellipses, alternatives, context), else literal_only."""
    structural = F.regexp_like(pattern, F.lit(r"\$[A-Z][A-Z0-9_]*|\.\.\.|\$\{|\(.*\)\s*=>"))
    return F.when(structural | has_either | has_inside, "valid").otherwise("literal_only")


def live(cache: DataFrame, as_of: Column, expires: str = "expires_at") -> DataFrame:
    """Entries not yet expired; those without a time never expire."""
    return cache.where(F.col(expires).isNull() | (F.col(expires) > as_of))


def token_bucket(requests: DataFrame, rate: float, burst: float, key: str = "user_id", ts: str = "seconds", seq: str = "event_id") -> DataFrame:
    """(key, seq, allowed, left): each request takes a token if one is there; tokens refill by time up to the burst.

    The recurrence is sequential per key and streams over that key's requests in order.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        left, last = state
        name, now = row
        have = min(float(burst), left + (now - (now if last is None else last)) * rate)
        left = have - 1 if have >= 1 else have
        return (left, now), (name, have >= 1, round(left, 6))

    kinds = dict(requests.dtypes)
    rows = requests.withColumn("_t", F.col(ts).cast("double"))
    return ordered_scan(rows, key, ["_t", seq], [seq, "_t"], lambda: (float(burst), None), step, f"{key} {kinds[key]}, {seq} {kinds[seq]}, allowed boolean, left double")


def unexpired(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Rows whose lifetime reaches past the latest time in the table."""
    now = df.agg(F.max(ts).alias("_now"))
    return df.crossJoin(F.broadcast(now)).where(F.col(ts) + F.make_interval(secs=F.lit(seconds)) > F.col("_now")).drop("_now")
