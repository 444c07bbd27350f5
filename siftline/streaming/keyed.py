"""Keyed state on streams: debates round by round, token buckets, expiring entries.

Each operator is a stateful processor over a grouped stream. Its state is bounded
per key, survives a restart from the query's checkpoint, and is cleared by a
timer once it no longer matters. Keys of buckets and caches share groups by hash,
as a call into Python costs far more than a row. State stores are RocksDB, as value, list and
timer state need.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.graph import shared_folder

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
# Fixed limits of a debate.
MIN_ROUNDS, MAX_ROUNDS = 1, 5
CONFIDENT, DECISIVE_CONFIDENCE, DECISIVE_GAP, STRENGTH_GAP = 0.85, 0.7, 0.3, 0.35
DECISIVE = ("confirmed", "false_positive")
STABLE_ROUNDS, PROGRESS_WINDOW, LEAST_PROGRESS, TOKEN_LIMIT = 2, 2, 0.05, 50_000
ROUND = "round int, verdict string, confidence double, attack double, defence double, attacker string, defender string, tokens bigint"
NAMES = [c.split()[0] for c in ROUND.split(", ")]
HOUR_MS = 3_600_000


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def decide(n: int, row: tuple, facts: dict) -> str | None:
    """Why a debate ends with its ``n``-th round, by the first limit that holds; null to go on. ``facts`` is brought up to the round."""
    _, verdict, confidence, attack, defence, attacker, defender, tokens = row
    facts["tokens"] += int(tokens or 0)
    facts["history"] = (*facts["history"], confidence)[-(PROGRESS_WINDOW + 1) :]
    for side, name in (("attacker", attacker), ("defender", defender)):
        if name is not None:
            facts[f"{side}_stable"] = facts[f"{side}_stable"] + 1 if name in facts[side] else 0
            facts[side] = facts[side] | {name}
    gap, past = abs(attack - defence), facts["history"]
    if n < MIN_ROUNDS:
        return None
    if n >= MAX_ROUNDS:
        return "max_rounds"
    if confidence >= CONFIDENT:
        return "high_confidence"
    if verdict in DECISIVE and confidence >= DECISIVE_CONFIDENCE and gap >= DECISIVE_GAP:
        return "decisive_verdict"
    if gap >= STRENGTH_GAP:
        return "strength_gap"
    if min(facts["attacker_stable"], facts["defender_stable"]) >= STABLE_ROUNDS:
        return "strategy_stable"
    if len(past) > PROGRESS_WINDOW and max(past[1:]) <= past[0] + LEAST_PROGRESS:
        return "no_progress"
    return "cost_limit" if facts["tokens"] >= TOKEN_LIMIT else None


class Debate(StatefulProcessor):
    """Decisions of one finding's debate, in the order of rounds whatever the order of arrival.

    Rounds that come before one that is missing wait in list state. A debate has
    at most MAX_ROUNDS rounds, so its facts are bounded; once it has ended only
    that is kept, and what still comes is passed over. An idle debate is decided
    by what has come, without the missing rounds, and closed.
    """

    def __init__(self, first: int, idle_ms: int):
        self.first, self.idle_ms = first, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROUND)
        self.facts = handle.getValueState("facts", "n int, next int, ended boolean, tokens bigint, history array<double>, attacker array<string>, defender array<string>, attacker_stable int, defender_stable int")

    def _read(self) -> dict:
        if not self.facts.exists():
            return {"n": 0, "next": self.first, "ended": False, "tokens": 0, "history": (), "attacker": frozenset(), "defender": frozenset(), "attacker_stable": 0, "defender_stable": 0}
        n, after, ended, tokens, history, attacker, defender, a, d = self.facts.get()
        return {"n": n, "next": after, "ended": ended, "tokens": tokens, "history": tuple(history), "attacker": frozenset(attacker), "defender": frozenset(defender), "attacker_stable": a, "defender_stable": d}

    def _write(self, f: dict) -> None:
        self.facts.update((f["n"], f["next"], f["ended"], f["tokens"], list(f["history"]), sorted(f["attacker"]), sorted(f["defender"]), f["attacker_stable"], f["defender_stable"]))

    def _advance(self, key: tuple, waiting: list[tuple], facts: dict, gaps: bool) -> Iterator[pd.DataFrame]:
        out = []
        waiting = sorted(waiting, key=lambda r: tuple((v is not None, v) for v in r))
        while waiting and not facts["ended"] and (gaps or waiting[0][0] <= facts["next"]):
            row = waiting.pop(0)
            if row[0] < facts["next"]:
                continue
            facts["n"], facts["next"] = facts["n"] + 1, row[0] + 1
            reason = decide(facts["n"], row, facts)
            facts["ended"] = reason is not None
            out.append((key[0], row[0], facts["n"], facts["ended"], reason, facts["tokens"]))
        if facts["ended"]:
            waiting = []
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        self._write(facts)
        if out:
            yield pd.DataFrame(out, columns=["finding_id", "round", "n", "ended", "reason", "tokens"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        facts = self._read()
        if facts["ended"]:
            return
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        for frame in rows:
            for r in frame[NAMES].itertuples(index=False):
                waiting.append((int(r.round), _text(r.verdict), float(r.confidence), float(r.attack), float(r.defence), _text(r.attacker), _text(r.defender), int(r.tokens)))
        yield from self._advance(key, waiting, facts, gaps=False)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not facts["ended"]:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        facts = self._read()
        if not facts["ended"]:
            yield from self._advance(key, list(self.waiting.get()) if self.waiting.exists() else [], facts, gaps=True)
            if not facts["ended"]:
                facts["ended"] = True
                self._write(facts)
                yield pd.DataFrame([(key[0], None, facts["n"], True, "idle", facts["tokens"])], columns=["finding_id", "round", "n", "ended", "reason", "tokens"])

    def close(self) -> None:
        pass


def debate_decisions(rounds: DataFrame, first: int = 0, idle_ms: int = 24 * HOUR_MS) -> DataFrame:
    """(finding_id, round, n, ended, reason, tokens) for each round up to the one that ends its debate.

    ``rounds`` is a stream of finding_id and the columns of ROUND, one row per
    round from ``first`` on, in any order. A round that comes twice counts once.
    """
    rows = rounds.select("finding_id", *[F.col(c.split()[0]).cast(c.split()[1]) for c in ROUND.split(", ")])
    kind = rows.schema["finding_id"].dataType.simpleString()
    schema = f"finding_id {kind}, round int, n int, ended boolean, reason string, tokens bigint"
    return rows.groupBy("finding_id").transformWithStateInPandas(Debate(first, idle_ms), schema, "Append", "ProcessingTime")


class Grouped(StatefulProcessor):
    """Keys that share a group: one call, one list of state and one timer for all of them, so a batch costs a pass over its rows, not a call a key.

    A key holds (first, second, due); from the event time ``due``, in ms, on it no longer matters and is dropped.
    """

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"key {self.kind}, first bigint, second bigint, due bigint")

    def take(self, frame: pd.DataFrame, held: dict, now: int) -> list[tuple]:
        """Rows out of rows in, in order; ``held`` is brought up to them."""
        raise NotImplementedError

    def drop(self, key: object, first: int) -> list[tuple]:
        """Rows out of a key that is dropped."""
        return []

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def _read(self) -> dict:
        return {key: tuple(rest) for key, *rest in self.held.get()} if self.held.exists() else {}

    def _timer(self, held: dict) -> int | None:
        return min((due for _, _, due in held.values()), default=None)

    def _end(self, held: dict, now: int, timer: int | None, out: list[tuple]) -> Iterator[pd.DataFrame]:
        for key in [k for k, (_, _, due) in held.items() if due <= now]:
            out += self.drop(key, held.pop(key)[0])
        if held:
            self.held.put([(key, *rest) for key, rest in held.items()])
        else:
            self.held.clear()
        after = self._timer(held)
        if after != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if after is not None:
                self.handle.registerTimer(after)
        if out:
            yield self.frame(out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), self._read()
        timer = self._timer(held)
        out = self.take(pd.concat(list(rows)).sort_values(["at", "seq"]), held, now)
        yield from self._end(held, now, timer, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the timer that has come is removed by Spark
        yield from self._end(self._read(), timerValues.getCurrentWatermarkInMs(), None, [])

    def close(self) -> None:
        pass


def _grouped(rows: DataFrame, processor: Callable[[str], Grouped], out: str, groups: int) -> DataFrame:
    """``rows`` (key, ...) through a processor of ``groups`` groups of keys; ``out`` is the schema after the key."""
    kind = dict(rows.dtypes)["key"]
    # a column of whole numbers with a null would reach Python as floats
    inner = kind if kind in ("string", "binary") else "string"
    rows = rows.withColumns({"key": F.col("key").cast(inner), "_group": F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")})
    done = rows.groupBy("_group").transformWithStateInPandas(processor(inner), f"key {inner}, {out}", "Append", "EventTime")
    return done.withColumn("key", F.col("key").cast(kind))


class Bucket(Grouped):
    """Requests of keys against a bucket each that refills by event time; a request of an earlier time than the last refills nothing.

    The level is time: microseconds of refill, exact integers. A key is dropped
    when its bucket is full again, since a new one is full too.
    """

    def __init__(self, kind: str, per_token: int, capacity: int):
        super().__init__(kind)
        self.per_token, self.full = per_token, per_token * capacity

    def take(self, frame: pd.DataFrame, held: dict, now: int) -> list[tuple]:
        out = []
        for key, at, seq in zip(frame["key"].tolist(), frame["at"].tolist(), frame["seq"].tolist(), strict=True):
            level, last, _ = held.get(key) or (self.full, at, 0)
            if at > last:
                level, last = min(self.full, level + at - last), at
            allowed = level >= self.per_token
            level -= self.per_token * allowed
            held[key] = (level, last, max((last + self.full - level) // 1000 + 1, now + 1))
            out.append((key, seq, allowed, level // self.per_token))
        return out

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "seq", "allowed", "left"])


def token_bucket_stream(requests: DataFrame, rate: float, capacity: int, key: str, ts: str, seq: str, late: str = "1 hour", groups: int = 1024) -> DataFrame:
    """(key, seq, allowed, left): whether a token was there for each request, and whole tokens left after it.

    Rows older than the watermark, ``late`` behind the newest time seen, are dropped.
    """
    rows = requests.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    rows = rows.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.unix_micros("_ts").alias("at"), "_ts")
    out = _grouped(rows, lambda kind: Bucket(kind, round(1_000_000 / rate), capacity), f"seq {dict(rows.dtypes)['seq']}, allowed boolean, left bigint", groups)
    return out.withColumnsRenamed({"key": key, "seq": seq})


class Cache(Grouped):
    """Keys of a cache: a put stores, a get hits while the entry lives; a timer drops the entry after its life and says so."""

    def __init__(self, kind: str, life: int):
        super().__init__(kind)
        self.life = life

    def take(self, frame: pd.DataFrame, held: dict, now: int) -> list[tuple]:
        out = []
        for key, at, seq, put in zip(frame["key"].tolist(), frame["at"].tolist(), frame["seq"].tolist(), frame["put"].tolist(), strict=True):
            source, until, _ = (seq, at + self.life, 0) if put else held.get(key) or (None, None, 0)
            if source is not None:
                held[key] = (source, until, max(until // 1000 + 1, now + 1))
            alive = source is not None and at <= until
            out.append((key, seq, "put" if put else "hit" if alive else "miss", source if alive else None))
        return out

    def drop(self, key: object, first: int) -> list[tuple]:
        return [(key, first, "expired", first)]

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "seq", "outcome", "source"]).astype({"source": "Int64"})


def cache_stream(requests: DataFrame, life_seconds: int, key: str, ts: str, seq: str, put: str, late: str = "1 hour", groups: int = 1024) -> DataFrame:
    """(key, seq, outcome, source) of puts and gets: put, hit with the put that served it, miss; and one row expired for each entry dropped.

    An entry lives through its ``life_seconds``; a put renews it. Rows older than
    the watermark are dropped.
    """
    rows = requests.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    rows = rows.select(F.col(key).alias("key"), F.col(seq).cast("bigint").alias("seq"), F.col(put).alias("put"), F.unix_micros("_ts").alias("at"), "_ts")
    out = _grouped(rows, lambda kind: Cache(kind, life_seconds * 1_000_000), "seq bigint, outcome string, source bigint", groups)
    return out.withColumnsRenamed({"key": key, "seq": seq})


def run_steps(steps: list[DataFrame], operator: Callable[[DataFrame], DataFrame], idle_batches: bool = True) -> DataFrame:
    """What ``operator`` makes of a stream that is given ``steps`` one after the other.

    Each step is written below the shared folder and read by a query of its own
    that starts from the checkpoint of the one before, so every step is a restart
    and state passes through the checkpoint. The file sink keeps each batch once.
    ``idle_batches`` carry the watermark on after the last data of a step; state
    by processing time would ask for them without end, so it does without.
    """
    spark: SparkSession = steps[0].sparkSession
    root = f"{shared_folder(spark)}/siftline-stream-{uuid.uuid4().hex}"
    settings = {STORE: ROCKS, IDLE_BATCHES: str(idle_batches).lower()}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        for k, step in enumerate(steps):
            step.write.parquet(f"{root}/in/step{k}")
            stream = spark.readStream.schema(steps[0].schema).parquet(f"{root}/in/step*")
            query = operator(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)
    return spark.read.parquet(f"{root}/out")


def in_order(df: DataFrame, ts: str, steps: int) -> list[DataFrame]:
    """``df`` cut into steps of about equal size by the order of a time; only the bounds reach the driver."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    bounds = df.agg(F.percentile_approx(at, [k / steps for k in range(1, steps)], 1000).alias("b")).first()["b"] or []
    step = sum((F.when(at > b, 1).otherwise(0) for b in bounds), F.lit(0))
    return [df.where(step == k) for k in range(steps)]
