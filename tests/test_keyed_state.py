import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftline.streaming import keyed

ROUNDS = f"finding_id long, {keyed.ROUND}"


def plain_debate(rounds):
    facts = {"tokens": 0, "history": (), "attacker": frozenset(), "defender": frozenset(), "attacker_stable": 0, "defender_stable": 0}
    out = []
    for n, row in enumerate(sorted(rounds), 1):
        reason = keyed.decide(n, row, facts)
        out.append((row[0], n, reason is not None, reason, facts["tokens"]))
        if reason:
            break
    return out


def test_debates_go_on_after_restarts_in_any_order(spark):
    rng = random.Random(7)
    rows = {f: [(k, rng.choice(["confirmed", "disputed", None]), rng.random() * 0.9, rng.random() * 0.5, rng.random() * 0.5, rng.choice(["a", "b", None]), rng.choice(["c", None]), rng.choice([10, 30_000])) for k in range(rng.randint(1, 8))] for f in range(25)}
    flat = [(f, *r) for f, own in rows.items() for r in own]
    rng.shuffle(flat)
    flat += flat[:10]
    steps = [spark.createDataFrame(flat[k::3], ROUNDS) for k in range(3)]
    out = keyed.run_steps(steps, keyed.debate_decisions, idle_batches=False)
    got = {}
    for r in out.collect():
        got.setdefault(r.finding_id, []).append(tuple(r)[1:])
    assert {f: sorted(v) for f, v in got.items()} == {f: plain_debate(own) for f, own in rows.items()}
    assert {v[-1][3] for v in map(plain_debate, rows.values())} >= {"max_rounds", "high_confidence", None}


def test_an_idle_debate_is_closed_without_its_missing_round(spark):
    row = lambda f, k: (f, k, None, 0.1 * k, 0.1, 0.1, None, None, 5)
    steps = [spark.createDataFrame([row(1, 0), row(1, 2)], ROUNDS), spark.createDataFrame([row(2, 0)], ROUNDS), spark.createDataFrame([row(1, 3), row(3, 0)], ROUNDS)]
    out = keyed.run_steps(steps, lambda s: keyed.debate_decisions(s, idle_ms=1), idle_batches=False).where("finding_id = 1").collect()
    assert sorted((r.n, -1 if r.round is None else r.round, r.reason) for r in out) == [(1, 0, None), (2, -1, "idle"), (2, 2, None)]


def plain_bucket(requests, per, full):
    level, last, out = full, None, []
    for at, seq in sorted(requests):
        level = full if last is None else min(full, level + at - last)
        last = at
        out.append((seq, level >= per))
        level -= per * (level >= per)
    return out


@pytest.mark.parametrize("steps", [1, 4])
def test_buckets_refill_by_event_time(spark, steps):
    rng = random.Random(3)
    zero = dt.datetime(2024, 1, 1)
    rows = [(i, i % 4, zero + dt.timedelta(milliseconds=rng.randrange(40_000_000))) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, user long, ts timestamp_ntz")
    out = keyed.run_steps(keyed.in_order(df, "ts", steps), lambda s: keyed.token_bucket_stream(s, 1 / 300, 3, "user", "ts", "seq"))
    got = {(r.user, r.seq): r.allowed for r in out.collect()}
    micros = lambda t: int((t - zero) / dt.timedelta(microseconds=1))
    want = {(u, s): ok for u in range(4) for s, ok in plain_bucket([(micros(t), i) for i, v, t in rows if v == u], 300_000_000, 900_000_000)}
    assert got == want and 0 < sum(want.values()) < 300


def test_entries_expire_and_late_rows_are_dropped(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "seq long, k string, ts timestamp_ntz, put boolean"
    steps = [[(1, "a", at(1), True), (2, "a", at(1, 30), False), (3, "b", at(1, 31), False)], [(4, "a", at(2), False), (5, "a", at(2, 1), False), (6, "c", at(9), True)], [(7, "a", at(2, 2), False), (8, "c", at(9, 10), True), (9, "c", at(10, 5), False)]]
    out = keyed.run_steps([spark.createDataFrame(s, schema) for s in steps], lambda s: keyed.cache_stream(s, 3600, "k", "ts", "seq", "put"))
    got = sorted((r.seq, r.outcome, r.source) for r in out.where(F.col("seq") > 0).collect())
    assert got == [(1, "expired", 1), (1, "put", 1), (2, "hit", 1), (3, "miss", None), (4, "hit", 1), (5, "miss", None), (6, "put", 6), (8, "put", 8), (9, "hit", 8)]


class FakeState(list):
    """List state and timers of one group, with the calls counted."""

    def __init__(self):
        self.puts, self.timers = 0, set()

    def getListState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return bool(self)

    def get(self):
        return iter(list(self))

    def put(self, rows):
        self.puts += 1
        self[:] = rows

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class At(int):
    getCurrentWatermarkInMs = int.__int__  # noqa: N815


@pytest.mark.parametrize("made", [lambda: keyed.Bucket("string", 10_000, 3), lambda: keyed.Cache("string", 30_000)])
def test_keys_of_a_group_share_one_call_and_one_timer(made):
    op, state = made(), FakeState()
    op.init(state)
    frame = pd.DataFrame({"key": [f"k{i}" for i in range(500)], "at": range(1_000_000, 1_500_000, 1000), "seq": range(500), "put": True})
    assert sum(map(len, op.handleInputRows((0,), iter([frame[:300], frame[300:]]), At(900)))) == 500
    assert (len(state), state.puts, len(state.timers)) == (500, 1, 1)
    # a timer drops every key that is due and stands at the next one
    now = min(state.timers)
    state.timers.remove(now)
    list(op.handleExpiredTimer((0,), At(now + 99), None))
    assert len(state) == 400 and state.timers == {min(row[3] for row in state)} and min(state.timers) > now + 99
    # rows of one key leave the others as they are, but for those that are due
    (out,) = op.handleInputRows((0,), iter([frame[499:].assign(at=1_500_000)]), At(now + 199))
    assert len(state) == 300 and len(state.timers) == 1 and out["seq"].tolist()[0] == 499
    assert len(out) == (101 if isinstance(op, keyed.Cache) else 1)


def test_keys_stay_exact_beside_a_null_key(spark):
    big = 2**53 + 1
    zero = dt.datetime(2024, 1, 1)
    rows = [(i, [big, big + 1, None][i % 3], zero + dt.timedelta(minutes=i), i < 3) for i in range(12)]
    df = spark.createDataFrame(rows, "seq long, k long, ts timestamp_ntz, put boolean")
    cache = keyed.run_steps(keyed.in_order(df, "ts", 2), lambda s: keyed.cache_stream(s, 300, "k", "ts", "seq", "put", groups=2)).where("outcome <> 'expired'")
    assert sorted(tuple(r) for r in cache.select("seq", "k", "outcome", "source").collect()) == [(i, rows[i][1], *(("put", i) if i < 3 else ("hit", i % 3) if i < 6 else ("miss", None))) for i in range(12)]
    bucket = keyed.run_steps([df], lambda s: keyed.token_bucket_stream(s, 1 / 3600, 2, "k", "ts", "seq", groups=1))
    assert sorted(tuple(r) for r in bucket.select("seq", "k", "allowed", "left").collect()) == [(i, rows[i][1], i < 6, max(0, 1 - i // 3)) for i in range(12)]
