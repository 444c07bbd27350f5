import random
from pathlib import Path

from siftline.streaming.merge import MergedTable

SCHEMA = "id long, seq long, stars long, title string"


def rows(df):
    return sorted(tuple(r) for r in df.select("id", "seq", "stars", "title").collect())


def test_last_writer_by_sequence_wins_and_replays_change_nothing(spark, tmp_path):
    table = MergedTable(spark, str(tmp_path / "t"), "id", "seq", ["stars"], buckets=8)
    rng = random.Random(2)
    held, batches = {}, []
    for n in range(4):
        batch = [(rng.randrange(40), rng.randrange(1000), n * 100 + k, f"t{n}-{k}") for k in range(30)] + [(None, 1, 1, "x")]
        batches.append(batch)
        newest = {}
        for r in batch:
            if r[0] is not None and (r[0] not in newest or (r[1], r) > (newest[r[0]][1], newest[r[0]])):
                newest[r[0]] = r
        for k, r in newest.items():
            old = held.get(k)
            held[k] = r if old is None else (k, r[1], r[2], old[3]) if r[1] >= old[1] else old
        assert table.merge(spark.createDataFrame(batch, SCHEMA), n) == n
        assert rows(table.read()) == sorted(held.values())
    assert table.merge(spark.createDataFrame([(1, 10**9, 0, "late")], SCHEMA), 2) == 3
    assert rows(table.read()) == sorted(held.values())


def test_untouched_buckets_keep_their_files_and_readers_their_version(spark, tmp_path):
    table = MergedTable(spark, str(tmp_path / "t"), "id", "seq", buckets=16)
    table.merge(spark.createDataFrame([(k, 0, k, "a") for k in range(200)], SCHEMA), 0)
    pinned, before = table.read(), table.manifest().files
    files = {f: f.stat().st_mtime_ns for f in Path(tmp_path / "t" / "data").rglob("*.parquet")}
    table.merge(spark.createDataFrame([(5, 1, 50, "b")], SCHEMA), 1)
    after = table.manifest().files
    assert sum(after[b] != before[b] for b in after) == 1
    assert files == {f: f.stat().st_mtime_ns for f in files}
    assert rows(pinned)[5] == (5, 0, 5, "a") and rows(table.read())[5] == (5, 1, 50, "b")
    table.merge(spark.createDataFrame([], SCHEMA), 2)
    assert rows(table.read(0))[5] == (5, 0, 5, "a")
    for n in range(3, 5):
        table.merge(spark.createDataFrame([(k, n, n, "c") for k in range(200)], SCHEMA), n)
    assert table.vacuum(1) == [0, 1, 3] and len(rows(table.read())) == 200


def test_a_batch_that_failed_before_its_manifest_is_written_again(spark, tmp_path, monkeypatch):
    table = MergedTable(spark, str(tmp_path / "t"), "id", "seq", buckets=4)
    table.merge(spark.createDataFrame([(1, 0, 1, "a"), (2, 0, 2, "a")], SCHEMA), 0)
    commit = MergedTable._commit
    monkeypatch.setattr(MergedTable, "_commit", lambda self, m: (_ for _ in ()).throw(OSError("lost")))
    try:
        table.merge(spark.createDataFrame([(1, 1, 9, "b")], SCHEMA), 1)
    except OSError:
        pass
    assert rows(table.read()) == [(1, 0, 1, "a"), (2, 0, 2, "a")]
    monkeypatch.setattr(MergedTable, "_commit", commit)
    assert table.merge(spark.createDataFrame([(1, 1, 9, "b")], SCHEMA), 1) == 1
    assert rows(table.read()) == [(1, 1, 9, "b"), (2, 0, 2, "a")]
