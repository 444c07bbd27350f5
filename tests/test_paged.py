import datetime as dt

from pyspark.sql import functions as F

from siftline.sources import paged

FIRST = dt.date(2024, 1, 1)


def records(spark, lo, hi):
    days = spark.range(lo, hi).select(F.date_add(F.lit(FIRST), (F.col("id") * 7 % 90).cast("int")).alias("day"), F.col("id").alias("key"))
    return days.withColumn("document", F.to_json(F.struct(F.concat(F.lit('CVE-"'), F.col("key").cast("string")).alias("id"))))


def want(lo, hi, days, page):
    own = sorted((i * 7 % 90, i) for i in range(lo, hi))
    out, seen = [], {}
    for day, i in own:
        k = day // days
        out.append((FIRST + dt.timedelta(days=k * days + days - 1), seen.get(k, 0) // page * page, i))
        seen[k] = seen.get(k, 0) + 1
    return sorted(out)


def rows(df):
    return sorted((r.window_end, r.start_index, int(r.id[5:])) for r in df.select("window_end", "start_index", F.get_json_object("document", "$.id").alias("id")).collect())


def test_pages_are_partitions_and_windows_are_chosen(spark, tmp_path):
    folder = str(tmp_path / "feed")
    paged.publish(records(spark, 0, 200), folder, "day", "key", "document", FIRST, 30, 25)
    df = paged.feed(spark, folder)
    assert rows(df) == want(0, 200, 30, 25)
    assert df.rdd.getNumPartitions() == len({(w, s) for w, s, _ in want(0, 200, 30, 25)})
    assert rows(paged.feed(spark, folder, after="2024-01-30", through="2024-02-29")) == [r for r in want(0, 200, 30, 25) if r[0] == dt.date(2024, 2, 29)]
    assert rows(paged.feed(spark, str(tmp_path / "none"))) == []


def test_a_stream_reads_each_window_once_over_restarts(spark, tmp_path):
    folder, out, state = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "state")
    all_ = records(spark, 0, 200)
    for lo, hi in ((0, 30), (30, 60), (60, 90), (90, 90)):
        part = all_.where(F.datediff("day", F.lit(FIRST)).between(lo, hi - 1))
        paged.publish(part, folder, "day", "key", "document", FIRST, 30, 25)
        paged.feed(spark, folder, streaming=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(paged.feed(spark, folder)) == want(0, 200, 30, 25)


def test_many_pages_share_tasks_and_none_is_lost(spark, tmp_path):
    folder = str(tmp_path / "feed")
    paged.publish(records(spark, 0, 400), folder, "day", "key", "document", FIRST, 30, 2)
    df = paged.feed(spark, folder)
    pages = len({(w, s) for w, s, _ in want(0, 400, 30, 2)})
    assert pages > 190 and df.rdd.getNumPartitions() == -(-pages // 3)
    assert rows(df) == want(0, 400, 30, 2)
