from siftline.streaming import events as ev


def test_stream_upserts_in_versions(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = [(1, None, 1, "a", 1.0, ""), (2, None, 1, "a", 2.0, "")]
    for k, part in enumerate((rows, [(2, None, 9, "b", 5.0, ""), (3, None, 1, "a", 3.0, "")])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / f"events{k}.parquet"))
        stream = ev.event_stream(spark, f"{source}/*", pattern="*.parquet")
        ev.run_available(stream, ev.upsert_sink(path, "event_id", ["value"]), str(tmp_path / "cp"))
    last = spark.read.parquet(f"{path}/v=1")
    assert sorted((r.event_id, r.value, r.event_type) for r in last.collect()) == [(1, 1.0, "a"), (2, 5.0, "a"), (3, 3.0, "a")]


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    stream = ev.windowed_counts(ev.event_stream(spark, folder), "1 day")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination()
    want = ev.windowed_counts(spark.read.parquet(f"{folder}/events.parquet"), "1 day")
    assert sorted(spark.table("windows").collect()) == sorted(want.collect())
