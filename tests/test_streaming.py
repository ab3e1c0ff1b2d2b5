from fablens.streaming.summaries import windowed_summary


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_summary(stream, "ts", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("summary").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.category): (r.n, round(r.mean, 6)) for r in spark.table("summary").collect()}
    want = {(r.start, r.category): (r.n, round(r.mean, 6)) for r in windowed_summary(events, "ts", "event_type", "value").collect()}
    assert got == want and got
