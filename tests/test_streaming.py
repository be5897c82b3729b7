from pyspark.sql import functions as F

from tracery.streaming import activity, leases

SCHEMA = "task_id string, event_id long, action string, token string, at double"
EVENTS = [
    ("t", 1, "enqueue", None, 0.0), ("t", 2, "enqueue", None, 1.0), ("t", 3, "claim", "a", 10.0), ("t", 4, "claim", "b", 11.0), ("t", 5, "heartbeat", "a", 200.0),
    ("t", 6, "complete", "b", 210.0), ("t", 7, "complete", "a", 900.0), ("t", 8, "claim", "c", 901.0), ("t", 9, "fail", "c", 902.0), ("t", 10, "claim", "d", 903.0),
    ("t", 11, "fail", "d", 904.0), ("t", 12, "claim", "e", 905.0), ("u", 13, "claim", "x", 1.0),
]
WANT = {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: False, 8: True, 9: True, 10: True, 11: True, 12: False, 13: False}


def test_leases_as_table_and_as_stream(spark, tmp_path):
    table = spark.createDataFrame(EVENTS, SCHEMA)
    batch = {r.event_id: r for r in leases.lease_verdicts(table).collect()}
    assert {k: r.accepted for k, r in batch.items()} == WANT and batch[12].status == "failed" and batch[10].attempts == 3
    for k, part in enumerate((EVENTS[:5], EVENTS[5:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = leases.lease_verdicts(stream).writeStream.outputMode("append").format("memory").queryName("lease_sink").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.event_id: r.accepted for r in spark.table("lease_sink").collect()} == WANT


def test_windows_equal_the_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    found = activity.run_once(activity.windowed(activity.event_stream(spark, path), "1 hour"), "hour_sink")
    want = spark.read.parquet(path).groupBy(F.date_trunc("hour", "ts"), "event_type").count()
    assert found.count() == want.count() and found.agg(F.sum("n")).first()[0] == spark.read.parquet(path).count()


def test_snapshots_resume_from_their_checkpoint(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("events", "out", "mark"))
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.where("event_id % 2 = 0").coalesce(1).write.parquet(f"{source}/events.parquet", mode="append")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        if part.endswith("1"):
            rows.where(part).coalesce(1).write.parquet(f"{source}/events.parquet", mode="append")
        stream = spark.readStream.schema(rows.schema).parquet(f"{source}/events.parquet")
        activity.snapshots(stream, out, mark, ["event_id"]).awaitTermination()
    assert spark.read.parquet(out).count() == rows.count()
