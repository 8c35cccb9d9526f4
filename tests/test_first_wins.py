"""First-wins ingest without a watermark: late copies, restarts, repeated batches."""

from datetime import datetime

from emberline.streaming import jobs

SCHEMA = "url string, title string, fetched_at timestamp"


def day(d, month=1):
    return datetime(2024, month, d)


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def run(spark, tmp_path, keep_days=None):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(jobs.first_into(str(tmp_path / "out"), keep_days, 4)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def kept(spark, tmp_path, part="rows"):
    rows = spark.read.parquet(str(tmp_path / "out" / part)).collect()
    return sorted((r.url, r.fetched_at) for r in rows)


def test_late_copies_over_restarts(spark, tmp_path):
    """A copy months later, in another run of the query, is a copy; a watermark would have forgotten the first."""
    land(spark, tmp_path / "in", "a", [("https://x.org/1", "One", day(2)), ("https://x.org/1", "One", day(1)), ("https://x.org/1", "One", day(1)), ("https://x.org/2", "Two", day(3))])
    run(spark, tmp_path)
    land(spark, tmp_path / "in", "b", [("https://x.org/1", "One", day(5, 6)), ("https://x.org/3", "Three", day(5, 6))])
    run(spark, tmp_path)
    assert kept(spark, tmp_path) == [("https://x.org/1", day(1)), ("https://x.org/2", day(3)), ("https://x.org/3", day(5, 6))]
    assert kept(spark, tmp_path, "copies") == [("https://x.org/1", day(1)), ("https://x.org/1", day(2)), ("https://x.org/1", day(5, 6))]


def test_repeated_batches_and_time_to_live(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    put = jobs.first_into(str(tmp_path / "out"), keep_days=30, buckets=4)
    one = batch(("https://x.org/1", "One", day(1)), (None, None, day(1)), (None, None, day(1)))
    two = batch(("https://x.org/1", "One", day(20)), ("https://x.org/2", "Two", day(20)))
    for rows, batch_id in ((one, 0), (one, 0), (two, 1), (two, 1), (batch(("https://x.org/1", "One", day(1, 4))), 2)):
        put(rows, batch_id)
    rows = [r.fetched_at for r in spark.read.parquet(str(tmp_path / "out" / "rows")).where("url = 'https://x.org/1'").collect()]
    assert sorted(rows) == [day(1), day(1, 4)]
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).where("url = 'https://x.org/2'").count() == 1
    assert [x for x in kept(spark, tmp_path, "copies") if x[0]] == [("https://x.org/1", day(20))]
    put(batch().where("false"), 3)
