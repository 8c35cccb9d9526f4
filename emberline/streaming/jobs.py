"""Continuous ingest: first-wins deduplication, windowed counts, idempotent upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import dedupe_key
from emberline.sources.stores import checkpointed, put_evidence, replace_partitions, stored_rows, upsert_buckets


def first_documents(docs: DataFrame, delay: str = "7 days") -> DataFrame:
    """docs (url, title, fetched_at) without later copies of a key within the watermark."""
    return docs.withColumn("key", dedupe_key(F.col("url"), F.col("title"))).withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["key"])


def window_counts(events: DataFrame, delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """Counts and totals per tumbling window and event type; on a stream, rows behind the watermark drop out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(log: str, put: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that records each batch id under `log` after put(batch), and skips one that is recorded: a batch
    that a restarted query gives again is a no-op if it had ended, and is put again if it had not."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/batch={batch_id}/_SUCCESS")
        if not done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done):
            put(batch)
            spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return each


def upsert_into(path: str, key: str, version: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the table under path/rows (partitioned by a hash of the key) at the last version of
    each key; a batch rewrites the buckets of its own keys only."""
    return once(f"{path}/batches", lambda batch: upsert_buckets(f"{path}/rows", batch, key, version, buckets))


def evidence_into(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds evidence (run_id, ...) to path/rows, each row of a run once."""
    return once(f"{path}/batches", lambda batch: put_evidence(f"{path}/rows", batch))


def first_into(path: str, keep_days: int | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the first document (url, title, fetched_at, ...) of each key, however late its copies
    come: path/rows gets the first ones, path/copies all others, both by batch, and path/keys what was seen, by a hash of the key.

    Within a batch the earliest fetched_at wins (ties: the least url). With `keep_days` a key counts as new again when its first
    document is older, by the batch's latest fetched_at, than that; without dates it stays known. Documents without a key are all kept. A batch that comes
    again, whole or after a failure, replaces what it wrote; batches before it aren't touched.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = checkpointed(batch.withColumn("key", dedupe_key(F.col("url"), F.col("title"))).withColumn("_row", F.monotonically_increasing_id()))
        first = rows.where("key is not null").groupBy("key").agg(F.min(F.struct("fetched_at", "url", "_row")).alias("_first")).select("key", "_first.fetched_at", "_first._row")
        keys = checkpointed(first.select("key", "_row", F.col("fetched_at").alias("seen"), F.lit(batch_id).cast("bigint").alias("batch"), F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("_bucket")))
        known = stored_rows(batch.sparkSession, f"{path}/keys", keys.drop("_row").schema)
        fresh = keys
        if known is not None:
            touched = [r[0] for r in keys.select("_bucket").distinct().collect()]  # no more than buckets
            known = known.where(F.col("_bucket").isin(touched) & (F.col("batch") < batch_id))
            if keep_days is not None:
                last = rows.agg(F.max("fetched_at")).first()[0]
                known = known.where(F.coalesce(F.col("seen") >= F.lit(last).cast("timestamp") - F.make_dt_interval(F.lit(keep_days)), F.lit(True)))
            fresh = checkpointed(keys.join(known.select("key"), "key", "left_anti"))
        won = rows.join(fresh.select("_row", F.lit(True).alias("_won")), "_row", "left").withColumn("_won", F.col("key").isNull() | F.coalesce("_won", F.lit(False)))
        won = checkpointed(won.drop("_row"))
        won.where("_won").drop("_won").write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        won.where("not _won").drop("_won").write.mode("overwrite").parquet(f"{path}/copies/batch={batch_id}")

        def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
            return new if old is None else old.where(F.col("batch") != batch_id).join(new.select("key"), "key", "left_anti").unionByName(new)

        replace_partitions(f"{path}/keys", fresh.drop("_row"), "_bucket", merge)

    return each
