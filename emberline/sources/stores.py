"""Stored tables: upserts, snapshots with a time to live, joined statistics, trust levels."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import wordlists as L
from emberline.functions.text import host


def shared_folder(spark) -> str:
    """The folder in spark.checkpoint.dir, which executors share; a local session without that setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="emberline-")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder that executors share (spark.checkpoint.dir) and read from there: lineage is cut, and what
    depends on sampled ranges stays as it was computed. A local session without that setting gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def latest(rows: DataFrame, key: str, version: Column) -> DataFrame:
    """The row of the greatest version of each key: one aggregation, whose partial maxima keep a hot key small."""
    names = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), version).alias("_r")).select("_r.*")


def upserted(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """stored with the rows of new put in, the last write of a key wins and new wins a tie."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, key, F.struct(version, "_new")).drop("_new")


def stored_rows(spark, path: str, schema) -> DataFrame | None:
    """The table at path, or None before its first write."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return None
    return spark.read.schema(schema).parquet(path)


def replace_partitions(path: str, new: DataFrame, partition: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
    """Rewrite the partitions of the table at path that new has rows of, as merge(their stored rows or None, new), and leave the
    files of all others as they are. new's column `partition` names them; its distinct values, which come to the driver to prune
    the read, are as many as the partitions that a batch touches."""
    spark = new.sparkSession
    stored = stored_rows(spark, path, new.schema)
    new = checkpointed(new)
    if stored is not None:
        touched = [r[0] for r in new.select(partition).distinct().collect()]
        stored = stored.where(F.col(partition).isin(touched))
    merged = checkpointed(merge(stored, new))  # read in full before its files are replaced
    merged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert_buckets(path: str, new: DataFrame, key: str, version: str, buckets: int = 64) -> None:
    """Put the rows of new into the table at path, which is partitioned by a hash of the key (_bucket): the last write of a key
    wins and new wins a tie, as upserted() says. Only buckets with a new row are read and rewritten. Doing it twice with the same
    rows changes nothing, so a batch that failed half-way is simply put in again."""
    bucketed = new.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    replace_partitions(path, bucketed, "_bucket", lambda old, rows: latest(rows, key, F.col(version)) if old is None else upserted(old, rows, key, version))


def read_buckets(spark, path: str, keys: list, key: str, buckets: int = 64) -> DataFrame:
    """Rows of some keys of such a table: only their buckets are read. `keys` is a short list."""
    at = [r[0] for r in spark.createDataFrame([(k,) for k in keys], spark.read.parquet(path).select(key).schema).select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).distinct().collect()]
    return spark.read.parquet(path).where(F.col("_bucket").isin(at) & F.col(key).isin(keys)).drop("_bucket")


def put_evidence(path: str, rows: DataFrame) -> None:
    """Add rows (run_id, ...) to the evidence at path, partitioned by run: a row that a run already has isn't added again, so a
    run or a batch that comes twice leaves one copy. Other runs' files stay."""
    replace_partitions(path, rows, "run_id", lambda old, new: new.distinct() if old is None else old.unionByName(new).distinct())


def fresh(snapshots: DataFrame, key: list[str], at: str, as_of: Column, ttl_days: int) -> DataFrame:
    """The latest snapshot of each key and whether it is younger than the time to live."""
    last = snapshots.groupBy(*key).agg(F.max(at).alias(at))
    return last.withColumn("fresh", F.col(at) >= as_of - F.make_dt_interval(F.lit(ttl_days)))


def assembled(base: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """base with each source's columns joined on; errors names the sources that have nothing for a row."""
    out, lacking = base, []
    for name, rows in sources.items():
        out = out.join(rows.withColumn(f"_has_{name}", F.lit(True)), key, "left")
        lacking.append(F.when(F.col(f"_has_{name}").isNull(), F.lit(name)))
    return out.withColumn("errors", F.array_compact(F.array(*lacking))).drop(*[f"_has_{n}" for n in sources])


def with_trust(docs: DataFrame, domains: DataFrame) -> DataFrame:
    """docs (url, source_type, ...) with trust: the highest level of a pattern that the host ends with, else that of the type.

    A host gives all its dot suffixes, so the join is by equality; the patterns are a hand-kept list of some hundred rows.
    """
    rank = F.create_map(*[F.lit(x) for p in (("high", 1), ("medium", 2), ("low", 3)) for x in p])
    dims = domains.select(F.regexp_replace("pattern", r"^\.", "").alias("suffix"), rank[F.col("level")].alias("r")).groupBy("suffix").agg(F.min("r").alias("r"))
    h = docs.select("url").distinct().select("url", F.split(host(F.col("url")), r"\.").alias("p")).where("p is not null")
    suffixes = h.select("url", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "."))).alias("suffix"))
    by_host = suffixes.join(dims, "suffix").groupBy("url").agg(F.min("r").alias("r"))
    by_type = F.create_map(*[F.lit(x) for p in L.TRUST_BY_TYPE.items() for x in p])[F.col("source_type")]
    level = F.when(F.col("r") == 1, "high").when(F.col("r") == 2, "medium").when(F.col("r") == 3, "low")
    return docs.join(by_host, "url", "left").withColumn("trust", F.coalesce(level, by_type, F.lit("low"))).drop("r")
