"""What several corpus operators share: table access, written intermediate results, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, through Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a folder of
    its own; on a cluster it is an error, since executors don't see one another's local folders."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="emberline-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and lost executors cost nothing.

    The shuffle files behind df are of no more use then, and Spark is told to delete them when the write has ended."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    with shuffle_files_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    if _STEPS:
        _STEPS[-1].append(out)
    return out


#: What written() has written within each open steps_freed(), the innermost last.
_STEPS: list[list[DataFrame]] = []


@contextmanager
def steps_freed() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What written() writes within it is deleted at its end, but for the frames that were given to the function it yields."""
    kept: list[DataFrame] = []
    _STEPS.append([])
    try:
        yield lambda df: kept.append(df) or df
    finally:
        for df in _STEPS.pop():
            if any(df is k for k in kept):
                if _STEPS:
                    _STEPS[-1].append(df)
            else:
                unlink(df)


@contextmanager
def shuffle_files_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a query's shuffle files at its end, instead of when the driver's collector comes by."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def unlink(df: DataFrame) -> None:
    """Delete what written() wrote for df, through the store's own file system."""
    path = getattr(df, "written_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def text_of(col: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, although body names it more than once or inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hashes_of(words: Column) -> Column:
    """One 64-bit hash a word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) rows as (id, component): the least id of each component.

    Large-star and small-star steps alternate, so that rounds grow with the logarithm of a component's size, not with
    its diameter; each step is one aggregation with partial minima and one join, and nothing is gathered by node.
    Ids without an edge aren't returned. Loops (a = b) return their own id.
    """
    e = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    ids = e
    while not _stars(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        star = written(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        )
        if e is not ids:
            unlink(e)
        e = star
    nodes = ids.select(F.col("u").alias("id")).union(ids.select(F.col("v").alias("id"))).distinct()
    return nodes.join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def _stars(e: DataFrame) -> bool:
    """Whether all edges (u, v) lead to least ids: each u has one v, and no v leads on. Loops alone are not stars."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("from"), F.lit(0).alias("to")).union(e.select("v", F.lit(0), F.lit(1)))
    led = ends.groupBy("id").agg(F.sum("from").alias("from"), F.max("to").alias("to"))
    return led.where("`from` > 1 or `from` > 0 and `to` > 0").agg(F.count("*")).first()[0] == 0
