"""Footprints kept up to date: signed deltas of yearly counts folded into a stored table, and features of the touched terms only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.sources.stores import fresh, replace_partitions


#: Rows that one task compares, in some 100 bytes each.
PART_ROWS = 500_000


def dealt(rows: DataFrame, doc: str, n: int) -> DataFrame:
    """n rows dealt by document over so many tasks that a task's memory does not grow with them, as it would at Spark's fixed
    number of shuffle partitions. Joins and count_deltas() by document keep this order."""
    return rows.repartition(max(1, -(-n // PART_ROWS)), doc)


def count_deltas(before: DataFrame | None, after: DataFrame, doc: str, term: str, date: str) -> DataFrame:
    """(term, year, n): by how much the counts of each term and year change when the rows `before` of some documents become
    `after`; n may be negative, and what cancels out gives no row.

    Both hold one row a document and term; rows that repeat count once. `before` is what the store has of these documents (None
    if none of them was seen), so a document that comes again unchanged changes nothing, and one with no rows in `after` is
    withdrawn. Rows without a document, term or date count for nothing.
    """
    side = lambda rows, sign: rows.select(F.col(doc).alias("doc"), F.col(term).alias("term"), F.year(date).alias("year")).dropna().distinct().withColumn("n", F.lit(sign))
    both = side(after, 1)
    if before is not None:
        both = both.union(side(before, -1))
    return both.groupBy("term", "year").agg(F.sum("n").alias("n")).where("n <> 0")


def folded(stored: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """(term, year, n): stored counts with deltas added; counts of zero go. Folding is associative: deltas may be folded into
    one another first, in any order."""
    both = deltas.select("term", "year", "n") if stored is None else stored.select("term", "year", "n").union(deltas.select("term", "year", "n"))
    return both.groupBy("term", "year").agg(F.sum("n").alias("n")).where("n <> 0")


def fold_into(path: str, deltas: DataFrame, batch: str, buckets: int = 64) -> None:
    """Fold deltas into the counts at `path`, partitioned by a hash of the term (_bucket); buckets without a delta keep their files.

    Every bucket carries the names of the batches folded into it in a row of its own (term null), so that a batch which comes
    again, or which failed after some buckets, is folded once into each. A batch name has to stand for the same deltas.
    """
    keyed = deltas.where("term is not null").select("term", "year", F.col("n").cast("bigint").alias("n"))
    keyed = keyed.withColumn("_batch", F.lit(None).cast("string")).withColumn("_bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        mark = new.select("_bucket").distinct().select(F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("bigint").alias("n"), F.lit(batch).alias("_batch"), "_bucket")
        if old is None:
            return new.unionByName(mark)
        done = old.where(F.col("_batch") == batch).select("_bucket").distinct()
        left = new.join(done, "_bucket", "left_anti").unionByName(mark.join(done, "_bucket", "left_anti"))
        both = old.unionByName(left)
        return both.groupBy("term", "year", "_batch", "_bucket").agg(F.sum("n").alias("n")).where("n <> 0 or _batch is not null").select("term", "year", "n", "_batch", "_bucket")

    replace_partitions(path, keyed, "_bucket", merge)


def stored_counts(spark, path: str) -> DataFrame:
    """(term, year, n) of the table that fold_into() keeps."""
    return spark.read.parquet(path).where("term is not null").select("term", "year", "n")


def to_refresh(wanted: DataFrame, snapshots: DataFrame, deltas: DataFrame, at: str, as_of, ttl_days: int) -> DataFrame:
    """(term): wanted terms whose features have to be computed anew: without a snapshot younger than the time to live, or
    touched by a delta."""
    still = fresh(snapshots, ["term"], at, as_of, ttl_days).where("fresh").select("term")
    untouched = still.join(deltas.select("term").distinct(), "term", "left_anti")
    return wanted.select("term").where("term is not null").distinct().join(untouched, "term", "left_anti")


def refreshed(kept: DataFrame, terms: DataFrame, series: DataFrame, features: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """kept (term, features ...) with the rows of `terms` computed anew from their series (term, year, n) by `features`; terms
    without a series lose their row. Only the series of those terms are read into the aggregation."""
    anew = features(series.join(terms, "term", "left_semi"))
    return kept.join(terms, "term", "left_anti").unionByName(anew.select(*kept.columns))
