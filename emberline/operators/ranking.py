"""Scores, reasons, ranks, interleaving, evaluation curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from emberline.functions.text import TOLD_AS, reason_texts
from emberline.sources.stores import checkpointed


def contributions(as_of_year: int) -> Column:
    """array<struct<feature, c>> of the heuristic score; features that are null give none."""
    c = lambda name, v: F.struct(F.lit(name).alias("feature"), v.cast("double").alias("c"))
    age = F.lit(as_of_year) - F.col("first_seen_year")
    pubs, ratio = F.col("total_pubs"), F.col("news_to_science_ratio")
    made = [
        c("growth_3y", F.greatest(F.lit(-1.5), F.least(F.lit(1.5), 2 * F.col("growth_3y")))),
        c("total_pubs", F.when(pubs < 2000, 0.8).when(pubs > 20000, -1.5).when(pubs.isNotNull(), 0.0)),
        c("first_seen_year", F.when(age <= 7, 0.6).when(age > 12, -0.8).when(age.isNotNull(), 0.0)),
        c("news_to_science_ratio", F.when(ratio > 5, -1.2).when(ratio.isNotNull(), 0.3)),
        c("has_standard", F.when(F.col("has_standard"), -1.0)),
        c("has_wikipedia", F.when(F.col("has_wikipedia"), -0.5)),
    ]
    return F.filter(F.array(*[F.when(F.col(n).isNotNull(), x) for n, x in zip(("growth_3y", "total_pubs", "first_seen_year", "news_to_science_ratio", "has_standard", "has_wikipedia"), made)]), lambda x: x.isNotNull() & x["c"].isNotNull())


def heuristic(features: DataFrame, as_of_year: int) -> DataFrame:
    """features with score and reasons (the three largest contributions by absolute value, zeros dropped)."""
    for name in ("has_standard", "has_wikipedia"):
        if name not in features.columns:
            features = features.withColumn(name, F.lit(None).cast("boolean"))
    f = features.withColumn("_c", contributions(as_of_year))
    total = F.aggregate("_c", F.lit(0.0), lambda a, x: a + x["c"])
    ranked = F.array_sort(F.transform(F.filter("_c", lambda x: x["c"] != 0), lambda x: F.struct((-F.abs(x["c"])).alias("o"), x["feature"].alias("feature"), F.round(x["c"], 4).alias("contribution"))))
    top = F.transform(F.slice(ranked, 1, 3), lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution")))
    return f.withColumn("score", F.round(1 / (1 + F.exp(-total)), 4)).withColumn("reasons", top).drop("_c")


def told(scored: DataFrame) -> DataFrame:
    """heuristic()'s rows with a text for each reason: reasons become array<struct<feature, contribution, text>>; a feature that
    readers aren't told of has a null text."""
    names = F.create_map(*[F.lit(x) for pair in TOLD_AS.items() for x in pair])
    rows = scored.withColumn("_texts", reason_texts())
    name = lambda f: F.coalesce(F.try_element_at(names, f), f)
    each = F.transform("reasons", lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution"), F.try_element_at(F.col("_texts"), name(x["feature"])).alias("text")))
    return rows.withColumn("reasons", each).drop("_texts")


def first_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; the key's hash spreads the work, ties end with the order's last column."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with their number, from 1, in an order that leaves no ties. Rows are dealt out by ranges of the order, numbered
    in each and moved on by the sizes of the ranges before (a row a partition), so no task sees them all."""
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + own).drop("_part", "_before")


def numbered_each(rows: DataFrame, group: str, *order: Column | str, name: str = "turn") -> DataFrame:
    """rows with their number, from 1, within their group: the overall number less the group's least. A group that holds most
    rows is spread like the others."""
    every = checkpointed(numbered(rows, group, *order, name="_place"))
    first = every.groupBy(group).agg(F.min("_place").alias("_first"))
    return every.join(first.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, (F.col("_place") - F.col("_first") + 1).cast("int")).drop("_place", "_first", "_group")


def interleaved(rows: DataFrame, group: str, order: list, name: str = "turn") -> DataFrame:
    """rows with the number of the turn in which their group gives them; order by (turn, group) for the queue."""
    return numbered_each(rows, group, *order, name=name)


def capped_round_robin(rows: DataFrame, run: str, batch: str, seq: str, score: str, cap: int) -> DataFrame:
    """At most `cap` rows a run with their place: batches give one row each in turn; a run of more rows than that is taken in
    the order of the score instead. A run is one query's candidates."""
    turned = rows.withColumn("_turn", F.row_number().over(W.partitionBy(run, batch).orderBy(seq)))
    sized = turned.join(rows.groupBy(run).agg(F.count("*").alias("_n")), run)
    by_score = F.when(F.col("_n") > cap, -F.col(score)).otherwise(F.lit(0.0))
    return sized.withColumn("place", F.row_number().over(W.partitionBy(run).orderBy(by_score, "_turn", batch, seq))).where(F.col("place") <= cap).drop("_turn", "_n")


def reading_order(docs: DataFrame, is_news: Column, is_startup: Column, published: str, key: str) -> DataFrame:
    """docs with their place in the reading queue: news, startup news first, and papers alternate, each by falling date, the
    undated last, ties by key."""
    lined = docs.withColumn("_paper", (~is_news).cast("int")).withColumn("_late", (is_news & ~is_startup).cast("int"))
    turns = numbered_each(lined, "_paper", "_late", F.desc_nulls_last(published), key, name="_turn")
    return numbered(turns, "_turn", "_paper").drop("_paper", "_late", "_turn")


def with_backfill(ranked: DataFrame, documents: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows that have documents: those without are passed over before ranks are given, so the next move up."""
    return ranked_slice(ranked.join(documents.select(key), key, "left_semi"), 1, n, *order)


def top_k_each(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def ranked_slice(rows: DataFrame, first: int, last: int, *order: Column) -> DataFrame:
    """Rows of the overall ranks first..last: a top-k sort, so that no window sees all rows."""
    top = rows.orderBy(*order).limit(last)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order))).where(F.col("rank") >= first)


def blend_reason(p: Column) -> Column:
    """What the name model moves a score by, from the undecided 0.5."""
    return F.struct(F.lit("name").alias("feature"), F.round(p - 0.5, 4).alias("contribution"))


def blended(score: Column, p: Column, weight: float = 0.75) -> Column:
    return F.round((1 - weight) * score + weight * p, 4)


def linear_probability(vector: Column, coef: Column, intercept: float) -> Column:
    dot = F.aggregate(F.zip_with(vector, coef, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    return 1 / (1 + F.exp(-(dot + intercept)))


def centroid(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centre): the normalised mean vector; each place is averaged apart, so no group's vectors come together."""
    each = vectors.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"])
    whole = each.groupBy(group).agg(mean.alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))
    return whole.select(group, F.when(norm > 0, F.transform("mean", lambda x: x / norm)).otherwise(F.col("mean")).alias("centre"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def topic_adjusted(rows: DataFrame, group: str, weight: float) -> DataFrame:
    """rows (group, score, closeness) with the score moved by weight * (closeness - the group's median), within [0, 1]."""
    mid = rows.groupBy(group).agg(F.median("closeness").alias("mid"), F.count("*").alias("size"))
    delta = F.when(F.col("size") >= 2, weight * (F.col("closeness") - F.col("mid"))).otherwise(0.0)
    return rows.join(mid, group).withColumn("adjusted", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + delta)), 4)).drop("mid", "size")


def confusion(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of tp, fp, fn, tn, accuracy, precision, recall, f1 of (label, score)."""
    hit = F.col("score") >= threshold
    c = rows.agg(*[F.count_if(x).alias(n) for n, x in (("tp", hit & (F.col("label") == 1)), ("fp", hit & (F.col("label") == 0)), ("fn", ~hit & (F.col("label") == 1)), ("tn", ~hit & (F.col("label") == 0)))])
    div = lambda a, b: F.round(F.try_divide(a, b), 4)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", div(tp + tn, tp + fp + fn + tn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def curve_areas(rows: DataFrame, by: str | None = None) -> DataFrame:
    """roc_auc and average precision (a sum of steps) of (label, score), for each value of `by` if given. Rows are folded to
    distinct scores, which are dealt out by ranges; sums run within a range and start at the ranges before."""
    group = [by] if by else []
    folded = rows.groupBy(*group, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    order = [*group, F.desc("score")]
    dealt = checkpointed(folded.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*group, "_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_q"))
    up_to = W.partitionBy(*group).orderBy("_part")
    before = sums.select(*group, "_part", (F.sum("_p").over(up_to) - F.col("_p")).alias("_bp"), (F.sum("_q").over(up_to) - F.col("_q")).alias("_bq"))
    w = W.partitionBy(*group, "_part").orderBy(F.desc("score"))
    up = dealt.join(before, [*group, "_part"]).select(*group, "p", "n", (F.col("_bp") + F.sum("p").over(w)).alias("cp"), (F.col("_bq") + F.sum("n").over(w)).alias("cn"))
    t = up.groupBy(*group).agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("n") * (F.col("cp") - F.col("p") / 2)).alias("a"), F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cn"))).alias("s"))
    return t.select(*group, F.round(F.try_divide("a", F.col("P") * F.col("N")), 4).alias("roc_auc"), F.round(F.try_divide("s", "P"), 4).alias("average_precision"))


def stratified_folds(rows: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """A fold number a row: keys in the order of their hash within each label, dealt out in turn."""
    return numbered_each(rows.withColumn("_h", F.xxhash64(key)), label, "_h", key, name="fold").withColumn("fold", F.pmod("fold", F.lit(k)).cast("int")).drop("_h")
