"""Rule exclusion with reasons; unknown values never exclude."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import grouped_number


@dataclass(frozen=True)
class Limits:
    no_research_min: int = 3
    mature_min: int = 5000
    hype_news_min: int = 100
    hype_ratio_min: float = 0.5


def limits_of(rows: DataFrame) -> Limits:
    """Limits of a dimension (name, value), at most one row a limit; names that are absent keep their default."""
    known = Limits.__dataclass_fields__
    given = {r["name"]: r["value"] for r in rows.where(F.col("name").isin(*known)).groupBy("name").agg(F.max("value").alias("value")).collect()}
    return Limits(**{k: type(known[k].default)(v) for k, v in given.items()})


def reason(limits: Limits) -> Column:
    """noise, no_research, mature, hype or ok: the first that holds, over a feature table's columns."""
    return (
        F.when((F.col("docs_rated") > 0) & (F.col("docs_trusted") == 0), "noise")
        .when(F.col("total_pubs") < limits.no_research_min, "no_research")
        .when((F.col("total_pubs") > limits.mature_min) | F.col("has_standard"), "mature")
        .when((F.col("news_total") >= limits.hype_news_min) & (F.col("news_to_science_ratio") >= limits.hype_ratio_min), "hype")
        .otherwise("ok")
    )


def decided(features: DataFrame, limits: Limits) -> DataFrame:
    """features with reason_code, excluded and reason_text. Columns that are absent count as unknown."""
    known = set(features.columns)
    for c, t in (("docs_rated", "bigint"), ("docs_trusted", "bigint"), ("has_standard", "boolean"), ("news_total", "bigint"), ("news_to_science_ratio", "double")):
        if c not in known:
            features = features.withColumn(c, F.lit(None).cast(t))
    r = features.withColumn("reason_code", reason(limits))
    text = F.when(F.col("reason_code") == "mature", F.concat(F.lit("publications: "), grouped_number(F.col("total_pubs")))).when(F.col("reason_code") == "hype", F.concat(F.lit("news: "), grouped_number(F.col("news_total")))).when(F.col("reason_code") == "no_research", F.concat(F.lit("publications: "), F.col("total_pubs").cast("string")))
    return r.withColumn("excluded", F.col("reason_code") != "ok").withColumn("reason_text", text)


def flags_hold(flagged: DataFrame, group: str, limit: float) -> DataFrame:
    """Rows whose flag counts: flags of a group are ignored together where their share exceeds the limit."""
    share = flagged.groupBy(group).agg(F.avg(F.col("flag").cast("int")).alias("share"))
    return flagged.join(share, group).where(F.col("flag") & (F.col("share") <= limit)).drop("share")


def shorter_name_features(features: DataFrame, tail_names: DataFrame, limits: Limits) -> DataFrame:
    """Statistics of the name without its generic tail, where the full name has too few and the shorter is neither rare nor mature.
    tail_names: (term, shorter)."""
    short = features.select(F.col("term").alias("shorter"), F.col("total_pubs").alias("short_pubs"))
    j = features.join(tail_names, "term", "left").join(short, "shorter", "left")
    take = (F.coalesce("total_pubs", F.lit(0)) < limits.no_research_min) & F.col("short_pubs").between(limits.no_research_min, limits.mature_min)
    return j.select("term", F.when(take, F.col("short_pubs")).otherwise(F.col("total_pubs")).alias("total_pubs"), F.coalesce(take, F.lit(False)).alias("shortened"))
