"""Term footprints: yearly series into a nullable feature table (one aggregation a term)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_SEEN_MIN = 3


def yearly_counts(rows: DataFrame, term: str, date: str) -> DataFrame:
    """(term, year, n)."""
    return rows.where(F.col(term).isNotNull() & F.col(date).isNotNull()).groupBy(F.col(term).alias("term"), F.year(date).alias("year")).agg(F.count("*").alias("n"))


def type_counts(rows: DataFrame, term: str, kind: str) -> DataFrame:
    return rows.groupBy(F.col(term).alias("term"), F.col(kind).alias("type")).agg(F.count("*").alias("n"))


def media_buckets(year: Column) -> Column:
    """Uneven media years: all before 2023 from 2016 on count as 2016."""
    return F.when((year >= 2016) & (year < 2023), 2016).when(year >= 2023, year)


def growth(last: Column, before: Column, years: int = 3) -> Column:
    """Compound yearly growth; null without a positive start, -1 without an end."""
    return F.when(before > 0, F.when(last.isNull(), F.lit(-1.0)).otherwise(F.round(F.pow(last / before, F.lit(1.0) / years) - 1, 4)))


def of_year(year: Column, n: Column, wanted: int) -> Column:
    return F.sum(F.when(year == wanted, n))


def series_features(series: DataFrame, as_of_year: int) -> DataFrame:
    """Per term of (term, year, n): total_pubs, growth_3y, first_seen_year, pubs_last_year, recent_share (the last three full
    years and the current one), each null where its data are absent."""
    y, n, last = F.col("year"), F.col("n"), as_of_year - 1
    g = series.groupBy("term").agg(
        F.sum("n").alias("total_pubs"),
        of_year(y, n, last).alias("_last"),
        of_year(y, n, last - 3).alias("_before"),
        F.min(F.when(n >= FIRST_SEEN_MIN, y)).alias("first_seen_year"),
        F.coalesce(F.sum(F.when(y > last - 3, n)), F.lit(0)).alias("_recent"),
    )
    return g.select("term", "total_pubs", growth(F.col("_last"), F.col("_before")).alias("growth_3y"), "first_seen_year", F.coalesce("_last", F.lit(0)).alias("pubs_last_year"), F.round(F.try_divide("_recent", "total_pubs"), 4).alias("recent_share"))


def type_share(types: DataFrame, kind: str, name: str) -> DataFrame:
    return types.groupBy("term").agg(F.round(F.try_divide(F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("n"))), F.lit(0)), F.sum("n")), 4).alias(name))


def news_ratio(news: Column, pubs: Column, own_news: Column, own_science: Column) -> Column:
    """Media per publication; without term statistics that of the candidate's own documents."""
    return F.round(F.when(news.isNotNull() & (pubs > 0), news / pubs).otherwise(F.try_divide(own_news, F.nullif(own_science, F.lit(0)))), 4)


def own_document_features(links: DataFrame) -> DataFrame:
    """Per candidate of (candidate, source, source_type, trust): sources, documents rated and trusted (null if none rated)."""
    rated = F.count("trust")
    return links.groupBy("candidate").agg(
        F.count_distinct("source").alias("distinct_sources"),
        F.when(rated > 0, rated).alias("docs_rated"),
        F.when(rated > 0, F.count_if(F.col("trust").isin("high", "medium"))).alias("docs_trusted"),
        F.count_if(F.col("source_type") == "news").alias("own_news"),
        F.count_if(F.col("source_type").isin("paper", "preprint", "patent")).alias("own_science"),
    )


def feature_table(pubs: DataFrame, types: DataFrame, news: DataFrame, as_of_year: int, preprint: str) -> DataFrame:
    """All term features in one row a term: three aggregations that share the term as their key."""
    media = news.groupBy("term").agg(F.sum("n").alias("news_total"), F.coalesce(F.sum(F.when(F.col("year") > as_of_year - 4, F.col("n"))), F.lit(0)).alias("news_recent"))
    both = series_features(pubs, as_of_year).join(type_share(types, preprint, "preprint_share"), "term", "left").join(media, "term", "left")
    return both.withColumn("news_to_science_ratio", F.round(F.when(F.col("total_pubs") > 0, F.col("news_total") / F.col("total_pubs")), 4))


def candidate_features(candidates: DataFrame, table: DataFrame, links: DataFrame, flags: DataFrame) -> DataFrame:
    """candidates (candidate, term) with the term's features, those of their own documents (own_document_features(links)),
    the three-valued is_flagged of flags (candidate, flag), and the media-to-science ratio, which falls back to the own
    documents where the term has no statistics. Each input is one aggregation on the key it is joined by."""
    any_flag = flags.groupBy("candidate").agg(F.bool_or("flag").alias("is_flagged"))
    both = candidates.join(table, "term", "left").join(own_document_features(links), "candidate", "left").join(any_flag, "candidate", "left")
    ratio = news_ratio(F.col("news_total"), F.col("total_pubs"), F.col("own_news"), F.col("own_science"))
    return both.withColumn("news_to_science_ratio", ratio)


def totals(**sources: DataFrame) -> DataFrame:
    """Per term the sum of each source (term, year, n) as <name>_total; null where the source has nothing for the term."""
    every = None
    for name, rows in sources.items():
        part = rows.select("term", F.lit(name).alias("kind"), "n")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("term").agg(*[F.sum(F.when(F.col("kind") == name, F.col("n"))).alias(f"{name}_total") for name in sources])


def peak_year(series: DataFrame) -> DataFrame:
    """(term, peak_year, peak): the year with the most, the earlier one if two have as many."""
    top = series.groupBy("term").agg(F.max(F.struct("n", (-F.col("year")).alias("y"))).alias("m"))
    return top.select("term", (-F.col("m.y")).alias("peak_year"), F.col("m.n").alias("peak"))


def model_vector(f: DataFrame, as_of_year: int) -> DataFrame:
    """Nullable model inputs: logarithms, age, ratio in thousandths."""
    log = lambda c: F.round(F.log1p(c), 4)
    return f.select(
        "term",
        log(F.col("total_pubs")).alias("log_pubs"),
        log(F.col("pubs_last_year")).alias("log_last"),
        "growth_3y",
        "recent_share",
        (F.lit(as_of_year) - F.col("first_seen_year")).alias("age"),
        log(F.col("news_total")).alias("log_news"),
        log(F.col("news_recent")).alias("log_news_recent"),
        log(1000 * F.col("news_to_science_ratio")).alias("log_ratio"),
        "preprint_share",
    )


def imputed(f: DataFrame, column: str) -> DataFrame:
    """The column's exact median where it is null; other columns stay null."""
    return f.crossJoin(F.broadcast(f.agg(F.median(column).alias("_m")))).withColumn(column, F.coalesce(F.col(column), F.col("_m"))).drop("_m")


def dense_years(series: DataFrame, first: int, last: int, current: int) -> DataFrame:
    """Every year of the span for every term, 0 where none, the current year marked partial."""
    spine = series.select("term").distinct().select("term", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return spine.join(series, ["term", "year"], "left").select("term", "year", F.coalesce("n", F.lit(0)).alias("n"), (F.col("year") == current).alias("partial"))
