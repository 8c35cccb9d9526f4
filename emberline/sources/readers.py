"""Readers of landed files: feeds, works, counts, sheets, runs; and the evidence store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import text as X

RSS = "title string, link string, description string, pubDate string"
ATOM = "id string, title string, summary string, published string, author array<struct<name string>>"
WORK = "id string, doi string, display_name string, abstract_inverted_index map<string,array<int>>, publication_date string, language string, authorships array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>, open_access struct<oa_url:string>"
COUNTS = "term string, group_by array<struct<key:string,count:bigint>>"
RUN = "run_id string, query string, status string, documents_processed int, candidates_found int, started_at timestamp, _corrupt string"
AGGREGATORS = ["news.google.com", "bing.com", "msn.com"]


def rss(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    """Items with a title and a link whose host, after unwrapping redirects, is no aggregator."""
    i = spark.read.format("xml").option("rowTag", "item").schema(RSS).load(path)
    d = i.where("title is not null and link is not null").withColumn("url", X.unwrapped(F.col("link")))
    h = X.host(F.col("url"))
    return d.where(h.isNotNull() & ~h.isin(*AGGREGATORS)).select(X.url_id(F.col("url")).alias("id"), F.lit("news").alias("source_type"), F.trim("title").alias("title"), X.without_feed_tail(X.summary(F.col("description"))).alias("abstract"), "url", X.feed_date(F.col("pubDate")).alias("published"), F.lit(phrase).alias("found_by"))


def atom(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    e = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return e.where("id is not null").select("id", F.lit("preprint").alias("source_type"), squeeze("title").alias("title"), squeeze("summary").alias("abstract"), F.col("id").alias("url"), X.feed_date(F.col("published")).alias("published"), F.transform("author", lambda a: a["name"]).alias("authors"), F.lit(phrase).alias("found_by"))


def works(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    w = spark.read.schema(WORK).json(path)
    orgs = F.array_distinct(F.flatten(F.transform("authorships", lambda a: F.transform(a["institutions"], lambda i: i["display_name"]))))
    return w.select("id", F.lit("paper").alias("source_type"), F.col("display_name").alias("title"), X.from_inverted(F.col("abstract_inverted_index")).alias("abstract"), F.coalesce("doi", "open_access.oa_url", "id").alias("url"), F.try_to_date("publication_date").alias("published"), "language", F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"), orgs.alias("organizations"), F.lit(phrase).alias("found_by"))


def group_counts(spark: SparkSession, path: str) -> DataFrame:
    """(term, key, n) of group-count payloads; keys that aren't whole numbers drop out."""
    g = spark.read.schema(COUNTS).json(path).select("term", F.explode("group_by").alias("g"))
    return g.where(F.col("g.key").rlike("^[0-9]+$")).select("term", F.col("g.key").cast("int").alias("year"), F.col("g.count").alias("n"))


def type_counts(spark: SparkSession, path: str) -> DataFrame:
    """(term, type, n) of group-count payloads by type; keys are type names, the last part of an address."""
    g = spark.read.schema(COUNTS).json(path).select("term", F.explode("group_by").alias("g"))
    return g.where(F.col("g.key").isNotNull()).select("term", F.regexp_extract("g.key", "([^/]*)/?$", 1).alias("type"), F.col("g.count").alias("n")).where("type <> ''")


def signals(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """A labelled sheet (id, name, domain, stage, moving, sources) with its terms; rows without id drop out."""
    s = spark.read.option("header", True).option("multiLine", True).schema("id string, name string, domain string, stage string, moving string, sources string").csv(path).dropna(subset=["id"])
    t = s.select(F.col("id").cast("int").alias("id"), "name", "domain", X.stage(F.col("stage")).alias("stage"), F.col("stage").contains("→").alias("moving"), X.link_targets(F.col("sources")).alias("source_urls"))
    return t.join(terms, "id", "left")


def unmatched(rows: DataFrame, term: str = "term_en") -> int:
    """How many rows have no term: callers assert that it is 0."""
    return rows.where(F.col(term).isNull()).count()


def match_counts(rows: DataFrame, term: str = "term_en") -> DataFrame:
    """(n, unmatched): how many rows there are, and how many have no term."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(term).isNull()).alias("unmatched"))


def labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows of a folder of run files, one JSON object a line."""
    r = spark.read.schema(RUN).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = F.col("_corrupt").isNotNull() | F.col("run_id").isNull()
    return r.where(~bad).drop("_corrupt"), r.where(bad).select("_corrupt")


def run_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) of a folder of run files, one JSON object a file, on any number of lines. A file that is no JSON object
    or has no run_id is quarantined whole: (file, raw)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    r = raw.withColumn("r", F.from_json("raw", RUN)).withColumn("ok", F.coalesce(F.col("r.run_id").isNotNull(), F.lit(False)))
    return r.where("ok").select("r.*").drop("_corrupt"), r.where("not ok").select("file", "raw")


def write_evidence(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def read_evidence(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run_id)
