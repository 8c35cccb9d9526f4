"""Reports of a run, an evaluation or the sources: one aggregation each, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators import ranking

#: The order in which exclusions are told.
REASONS = ("noise", "no_research", "mature")
#: 2 ** REGISTERS registers of a distinct-count sketch: a standard error of some 1.04 / sqrt(2 ** REGISTERS), 1.6 % for 12.
REGISTERS = 12
#: A quantile sketch keeps this many values a level; the rank of an estimate is off by some 1.33 % of the rows for 200.
LEVEL = 200


def distinct_sketches(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., sketch): a stored, mergeable sketch of the distinct values a group."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, REGISTERS).alias("sketch"))


def rolled_up(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., estimate, sketch): the groups' sketches merged into those of fewer keys; the rows aren't read again."""
    merged = sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.withColumn("estimate", F.hll_sketch_estimate("sketch"))


def distinct_organisations(rows: DataFrame, term: str, org: str, most: int = 200) -> DataFrame:
    """(term, distinct_orgs): the exact number of organisations a term, `most` for more."""
    return rows.groupBy(F.col(term).alias("term")).agg(F.least(F.count_distinct(org), F.lit(most)).alias("distinct_orgs"))


def attention(rows: DataFrame, keys: list[str], views: str) -> DataFrame:
    """Mentions and summed views by the keys, with the totals over each key from the right (null there)."""
    return rows.rollup(*keys).agg(F.count("*").alias("mentions"), F.round(F.sum(views), 2).alias("views"))


def excluded_by_reason(decided: DataFrame) -> DataFrame:
    """(reason_code, place, n, terms) of the excluded rows of rules.decided: place is the order of telling, terms are sorted. The
    terms of a reason are gathered for a reader; leave the column out and they are not."""
    place = F.lit(len(REASONS) + 1)
    for i, r in reversed(list(enumerate(REASONS, 1))):
        place = F.when(F.col("reason_code") == r, i).otherwise(place)
    return decided.where("excluded").groupBy("reason_code").agg(F.min(place).alias("place"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("term")), ";").alias("terms"))


def source_failures(errors: DataFrame, source: str, detail: str, *order: str) -> DataFrame:
    """(source, n, first_detail): how often each source failed, and how it did first."""
    return errors.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"), F.min_by(detail, F.struct(*order)).alias("first_detail"))


def call_journal(calls: DataFrame) -> DataFrame:
    """(step, model, calls, seconds) of calls (step, model, seconds), with totals a step and over all (null)."""
    return calls.rollup("step", "model").agg(F.count("*").alias("calls"), F.round(F.sum("seconds"), 2).alias("seconds"))


def funnel(candidates: DataFrame, documents: DataFrame, kept: Column, confident: Column) -> DataFrame:
    """(stage, n, dropped): documents read, candidates found, those kept, those of them that are confident."""
    c = candidates.agg(F.count("*").alias("n2"), F.count_if(kept).alias("n3"), F.count_if(kept & confident).alias("n4"))
    whole = c.crossJoin(F.broadcast(documents.agg(F.count("*").alias("n1"))))  # one row each
    return whole.select(F.expr("stack(4, 'documents', n1, 0L, 'candidates', n2, n1 - n2, 'kept', n3, n2 - n3, 'confident', n4, n3 - n4) as (stage, n, dropped)")).select("stage", "n", F.col("dropped").cast("bigint").alias("dropped"))


def recall_by(rows: DataFrame, domain: str, doc_id: str, found: Column) -> DataFrame:
    """(domain, documents, found, recall) a domain and in total."""
    g = rows.rollup(domain).agg(F.count_distinct(doc_id).alias("documents"), F.count_distinct(F.when(found, F.col(doc_id))).alias("found"))
    return g.select(F.coalesce(domain, F.lit("total")).alias("domain"), "documents", "found", F.round(F.col("found") / F.col("documents"), 4).alias("recall"))


def ceiling(collected: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """(domain, phrases, documents, found, items): how many of the items looked for the collected documents mention at all.
    collected: (domain, doc_id, phrase); hits: (term, doc_id); items: one row an item."""
    c = collected.rollup("domain").agg(F.count_distinct("phrase").alias("phrases"), F.count("doc_id").alias("documents"))
    h = hits.join(collected.select("doc_id", "domain"), "doc_id").rollup("domain").agg(F.count_distinct("term").alias("found")).withColumnRenamed("domain", "d")
    both = c.join(h, F.col("domain").eqNullSafe(F.col("d")), "left").crossJoin(F.broadcast(items.agg(F.count("*").alias("items"))))  # one row
    return both.select(F.coalesce("domain", F.lit("total")).alias("domain"), "phrases", "documents", F.coalesce("found", F.lit(0)).alias("found"), "items")


def leaderboard(rows: DataFrame, good: Column) -> DataFrame:
    """(model, domain, candidates, share_with_series) a model and domain and a model (domain null): the share without `good`, from 0 on."""
    g = rows.groupingSets([["model", "domain"], ["model"]], "model", "domain").agg(F.count("*").alias("candidates"), F.count_if(good).alias("f"))
    return g.select("model", "domain", "candidates", F.greatest(F.lit(0.0), 1 - F.round(F.col("f") / F.col("candidates"), 4)).alias("share_with_series"))


def correct_by_kind(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(kind, correct) of scored (kind, score, label): the share on the right side of the threshold."""
    right = ((F.col("score") >= threshold) == (F.col("label") == 1)).cast("int")
    return scored.groupBy("kind").agg(F.round(F.avg(right), 4).alias("correct"))


def quartiles(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """(kind, q1, median, q3), exact and interpolated. A group's distinct values and their counts are held by one task:
    for groups that may be large, see quantile_sketches."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(kind).agg(q.alias("q")).select(kind, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def quantile_sketches(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., sketch): a stored, mergeable quantile sketch a group, of bounded size."""
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(LEVEL)).alias("sketch"))


def sketched_quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., q1, median, q3, n) of the groups' merged sketches, each a value of the rows."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(LEVEL)).alias("sketch"))
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return merged.select(*keys, at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.kll_sketch_get_n_double("sketch").alias("n"))


def examples(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def trust_composition(links: DataFrame, candidate: str = "candidate") -> DataFrame:
    """(candidate, high, medium, low, only_low) of links (candidate, trust); only_low is false where no source is rated."""
    t = F.col("trust")
    return links.groupBy(candidate).agg(*[F.count_if(t == x).alias(x) for x in ("high", "medium", "low")], F.coalesce(F.bool_and(t == "low"), F.lit(False)).alias("only_low"))


def run_summary(rows: DataFrame, run: str, item: str, score: str, confident: float, leaders: int = 3) -> DataFrame:
    """(run, confident, leaders): how many items score above `confident`, and the best ones in order (ties by item)."""
    top = ranking.top_k_each(rows, run, leaders, F.desc(score), F.asc(item))
    lead = top.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias("leaders"))
    return rows.groupBy(run).agg(F.count_if(F.col(score) > confident).alias("confident")).join(lead, run)


def depth_of_mention(hits: DataFrame, queue: DataFrame, depth: int) -> DataFrame:
    """(term, first_rank, beyond, share_beyond): the first place in the reading queue (doc_id, place) that mentions a term, and how
    many of its mentions lie deeper than `depth`."""
    g = hits.join(queue, "doc_id").groupBy("term").agg(F.min("place").alias("first_rank"), F.count_if(F.col("place") > depth).alias("beyond"), F.count("*").alias("n"))
    return g.select("term", "first_rank", "beyond", F.round(F.col("beyond") / F.col("n"), 4).alias("share_beyond"))


def split_by_keys(rows: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """rows with part (kept or removed) and the least reason that flagged (key, reason) gives for the removed."""
    why = flagged.groupBy(key).agg(F.min("reason").alias("reason"))
    return rows.join(why, key, "left").withColumn("part", F.when(F.col("reason").isNull(), "kept").otherwise("removed"))


def with_neutral_score(rows: DataFrame, scored: DataFrame, key: str, neutral: float = 0.5) -> DataFrame:
    """rows with the score of their key; a key without one is neutral."""
    return rows.join(scored.select(key, "score"), key, "left").withColumn("score", F.coalesce("score", F.lit(neutral)))


def fetched_by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is asked for; repeated and unknown ids change nothing."""
    return rows.join(ids.select(key), key, "left_semi")


def long_names(rows: DataFrame, name: str, most_words: int = 5) -> DataFrame:
    """(long_names, n): how many names have more than `most_words` words, of how many."""
    return rows.agg(F.count_if(F.size(F.split(F.trim(name), r"\s+")) > most_words).alias("long_names"), F.count("*").alias("n"))
