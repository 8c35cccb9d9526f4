"""Name variants and near-duplicates: pairs by inverted indexes, greedy decisions in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from emberline.functions.text import key_words, mentions, slug
from emberline.operators.mentions import term_mentions
from emberline.sources.stores import checkpointed

#: Members of a class that go together when pairs of classes give the pairs of their members.
CHUNK = 256


def containment_pairs(names: DataFrame, run: str | None = None) -> DataFrame:
    """(narrow, broad): names (id, name) whose key words hold all key words of another, two at least; with `run`, a column of
    names, only of the same run. Ids are of any type.

    A broad name meets only names that hold its rarest key word (of its run), so frequent words make no pairs.
    """
    of = [run] if run else []
    w = names.select(*of, "id", key_words(F.col("name")).alias("w")).where(F.size("w") >= 2)
    each = w.select(*of, "id", F.explode("w").alias("k"))
    often = each.groupBy(*of, "k").agg(F.count("*").alias("n"))
    rare = each.join(often, [*of, "k"]).groupBy(*of, "id").agg(F.min(F.struct("n", "k")).alias("r")).select(*of, "id", F.col("r.k").alias("k"))
    broad = w.join(rare, [*of, "id"]).select(*of, F.col("id").alias("broad"), F.col("w").alias("bw"), "k")
    narrow = each.join(w, [*of, "id"]).select(*of, F.col("id").alias("narrow"), F.col("w").alias("nw"), "k")
    return broad.join(narrow, [*of, "k"]).where((F.col("broad") != F.col("narrow")) & (F.size(F.array_except("bw", "nw")) == 0)).select("narrow", "broad")


def cards_naming(cards: DataFrame, items: DataFrame) -> DataFrame:
    """(item, id, by): which cards (id, name, description) name the technology of which items (item, term), "name" or
    "description".

    By name: both have two key words at least, and the card's hold all of the term's; a term meets only cards that hold its
    rarest key word. Else by description: the term occurs in it as whole words; descriptions meet terms by their tokens. Null
    names, descriptions and terms name nothing; an item with several terms counts by any.
    """
    terms = items.select("item", key_words(F.col("term")).alias("w")).where(F.size("w") >= 2)
    named = cards.select("id", key_words(F.col("name")).alias("cw")).where(F.size("cw") >= 2)
    each = named.select("id", F.explode("cw").alias("k"))  # ids alone pass through the joins by word
    often = each.groupBy("k").agg(F.count("*").alias("n"))
    rare = terms.select("item", "w", F.explode("w").alias("k")).join(often, "k", "left").groupBy("item", "w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "k")).alias("r")).select("item", "w", F.col("r.k").alias("k"))
    by_name = rare.join(each, "k").join(named, "id").where(F.size(F.array_except("w", "cw")) == 0).select("item", "id", F.lit("name").alias("by"))
    asked = items.select("item", "term").where("term is not null").distinct()
    hits = term_mentions(cards.select("id", "description"), asked.select("term").distinct(), "id", "description").join(asked, "term")
    by_text = hits.join(cards.select("id", "description"), "id").where(mentions(F.col("description"), F.col("term"))).select("item", "id", F.lit("description").alias("by"))
    return by_name.union(by_text).groupBy("item", "id").agg(F.max("by").alias("by"))  # name before description


def title_matches(left: DataFrame, right: DataFrame, least: float = 0.6) -> DataFrame:
    """(a, b, jaccard) of (a, title) and (b, title) with a token Jaccard (to 4 places) of at least `least`, by shared rare tokens.

    Titles with the same tokens are one class, named by a hash of them; classes are compared once and then give the pairs of their
    members, CHUNK by CHUNK, so that large groups of copies are spread over all tasks. Classes of that Jaccard share one of the
    size - ceil(least * size) + 1 rarest tokens of both (prefix filter), neither has less than `least` of the other's tokens, and
    the tokens that follow the shared one leave room for the overlap. Only hashes and sizes pass through the join by token.
    """
    least_exact = least - 5e-5  # rounded up to `least`

    def titles(rows: DataFrame, key: str) -> DataFrame:
        t = rows.select(key, F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), 0))).alias("t")).where(F.size("t") > 0)
        return t.select(key, F.sha2(F.array_join("t", " "), 256).alias(f"of_{key}"), "t")

    a, b = titles(left, "a"), titles(right, "b")
    classes = {key: checkpointed(rows.groupBy(f"of_{key}").agg(F.first("t").alias("t"), F.count("*").alias("n"))) for key, rows in (("a", a), ("b", b))}
    freq = classes["a"].select(F.explode("t").alias("k")).union(classes["b"].select(F.explode("t").alias("k"))).groupBy("k").agg(F.count("*").alias("n"))

    def heads(key: str) -> DataFrame:
        each = classes[key].select(f"of_{key}", F.size("t").alias(f"n{key}"), F.explode("t").alias("k")).join(freq, "k")
        rare = each.groupBy(f"of_{key}", f"n{key}").agg(F.array_sort(F.collect_list(F.struct("n", "k"))).alias("o"))
        prefix = F.slice("o", F.lit(1), F.size("o") - F.ceil(least_exact * F.size("o")).cast("int") + 1)
        return rare.select(f"of_{key}", f"n{key}", F.posexplode(prefix).alias("at", "x")).select(f"of_{key}", f"n{key}", (F.col(f"n{key}") - F.col("at")).alias(f"rest_{key}"), "x.k")

    def members(rows: DataFrame, key: str) -> DataFrame:
        sized = rows.select(key, f"of_{key}").join(classes[key].select(f"of_{key}", "n"), f"of_{key}")
        chunk = F.pmod(F.xxhash64(key), F.ceil(F.col("n") / CHUNK)).alias("chunk")
        return sized.groupBy(f"of_{key}", chunk).agg(F.collect_list(F.struct(key)).alias(f"all_{key}")).drop("chunk")

    sized = (F.col("na") >= least_exact * F.col("nb")) & (F.col("nb") >= least_exact * F.col("na"))
    room = F.least("rest_a", "rest_b") >= least_exact / (1 + least_exact) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = heads("a").join(heads("b"), "k").where(sized & room).select("of_a", "of_b").distinct()
    j = pairs.join(classes["a"].select("of_a", F.col("t").alias("ta")), "of_a").join(classes["b"].select("of_b", F.col("t").alias("tb")), "of_b")
    score = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    near = checkpointed(j.select("of_a", "of_b", F.round(score, 4).alias("jaccard")).where(F.col("jaccard") >= least))
    chunks = near.join(members(a, "a"), "of_a").join(members(b, "b"), "of_b").select("all_a", "all_b", "jaccard")
    dealt = chunks.repartition(2 * chunks.sparkSession.sparkContext.defaultParallelism)  # by turns: a pair of chunks makes CHUNK^2 rows at most
    return dealt.select(F.explode("all_a").alias("x"), "all_b", "jaccard").select("x", F.explode("all_b").alias("y"), "jaccard").select("x.a", "y.b", "jaccard")


def without_variants(scored: DataFrame) -> DataFrame:
    """(run, id, name, score, place) of (run, id, name, score) with name variants merged. The rule: names are read by falling
    score; one whose key words hold all those of a name that has a place, or are all held by them, has no place of its own, but
    takes that place, the first such, if it is the narrower of the two. Names of less than two key words have no variants.

    Names that no chain of variants joins don't touch each other, so each round decides the next name of every chain of every
    run at once; there are as many rounds as the longest chain has names. Places are numbered within the run at the end.
    """
    ids = scored.select("run", "id", "name", "score", F.size(key_words(F.col("name"))).alias("n"))
    near = containment_pairs(scored.select("id", "name", "run"), "run")
    both = near.select(F.col("narrow").alias("id"), F.col("broad").alias("other")).union(near.select(F.col("broad").alias("id"), F.col("narrow").alias("other"))).distinct()
    both = checkpointed(both)
    chain = checkpointed(_chains(ids.select("id"), both))
    order = W.partitionBy("run", "chain").orderBy(F.desc("score"), "id")
    left = checkpointed(ids.join(chain, "id").withColumn("step", F.row_number().over(order)))
    steps = left.agg(F.max("step")).first()[0] or 0
    # a place: who had it first, and who has it now
    held = left.where("step = 1").select("run", "chain", F.col("score").alias("at"), F.col("id").alias("first"), "id", "n")
    for step in range(2, steps + 1):
        new = left.where(F.col("step") == step).select(F.col("run").alias("r"), F.col("chain").alias("c"), F.col("id").alias("new"), F.col("score").alias("s"), F.col("n").alias("m"))
        met = held.join(both, "id").join(new, (F.col("other") == F.col("new")) & (F.col("chain") == F.col("c")))
        first = met.groupBy("new", "m").agg(F.min_by(F.struct("first", "n"), F.struct(-F.col("at"), "first")).alias("place"))
        moved = first.where("m > place.n").select(F.col("place.first").alias("first"), "new", "m")
        kept = held.join(moved, "first", "left").select("run", "chain", "at", "first", F.coalesce("new", "id").alias("id"), F.coalesce("m", "n").alias("n"))
        alone = new.join(first.select("new"), "new", "left_anti").select("r", "c", "s", F.col("new").alias("first"), "new", "m")
        held = checkpointed(kept.union(alone))
    named = held.join(ids.select("id", "name", "score"), "id").withColumn("place", F.row_number().over(W.partitionBy("run").orderBy(F.desc("at"), "first")) - 1)
    return named.select("run", "id", "name", "score", "place")


def _chains(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, chain): the least id that pairs (id, other), each both ways, lead to. Labels double their reach each round."""
    chain = ids.select("id", F.col("id").alias("chain"))
    while True:
        near = pairs.join(chain.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("chain").alias("least"))
        lower = chain.join(near, "id", "left").select("id", F.col("chain").alias("was"), F.least("chain", "least").alias("chain"))
        jump = lower.join(lower.select(F.col("id").alias("chain"), F.col("chain").alias("root")), "chain").select("id", "was", "root")
        new = checkpointed(jump.select("id", F.col("root").alias("chain"), (F.col("root") != F.col("was")).alias("moved")))
        chain = new.select("id", "chain")
        if new.where("moved").isEmpty():
            return chain


def greedy_suppressed(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """ranked (run, id, rank) without rows that pair with a kept row above in their run: pairs (a, b) either way.

    Each round keeps the rows that have no undecided partner above and drops the partners of kept rows below them, until all
    are decided; no run is brought together.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    a = ranked.select("run", F.col("id").alias("a"), F.col("rank").alias("ra"))
    above = checkpointed(both.join(a, "a").join(ranked.select("run", F.col("id").alias("b"), F.col("rank").alias("rb")), ["run", "b"]).where("ra < rb").select("run", "a", "b"))
    kept, left = None, ranked.select("run", "id", "rank")
    while True:
        open_above = above.join(left.select("run", F.col("id").alias("a")), ["run", "a"], "left_semi").select("run", F.col("b").alias("id")).distinct()
        now = checkpointed(left.join(open_above, ["run", "id"], "left_anti"))
        if now.isEmpty():
            return kept if kept is not None else now
        kept = now if kept is None else kept.union(now)
        beaten = above.join(now.select("run", F.col("id").alias("a")), ["run", "a"], "left_semi").select("run", F.col("b").alias("id")).distinct()
        left = checkpointed(left.join(now.select("run", "id"), ["run", "id"], "left_anti").join(beaten, ["run", "id"], "left_anti"))


def merged_by_slug(candidates: DataFrame) -> DataFrame:
    """(slug, name, document_ids) of (seq, name, document_ids): the first name of a slug, and all documents, each once, in the
    order in which they come."""
    named = candidates.select("seq", "name", slug(F.col("name")).alias("slug"), "document_ids")
    first = named.groupBy("slug").agg(F.min_by("name", "seq").alias("name"))
    each = named.select("slug", "seq", F.posexplode("document_ids").alias("pos", "doc")).groupBy("slug", "doc").agg(F.min(F.struct("seq", "pos")).alias("at"))
    docs = each.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "doc"))), lambda x: x["doc"]).alias("document_ids"))
    return first.join(docs, "slug", "left")
