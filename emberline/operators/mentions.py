"""Where terms occur in a corpus: n-gram equi joins instead of documents x terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import companies as companies_of
from emberline.functions.text import is_big_company, mentions

TOKEN = r"[\p{L}\p{N}_-]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def phrase_key(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def head_filter(heads: DataFrame, slots: int = 1 << 18) -> Column:
    """A column of one byte a slot, 1 where a head (a 64-bit hash) of `heads` falls: with at_slot() it tells, inside the scan,
    heads that are surely not among them. Its size is `slots` bytes whatever the number of heads; the more of them, the less it
    tells."""
    taken = bytearray(slots)
    for r in heads.select(F.pmod("head", F.lit(slots)).alias("at")).distinct().toLocalIterator():  # no more rows than slots
        taken[r["at"]] = 1
    return F.lit(bytes(taken))


def at_slot(taken: Column, head: Column, slots: int = 1 << 18) -> Column:
    """Whether a head may be one of head_filter()'s."""
    return F.substring(taken, F.pmod(head, F.lit(slots)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")


def term_mentions(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id): documents in which all of a term's tokens occur in a row.

    Terms are keyed by their first two tokens (or one), documents give the pairs of neighbours they have: the join is by
    equality on hashes, one row for a distinct pair that the terms' filter lets through, so that documents without a hit send
    nothing. Whether the whole phrase occurs is then looked up in the document's tokens; a document's tokens are joined to its
    found heads only.
    """
    keyed = terms.select("term", tokens(F.col("term")).alias("w")).where(F.size("w") > 0)
    heads = keyed.select("term", F.array_join("w", " ").alias("gram"), F.size("w").alias("k"), F.xxhash64(F.get("w", F.lit(0)), F.coalesce(F.get("w", F.lit(1)), F.lit(""))).alias("head"))
    taken = head_filter(heads)
    t = docs.select(doc_id, tokens(F.col(text)).alias("t"))
    pairs = t.select(doc_id, F.inline(F.arrays_zip(F.col("t").alias("a"), F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(1))).alias("b"))))
    hashed = pairs.select(doc_id, F.xxhash64("a", F.lit("")).alias("one"), F.xxhash64("a", F.coalesce("b", F.lit(""))).alias("two"))
    hits = hashed.where(at_slot(taken, F.col("one")) | at_slot(taken, F.col("two")))
    each = hits.select(doc_id, F.explode(F.array("one", "two")).alias("head")).distinct()
    found = each.join(heads, "head").select(doc_id, "term", "gram", "k")
    short = found.where("k <= 2").select("term", doc_id)
    asked = found.where("k > 2").groupBy(doc_id).agg(F.collect_set(F.struct("term", "gram")).alias("asked"))
    padded = docs.join(asked, doc_id).select(doc_id, F.concat(F.lit(" "), phrase_key(F.col(text)), F.lit(" ")).alias("_t"), "asked")
    whole = padded.select(doc_id, F.explode(F.filter("asked", lambda x: F.contains(F.col("_t"), F.concat(F.lit(" "), x["gram"], F.lit(" "))))).alias("x"))
    return short.union(whole.select("x.term", doc_id))


def item_mentions(docs: DataFrame, items: DataFrame, companies: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, doc_id, matched_by): which items documents mention, by their company, and if not, by their term. items: (item, term),
    companies: (item, name)."""
    named = companies.select("item", F.col("name").alias("term"), F.lit("company").alias("matched_by")).union(items.select("item", "term", F.lit("term").alias("matched_by")))
    hits = term_mentions(docs, named.select("term").distinct(), doc_id, text)
    return hits.join(named, "term").groupBy("item", doc_id).agg(F.min("matched_by").alias("matched_by"))  # company before term


def unique_companies(cells: DataFrame) -> DataFrame:
    """(name, item): companies of cells (item, cell) that occur for exactly one item, big ones left out."""
    each = cells.select("item", F.explode(companies_of(F.col("cell"))).alias("name")).select("item", F.lower("name").alias("name"))
    small = each.where(~is_big_company(F.col("name")))
    one = small.groupBy("name").agg(F.min("item").alias("item"), F.max("item").alias("other"))
    return one.where("item = other").select("name", "item")


def denied_in_top(top: DataFrame, deny: DataFrame) -> DataFrame:
    """(query, name, phrase): names of a top list (query, name) that hold a phrase which their query denies (query, phrase)."""
    return top.join(deny, "query").where(mentions(F.col("name"), F.col("phrase"))).select("query", "name", "phrase")


def loose_mentions(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id): documents that hold every token of a term, in any order. Tokens are joined and counted."""
    need = terms.select("term", F.array_distinct(tokens(F.col("term"))).alias("w")).select("term", F.size("w").alias("need"), F.explode("w").alias("token"))
    have = docs.select(doc_id, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
    return have.join(need, "token").groupBy("term", doc_id, "need").agg(F.count("*").alias("n")).where("n = need").select("term", doc_id)
