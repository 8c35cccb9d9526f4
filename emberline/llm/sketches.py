"""Document fingerprints: threshold-scaled sketches of word shingles (operator 4). DataFrame functions only."""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from emberline.llm.common import hashes_of, let, words_of

#: Words of a shingle, and the share 1 / SCALE of all hash values below which a shingle is retained.
K, SCALE = 5, 4
#: Ranges of ids at most; they bound what the driver holds.
MOST_RANGES = 1 << 16


def sketch(text: Column, k: int = K, scale: int = SCALE) -> Column:
    """The sorted distinct shingle hashes below the threshold (array<bigint>).

    Retaining depends on the hash alone, so sketches of parts merge by union and sketches of very unequal texts compare.
    A text of fewer than k words has one shingle, all its words; a text without words has its characters as one.
    """
    bound = (1 << 64) // scale - (1 << 63)  # of the signed range

    def shingles(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0)))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    hashes = let(words_of(text), lambda w: F.when(F.size(w) > 0, hashes_of(w)).otherwise(F.array(F.xxhash64(text))))
    kept = F.filter(let(hashes, shingles), lambda x: x < bound if scale > 1 else F.lit(True))
    return F.array_sort(F.array_distinct(kept))


def merged(sketches: Column) -> Column:
    """Aggregate: the sketch of a group's texts together."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches))))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of the smaller shingle set that is in the other; null if a sketch is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def fingerprint(text: Column, kept: Column) -> Column:
    """The sketch as text. Where no shingle is retained, the text's digest stands for it after a minus sign."""
    hexed = F.array_join(F.transform(kept, lambda x: F.lower(F.hex(x))), ",")
    return F.when(F.size(kept) > 0, hexed).otherwise(F.concat(F.lit("-"), F.sha2(text, 256)))


def likeness(a: Column, b: Column, print_a: Column, print_b: Column) -> Column:
    """Containment; between texts of which one has an empty sketch, 1 if the fingerprints are equal and else 0."""
    return F.coalesce(containment(a, b), (print_a == print_b).cast("double"))


def followed(docs: DataFrame, rows_in_range: int = 2000) -> DataFrame:
    """docs (doc_id, text) with `next`, the text of the row after in ascending doc_id (nulls first, ties by text), and of the
    first row for the last. Ids are numbers or strings; other columns are left out.

    Ids are cut into ranges of about `rows_in_range` rows by quantiles, so that each window is small; only the first
    text of each range goes to the range before, and only numbers of ranges are brought together. Equal ids are in one
    range, and so are strings that agree in the seven bytes after what all have in common.
    """
    n = docs.count()
    parts = min(MOST_RANGES, max(1, n // rows_in_range))
    code = _code_of(docs)
    cuts = docs.agg(F.percentile_approx(code, [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first()["q"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    at = _range_of(code, cuts) if cuts else F.lit(0)
    ranged = docs.select("doc_id", "text", at.alias("range"))
    order = [F.asc_nulls_first("doc_id"), F.asc("text")]
    heads = ranged.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "text")).alias("head"))
    ring = Window.orderBy("range")  # over one number a range, at most MOST_RANGES
    later = ranged.select("range").distinct().withColumn("later", F.coalesce(F.lead("range").over(ring), F.first("range").over(ring)))
    after = later.join(heads.select(F.col("range").alias("later"), F.col("head.text").alias("after")), "later").select("range", "after")
    inner = ranged.withColumn("next", F.lead("text").over(Window.partitionBy("range").orderBy(*order)))
    return inner.join(after, "range").select("doc_id", "text", F.coalesce("next", "after").alias("next"))


def _code_of(docs: DataFrame) -> Column:
    """A number that never falls as ids rise: of a string, the seven bytes after the start that all ids share."""
    if not isinstance(docs.schema["doc_id"].dataType, StringType):
        return F.col("doc_id")
    ends = docs.agg(F.encode(F.min("doc_id"), "UTF-8").alias("a"), F.encode(F.max("doc_id"), "UTF-8").alias("b")).first()
    shared = len(commonprefix([bytes(ends.a or b""), bytes(ends.b or b"")]))
    seven = F.substr(F.encode("doc_id", "UTF-8"), F.lit(shared + 1), F.lit(7))
    return F.conv(F.rpad(F.hex(seven), 14, "0"), 16, 10).cast("bigint")


def _range_of(x: Column, cuts: list) -> Column:
    """The number of cuts that are at most x, found in two steps; null counts as before all of them."""
    step = max(1, round(len(cuts) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda c: c <= x))
    every = F.array(*[F.lit(c) for c in cuts])
    coarse = below(F.array(*[F.lit(c) for c in cuts[::step]]))
    fine = (coarse - 1) * step + below(F.slice(every, (coarse - 1) * step + 1, F.lit(step)))
    return F.when(x.isNull() | (coarse < 1), F.lit(0)).otherwise(fine)
