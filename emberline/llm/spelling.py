"""Spelling variants: words one edit apart, found by walking a distributed trie level by level (operator 12).

The trie's nodes are the words and the longest common prefixes of words that are neighbours in sorted order, so that an edge
carries all characters between two nodes and long words cost no more levels than they share with others. Its edges are a
table; states (word, position, node, edits) are joined with it, a level a round, and those that end at a word with one edit
are neighbours.

Two words one edit apart differ first at a node of both: a state leaves its word's own path there, once. Words stand in the
trie forwards ("f" before them) and backwards ("r"), and paths are left in a word's second half only: an edit in the first
half lies in the second of the reversed word. So no state starts near the root, where edges are many and matches few. A pair
is looked for from one of its words: the shorter one, or the one with the smaller character where they differ.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from emberline.llm.common import text_of, unlink, written

#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 300_000
#: What stands for the end of a word where the next character is asked for.
END = ""


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, noise: int | None = None) -> DataFrame:
    """(word, n): maximal runs of Latin letters (A-Z in lower case) of at least `least_length` code points and `least_count`
    occurrences in all texts.

    With `noise` a run whose crc32 of "<id>:<run>" it divides loses its code point number crc32 % length first. Null texts have
    no words; a null id counts as an empty one; rows that repeat count again; other columns aren't looked at.
    """
    found = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                for word, n in Counter(found.findall(text.as_py().encode().lower().decode())).items():
                    if noise and (h := zlib.crc32(f"{key.as_py()}:{word}".encode())) % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    total[word] += n
                if len(total) > HELD_WORDS:
                    yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})
                    total.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("text")).mapInArrow(count, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _shared(strings: DataFrame) -> DataFrame:
    """(s, shared) of distinct strings (s): what each shares with the one before it in sorted order ("" for the first).

    Ranges of the order are read in order, and the first of a range is compared with the last of the ranges before."""

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for b in batches:
            strings = b.column(0).to_pylist()
            previous = [before, *strings[:-1]]
            before = strings[-1] if strings else before
            shared = [p if p is None else commonprefix([p, s]) for p, s in zip(previous, strings)]
            yield pa.RecordBatch.from_pydict({"s": pa.array(strings, pa.string()), "shared": pa.array(shared, pa.string()), "part": pa.array([part] * len(strings), pa.int32())})

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, p = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({"s": pa.array(s, pa.string()), "shared": pa.array([commonprefix([x, y]) for x, y in zip(s, p)], pa.string())})

    dealt = written(strings.repartitionByRange("s").sortWithinPartitions("s").mapInArrow(ordered, "s string, shared string, part int"))
    last = dealt.groupBy("part").agg(F.max("s").alias("last")).select("last", F.lead("part").over(W.orderBy("part")).alias("part"))  # a row a range
    first = dealt.where("shared is null").join(last, "part", "left").select("s", F.coalesce("last", F.lit("")).alias("last"))
    return dealt.where("shared is not null").select("s", "shared").union(first.mapInArrow(prefix, "s string, shared string"))


def trie_edges(words: DataFrame) -> DataFrame:
    """(node, label, child, terminal): the edges of the trie of words (s), with the roots "f" and "r" as nodes.

    A node's parent is what it shares with the node before it in sorted order: the nodes hold all common prefixes, so the
    longest proper one of two neighbours is among them."""
    roots = words.sparkSession.createDataFrame([("f", False), ("r", False)], "s string, terminal boolean")
    inner = _shared(words).select(F.col("shared").alias("s"), F.lit(False).alias("terminal"))
    nodes = written(words.select("s", F.lit(True).alias("terminal")).union(inner).union(roots).where("s <> ''").groupBy("s").agg(F.max("terminal").alias("terminal")))
    up = _shared(nodes.select("s")).join(nodes, "s").where("shared <> ''")
    return up.select(F.col("shared").alias("node"), F.substring("s", F.length("shared") + 1, F.length("s")).alias("label"), F.col("s").alias("child"), "terminal")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): distinct words (word) that differ by exactly one inserted, deleted or replaced code point, both ways round,
    each pair once.

    A row's work is bounded by a node's edges, of which there are no more than characters; a prefix that many words share only
    has many states, which are dealt out by AQE's skew join."""
    both = words.select(F.explode(F.array(F.concat(F.lit("f"), "word"), F.concat(F.lit("r"), F.reverse("word")))).alias("s"))
    both = written(both)
    edges = written(trie_edges(both))
    sub = lambda s, at, n: F.substring(F.col(s), at + 1, n)  # noqa: E731  code points from place `at` on
    x, at, size = F.col("x"), F.col("at"), F.length("label")
    ended = F.col("at") >= F.length("x")

    # a word's own path, from its end up to the first node of its second half: states without an edit
    up = edges.select(F.col("child").alias("u"), F.col("node").alias("parent"))
    own = both.select(F.col("s").alias("x"), F.col("s").alias("u"))
    path = own
    while not own.isEmpty():
        higher = own.join(up, "u").select("x", F.col("parent").alias("u"))
        own = written(higher.where(F.length("u") >= 1 + F.floor((F.length("x") - 1) / 2)))
        path = path.union(own)
    path = path.select("x", "u", F.length("u").alias("at"))

    # edges by the character after their first: a label's second one, or the first of an edge below, or the end
    first = F.substring("label", 1, 1)
    below = edges.select(F.col("node").alias("child"), first.alias("second"))
    one = edges.where(size == 1)
    by_second = edges.where(size > 1).withColumn("second", F.substring("label", 2, 1)).select("node", "second", "label", "child", "terminal")
    by_second = by_second.union(one.join(below, "child").select("node", "second", "label", "child", "terminal"))
    by_second = by_second.union(one.where("terminal").select("node", F.lit(END).alias("second"), "label", "child", "terminal"))

    # a state takes an edge not its own: its first character replaces the word's (skip 1) or is put before it (skip 0), and
    # the rest of the label has to follow
    own_first = sub("x", at, F.lit(1))
    ways = F.array(F.when(~ended, F.struct(F.lit(1).alias("skip"), sub("x", at + 1, F.lit(1)).alias("key"))), F.struct(F.lit(0).alias("skip"), own_first.alias("key")))
    keyed = path.select("x", "u", "at", own_first.alias("own"), F.explode(F.array_compact(ways)).alias("way")).select("x", "u", "at", "own", "way.*")
    met = keyed.join(by_second.withColumnRenamed("node", "u").withColumnRenamed("second", "key"), ["u", "key"])
    other = F.when(F.col("skip") == 1, first > F.col("own")).otherwise(first != F.col("own"))
    follows = (size == 1) | (sub("label", F.lit(1), size) == sub("x", at + F.col("skip"), size - 1))
    live = written(met.where(other & follows).select("x", F.col("child").alias("u"), (at + F.col("skip") + size - 1).alias("at"), F.col("terminal").alias("is_word")))

    found = []
    step = edges.withColumn("key", first).withColumnRenamed("node", "u")
    while not live.isEmpty():
        found.append(live.where(ended & F.col("is_word")).select("x", "u"))
        met = live.where(~ended).withColumn("key", sub("x", at, F.lit(1))).drop("is_word").join(step, ["u", "key"])
        live = written(met.where(F.col("label") == sub("x", at, size)).select("x", F.col("child").alias("u"), (at + size).alias("at"), F.col("terminal").alias("is_word")))
    pairs = live.select("x", "u").where("false")
    for f in found:
        pairs = pairs.union(f)
    plain = lambda c: F.when(F.substring(c, 1, 1) == "f", sub(c, F.lit(1), F.length(c))).otherwise(F.reverse(sub(c, F.lit(1), F.length(c))))
    pairs = pairs.select(plain("x").alias("word"), plain("u").alias("near")).distinct()
    return pairs.select(F.explode(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))).alias("p")).select("p.*")


def variant_groups(counts: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words and their numbers (word, n).

    A word's form is its near word of the largest n (ties: the smallest in code-point order), if that is at least `ratio` times
    the word's own n; its root is where forms end. An empty table gives none. Words have to be distinct, as word_counts()
    gives them; other columns aren't looked at."""
    counts = written(counts.select("word", "n"))
    near = near_words(counts.select("word")).join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("o"), "near")).alias("b"))
    form = (-F.col("b.o") >= ratio * F.col("n")) & F.col("b").isNotNull()
    out = written(counts.join(best, "word", "left").select("word", F.when(form, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(form, -F.col("b.o")).alias("form_n")))
    # each step multiplies n by the ratio at least, so that chains are short; each round doubles what is followed
    root = written(out.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = written(root.join(root.select(F.col("word").alias("root"), F.col("root").alias("last")), "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")))
        moved = not further.where("moved").isEmpty()
        unlink(root)
        root = further.select("word", "root")
        root.written_path = further.written_path
        if not moved:
            return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
