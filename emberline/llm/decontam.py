"""Benchmark decontamination with Aho-Corasick automata (operator 6)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from emberline.llm.common import text_of, written

#: Words of a window; a document is contaminated if HITS_PER of its words, at least one in so many, are hit.
WINDOW, HITS_PER = 13, 20
#: Most characters of benchmark text in one automaton, which takes some 620 bytes a character (measured: 260 MB for 420,000), so
#: about 310 MB in each Python worker. A larger benchmark is searched for in as many passes as it needs, one automaton each.
BLOCK_CHARS = 500_000

# A-Z become a-z; the other ASCII characters but 0-9 and a-z part words; bytes of other characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RESULT = "struct<n_words:bigint,hits:array<struct<start:int,end:int,n:int>>,items:array<string>>"


def words_in(text: str) -> list[str]:
    return [w for w in text.encode().translate(_TABLE).decode().split(" ") if w]


#: The automaton at hand in a worker, by its block's name and window: one at a time.
_held: dict[tuple[str, int], tuple] = {}


def held(block: str, items: tuple[tuple[str, str], ...], window: int) -> tuple:
    """automaton(items, window), built once a worker; the one before is of no more use and goes first."""
    if (block, window) not in _held:
        _held.clear()
        _held[block, window] = automaton(items, window)
    return _held[block, window]


def automaton(items: tuple[tuple[str, str], ...], window: int) -> tuple[ahocorasick.Automaton | None, list[list[str]]]:
    """One automaton over the windows of all items; a window's value is (words, number in the list of the items that have it)."""
    owners: dict[str, set[str]] = {}
    for item, text in items:
        w = words_in(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            owners.setdefault(" ".join(w[i : i + window]), set()).add(item)
    lists: list[list[str]] = []
    if not owners:
        return None, lists
    a = ahocorasick.Automaton()
    for k, (phrase, who) in enumerate(owners.items()):
        a.add_word(f" {phrase} ", (phrase.count(" ") + 1, k))
        lists.append(sorted(who))
    a.make_automaton()
    return a, lists


def scanned(text: str, machine: ahocorasick.Automaton | None, lists: list[list[str]]) -> tuple[int, list[tuple[int, int, int]], list[str]]:
    """(words, [(start, end, words)] of merged hits as character offsets of the original text, sorted items)."""
    w = words_in(text)
    if not w or machine is None:
        return len(w), [], []
    joined = " " + " ".join(w) + " "
    found = list(machine.iter(joined))
    if not found:
        return len(w), [], []
    ends = np.cumsum([len(x) + 1 for x in w])  # place of the space after each word
    last = np.searchsorted(ends, [e for e, _ in found])
    hit = np.zeros(len(w) + 1, np.int32)
    np.add.at(hit, last + 1 - np.array([v[0] for _, v in found]), 1)
    np.add.at(hit, last + 1, -1)
    covered = np.cumsum(hit)[:-1] > 0
    # the translation keeps every character's place, so words are found again in the original by their order
    plain = text.encode().translate(_TABLE).decode()
    space = np.frombuffer(plain.encode("utf-32-le"), np.uint32) == 32
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    begins, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    edge = np.diff(np.r_[False, covered, False].astype(np.int8))
    spans = [(int(begins[a]), int(stops[b - 1]), int(b - a)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return len(w), spans, sorted({x for _, v in found for x in lists[v[1]]})


def blocks_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[tuple[str, str], ...]]:
    """The benchmark's items in blocks of at most `block_chars` characters (or one longer item), read as a stream: the driver
    holds one block at a time. One empty block if there are no items."""
    block, size, some = [], 0, False
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), text_of().alias("t")).where("t <> ''").orderBy("i", "t")
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > block_chars:
            yield tuple(block)
            block, size, some = [], 0, True
        block.append((r.i or "", r.t))
        size += len(r.t)
    if block or not some:
        yield tuple(block)


def _scan(shared, window: int):
    @arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        machine, lists = held(*shared.value, window)
        rows = [scanned(t or "", machine, lists) for t in texts.to_pylist()]
        return pa.array(
            [{"n_words": n, "hits": [{"start": a, "end": b, "n": c} for a, b, c in spans], "items": found} for n, spans, found in rows],
            pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n", pa.int32())]))), ("items", pa.list_(pa.string()))]),
        )

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with `n_words` and `hits` (start, end as character offsets of the original text, n words; merged and in order),
    `items` (sorted ids, as strings, of the benchmark items with an occurring window).

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. A window is `window` consecutive words of an
    item, or all words of a shorter item; an item without words has none. Null and empty texts have no words and no hits; a
    null item id counts as the empty id. Rows, repeated ones too, are judged one by one, without a shuffle. Other columns are
    carried along; one that is named n_words, hits or items gives way to the new one. An empty table stays empty. A block of
    items is broadcast with the task: its size is bounded by `block_chars`; items beyond that go to further automata, each a
    pass over the texts of its own that is written down, and the results are united row by row.
    """
    out = docs.drop("n_words", "hits", "items")
    docs = out
    names: list[str] = []
    for k, block in enumerate(blocks_of(benchmark, block_chars)):
        if names:
            out = written(out)  # one automaton at a time in a worker
        names.append(f"_scan{k}")
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))
        out = out.withColumn(names[-1], _scan(shared, window)(F.col("text")))
    if len(names) > 1:
        hits = F.array_sort(F.flatten(F.array(*[F.col(f"{n}.hits") for n in names])))
        items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{n}.items") for n in names]))))
        joined = union_of_spans(hits, F.col("text"))
        return out.select(*[F.col(c) for c in docs.columns], F.col(f"{names[0]}.n_words").alias("n_words"), joined.alias("hits"), items.alias("items"))
    return out.select(*[F.col(c) for c in docs.columns], F.col("_scan0.n_words").alias("n_words"), F.col("_scan0.hits").alias("hits"), F.col("_scan0.items").alias("items"))


def union_of_spans(hits, text):
    """Overlapping spans as one, words counted anew."""

    @arrow_udf("array<struct<start:int,end:int,n:int>>")
    def united(lists: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for spans, t in zip(lists.to_pylist(), texts.to_pylist()):
            kept: list[list[int]] = []
            for s in spans or []:
                if kept and s["start"] <= kept[-1][1]:
                    kept[-1][1] = max(kept[-1][1], s["end"])
                else:
                    kept.append([s["start"], s["end"]])
            out.append([{"start": a, "end": b, "n": len(words_in(t[a:b]))} for a, b in kept])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n", pa.int32())])))

    return united(hits, text)


def judged(scanned_docs: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: some word is hit, and at least one in HITS_PER."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return scanned_docs.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (HITS_PER * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, all columns whatever their names. Null and empty texts stay; repeated rows are judged
    alike; an empty table or an empty benchmark changes nothing."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("text").alias("text"))
    return judged(contamination(rows, benchmark)).where(~F.col("contaminated")).select("_row.*")
