"""Fuzzy line deduplication: MinHash of word triples, edit similarity, one occurrence a group (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StringType

from emberline.llm import omh
from emberline.llm.common import steps_freed, text_of, unlink, written

#: Lines of fewer words have no fuzzy partner: at edit similarity 0.8 they are equal. Where the caller doesn't say otherwise, equal ones stay too.
MIN_WORDS = 4
#: Keys a line (a power of two), and the least edit similarity of a link.
KEYS, SIMILARITY = 8, 0.8

# A-Z become a-z; other ASCII characters but digits and newlines part words; bytes of other characters belong to words.
_TABLE = bytes(10 if c == 10 else c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_R, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Characters that are hashed together.
_CHUNK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (base, pow(base, -1, 1 << 64)))
    return up, down


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[s:e] for each span, from prefix sums of a polynomial."""
    n = 1 << max(12, int(len(values)).bit_length())
    up, down = _powers(base, n)
    total = np.r_[np.uint64(0), np.cumsum(values * up[: len(values)])]
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _unspaced(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes with East Asian punctuation as spaces; where a character of a script without spaces starts or has ended).
    Chinese, Japanese, Thai, Lao; each such character is a word."""
    none = np.zeros(len(b), bool)
    if not len(b) or b.max() < 0xE0:
        return b, none
    second, third = np.r_[b[1:], np.uint8(0)], np.r_[b[2:], np.zeros(min(2, len(b)), np.uint8)]
    wide = (b == 0xE3) & (second == 0x80) & ~((third >= 0x85) & (third <= 0x87))
    wide |= (b == 0xEF) & (second == 0xBC) & ((third <= 0x8F) | (third >= 0x9A) & (third <= 0xA0) | (third >= 0xBB))
    wide |= (b == 0xEF) & (second == 0xBD) & ((third == 0x80) | (third >= 0x9B) & (third <= 0xA5))
    at = np.flatnonzero(wide)
    if len(at):
        b = b.copy()
        b[(at[:, None] + np.arange(3)).ravel()] = 32
    starts = np.flatnonzero((b >= 0xE3) & (b <= 0xE9) | (b == 0xE0) & (second >= 0xB8) & (second <= 0xBB))
    none[starts] = True
    none[(starts + 3)[starts + 3 < len(b)]] = True
    return b, none


def hashed_lines(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each line, and after the last line the number of words; hash of each line)."""
    b, cut = _unspaced(np.frombuffer(text.lower().encode().translate(_TABLE), np.uint8))
    apart = (b == 32) | (b == 10)
    before = np.r_[False, ~apart]
    starts, ends = np.flatnonzero(~apart & (~before[:-1] | cut)), np.flatnonzero(before & np.r_[apart | cut, True])
    words = _spans(b.astype(np.uint64), starts, ends, _R)
    first = np.searchsorted(starts, np.r_[0, np.flatnonzero(b == 10) + 1])
    first = np.r_[first, len(words)]
    return words, first, _spans(words, first[:-1], first[1:], _Q)


def _triples(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word of lines that lie one after another (none empty) the hash of it with its neighbours in the line. In a run
    of the same triple each counts as another one, so that lines of one repeated word differ by their lengths."""
    n = np.diff(first)
    inner = np.arange(len(words)) - np.repeat(first[:-1], n)
    none = np.uint64(0)
    left, right = np.r_[none, words[:-1]], np.r_[words[1:], none]
    left[first[:-1]] = right[first[1:] - 1] = none
    with np.errstate(over="ignore"):
        h = _mix((left * np.uint64(_R) + words) * np.uint64(_Q) + right)
        again = np.flatnonzero((h[1:] == h[:-1]) & (inner[1:] > 0)) + 1
        if len(again):
            start = np.ones(len(h), bool)
            start[again] = False
            at = np.arange(len(h))
            h += (at - np.maximum.accumulate(np.where(start, at, 0))).astype(np.uint64) * np.uint64(_Q)
    return h


def _seeds(numbers: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix((numbers + 1).astype(np.uint64) * np.uint64(_R))


def line_keys(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """KEYS 64-bit keys a line (rows): the least of its word triples under as many orders, with the order's number in the last
    bits. first: of lines that lie one after
    another, none empty.

    A changed word touches three triples, so lines at edit similarity 0.8 share about half of n triples of some 1.5 n: a key
    agrees in one case of three, one of 8 in 95 of 100 cases.
    """
    if len(first) < 2:
        return np.empty((0, KEYS), np.uint64)
    h = _triples(words, first)
    with np.errstate(over="ignore"):
        least = np.stack([_mix(np.minimum.reduceat(h * (seed | np.uint64(1)), first[:-1])) for seed in _seeds(np.arange(KEYS))], axis=1)  # triples are mixed already
    return least & ~np.uint64(KEYS - 1) | np.arange(KEYS, dtype=np.uint64)


def _chunks(texts: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts put together up to _CHUNK characters, with the row and the line number of each line."""
    held: list[str] = []
    rows: list[np.ndarray] = []
    numbers: list[np.ndarray] = []
    size = 0
    for i, t in enumerate(texts.to_pylist()):
        n = t.count("\n") + 1
        held.append(t)
        rows.append(np.full(n, i))
        numbers.append(np.arange(n))
        size += len(t)
        if size >= _CHUNK:
            yield "\n".join(held), np.concatenate(rows), np.concatenate(numbers)
            held, rows, numbers, size = [], [], [], 0
    if held:
        yield "\n".join(held), np.concatenate(rows), np.concatenate(numbers)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line_no, h, codes): every line of every whole text with exact_words words at least, and its hash. The first of equal
    lines of MIN_WORDS words in each part of the input has its words, 32 bits each, too; for others they are null. Two of some
    10^9 pairs of unequal words count as equal in the alignment."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[int] = set()
        for batch in batches:
            for text, row, number in _chunks(batch.column(1)):
                words, first, h = hashed_lines(text)
                n = np.diff(first)
                held = np.flatnonzero(n >= exact_words)
                _, new = np.unique(h, return_index=True)
                new = new[n[new] >= max(MIN_WORDS, exact_words)]
                new = np.sort(np.array([i for i, v in zip(new.tolist(), h[new].tolist()) if v not in had], np.int64))
                had.update(h[new].tolist())
                # the words of the new lines, one after another
                ends = np.r_[0, np.cumsum(n[new])]
                own = words[np.repeat(first[new] - ends[:-1], n[new]) + np.arange(ends[-1])]
                codes = pa.Array.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(ends.astype(np.int64) * 4), pa.py_buffer((own >> np.uint64(32)).astype("<u4"))]).cast(pa.binary())
                at = np.full(len(h), -1)
                at[new] = np.arange(len(new))
                place = pa.array(at[held], mask=at[held] < 0)
                columns = [batch.column(0).take(pa.array(row[held])), pa.array(number[held].astype(np.int32)), pa.array(h[held].view(np.int64)), codes.take(place)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line_no", "h", "codes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(hashed, f"doc_id {kind}, line_no int, h bigint, codes binary")


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key) of (id, codes): a row for each of the line_keys() of the words of each line."""
    for batch in batches:
        words, first = omh._flat(batch.column(1), "<u4")
        keys = line_keys(words.astype(np.uint64), first)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), KEYS)), pa.array(keys.ravel().view(np.int64))], ["id", "key"])


@arrow_udf(ArrayType(LongType()))
def bounds_of(codes: pa.Array) -> pa.Array:
    """omh.counted_bounds() of each line."""
    return omh.counted_bounds(*omh._flat(codes, "<u4"))


def line_groups(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id -> component) of the lines that have a fuzzy partner. lines: lines_of()."""
    own = lines.where("codes is not null").select(F.col("h").alias("id"), "codes")
    held = written(omh.shared_keys(own.mapInArrow(keyed, "id bigint, key bigint"), lines.count() * KEYS))
    bounds = written(own.select("id", bounds_of("codes").alias("bound")))
    _, groups = omh.linked(held, bounds, own.select("id", F.lit(0).alias("rank"), "codes"), similarity)
    unlink(held)
    unlink(bounds)
    return groups


def repeats(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", exact_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, gone): for each document that loses lines, the sorted numbers of its lines that repeat an earlier one.

    A group is a connected component of lines with equal words (exact_words of them at least) or, among lines of MIN_WORDS
    words at least with a common key, an edit similarity of the words of at least `similarity`. The occurrence with the
    least (doc_id, line_no) stays.
    """
    with steps_freed() as result:
        seen = written(lines_of(docs, id_col, text_col, exact_words))
        groups = line_groups(seen, similarity)
        distinct = seen.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
        labelled = distinct.join(groups.select(F.col("id").alias("h"), "component"), "h", "left").withColumn("g", F.coalesce("component", "h"))
        heads = labelled.groupBy("g").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1")
        kept = written(labelled.join(heads.select("g", "keep"), "g").select("h", "keep"))
        gone = seen.join(kept, "h").where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("keep")))
        return result(written(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", exact_words: int = MIN_WORDS) -> DataFrame:
    """docs, all rows and columns, with the repeated lines taken out of the text; n_lines_removed is left to repeats().

    Lines are split at newlines, of any length. Equal lines of exact_words words at least go (1: every line that has a word);
    lines of fewer than MIN_WORDS words have no other partners at edit similarity 0.8. Words are runs of letters and digits
    without case; characters beyond ASCII count as letters, and each character of a script without spaces as a word. Null
    texts stay null and empty texts empty; a document may become empty. Rows with the same doc_id count as one document
    (their line numbers are taken together, so what one of them loses the others lose at the same place); a null doc_id
    sorts first. An empty table stays empty. Other columns are carried along, whatever their names.
    """
    names = docs.columns
    gone = repeats(docs, similarity, id_col, text_col, exact_words).select(F.col("doc_id").alias("_line_doc"), F.col("gone").alias("_line_gone"))
    both = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_line_doc")), "left")
    loses = F.col("_line_gone").isNotNull()
    kept = F.when(loses, _without(F.when(loses, F.col(text_col)), F.col("_line_gone"))).otherwise(F.col(text_col))
    return both.select(*[kept.alias(c) if c == text_col else F.col(c) for c in names])


@arrow_udf(StringType())
def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines of these numbers."""
    out: list[str | None] = []
    for text, numbers in zip(texts.to_pylist(), gone.to_pylist()):
        away = set(numbers or ())
        out.append(text if text is None else "\n".join(line for i, line in enumerate(text.split("\n")) if i not in away))
    return pa.array(out, pa.string())
