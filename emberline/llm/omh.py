"""Near-duplicate documents by Order MinHash, verified by banded alignment (operator 9)."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, LongType, StructField, StructType

from emberline.llm.common import components, hashes_of, steps_freed, text_of, unlink, words_of, written

#: Words in a k-mer; in the second family, which short documents get besides.
K, SHORT_K, SHORT_WORDS = 3, 2, 50
#: Sketches a document, k-mers a sketch, and the least edit similarity of a link.
SKETCHES, KEPT, SIMILARITY = 40, 2, 0.8
#: Words a rare run, counted in so many slots.
RARE_RUN, SLOTS = 2, 1 << 16
#: 64-bit words of a document's bound().
BOUND_LONGS = 8
#: Bits a slot of counted_bounds(), and the slots of the least and the greatest one (powers of two, 64 at least).
PLANES, LEAST_SLOTS, MOST_SLOTS = 3, 64, 512
#: Words up to which no bounds are tried before the alignment, since it costs less.
SHORT_ALIGNED = 100
#: Words up to which a text's alignment holds a column of the band as the bits of one number; longer texts go by diagonals up to
#: FEW_EDITS edits and beyond that row by row, with memory for the band alone.
BIT_WORDS, FEW_EDITS = 20_000, 64
#: Pairs that are sent to the texts at once (some 80 MB an executor).
FEW_PAIRS = 1_000_000
#: Rows a task of shared_keys() and of linked(). Members up to which a bucket's pairs are made together with those of other
#: buckets, members of a bucket that all meet in one task, and possible pairs a member beyond which texts meet in blocks.
KEY_ROWS, MET_ROWS, FEW_MEMBERS, BUCKET, MANY_PAIRS = 4_000_000, 1_000_000, 16, 8192, 32
#: Texts up to which those of large buckets all meet in blocks (more meet by their rarest runs before), and a block's bytes and texts at most.
FEW_TEXTS, BLOCK_BYTES, BLOCK_TEXTS = 12_000, 1 << 18, 256
#: Meetings of two blocks that go at once in any case.
LEAST_MEETINGS = 256

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _occurrence_labelled(h: np.ndarray) -> np.ndarray:
    """Each k-mer's hash joined with how often it has occurred before in the text."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if new.all():
        return h
    at = np.arange(len(h))
    rank = np.empty(len(h), np.uint64)
    rank[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return h + rank * _MULT


def least_kmers(words: np.ndarray, k: int, numbers: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, places) of the `take` least occurrence-labelled k-mers, or all, in each of the orders `numbers`; ascending."""
    n = max(1, len(words) - k + 1)
    w, h = words[:k], np.zeros(n, np.uint64)
    take = min(take, n)
    rows = max(1, 4_000_000 // n)
    at = np.empty((len(numbers), take), np.int64)
    with np.errstate(over="ignore"):
        for j in range(len(w)):
            h = h * _MULT + words[j : j + n]
        label = _occurrence_labelled(_mix(h))
        seeds = _seeds(k, numbers)
        for a in range(0, len(numbers), rows):
            v = ((label[None, :] * (seeds[a : a + rows, None] | np.uint64(1))) >> np.uint64(32)).astype(np.uint32)  # labels are mixed already
            part = np.argpartition(v, take - 1, axis=1)[:, :take] if n > take else np.tile(np.arange(n), (len(v), 1))
            order = np.argsort(np.take_along_axis(v, part, 1), axis=1, kind="stable")
            at[a : a + rows] = np.take_along_axis(part, order, 1)
    return label, at


def _seeds(k: int, numbers: np.ndarray) -> np.ndarray:
    return _mix((numbers.astype(np.uint64) + np.uint64(1 + 1000 * k)) * _MULT)


def sketch(words: np.ndarray, k: int, sketches: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """One 64-bit key a sketch: the hash of its `kept` least occurrence-labelled k-mers, in the order of the text. The labels are
    part of the key, so that texts of one repeated word share keys by their lengths."""
    numbers = np.arange(sketches)
    label, at = least_kmers(words, k, numbers, kept)
    at = np.sort(at, axis=1)
    with np.errstate(over="ignore"):
        keys = _seeds(k, numbers)
        for j in range(at.shape[1]):
            keys = _mix(keys * _MULT + label[at[:, j]])
    return keys


def _runs(words: np.ndarray) -> np.ndarray:
    """A hash of each run of RARE_RUN words."""
    n = max(0, len(words) - RARE_RUN + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(RARE_RUN):
            h = _mix(h * _MULT + words[j : j + n].astype(np.uint64) + np.uint64(1))
    return h


def rare_runs(words: np.ndarray, weight: np.ndarray, similarity: float) -> np.ndarray:
    """Labels of a text's rarest runs of RARE_RUN words, its n-th occurrence of a run being another one than the first: one more
    than may lack in a text of that edit similarity. An edit breaks RARE_RUN runs of the longer text of m words at most, which
    leaves m - 1 - RARE_RUN * (1 - similarity) * m that both have, so of a text's own n - 1 runs no more than n - m + RARE_RUN *
    (1 - similarity) * m, greatest where m is n, may lack. Each two such texts share one of these labels (prefix filter), whatever
    order the weights of the SLOTS give; frequent runs last make few candidates. Runs part texts that single words don't."""
    with np.errstate(over="ignore"):
        h = _runs(words)
        label = _occurrence_labelled(h) if len(h) else h
    order = np.lexsort((label, weight[h % np.uint64(SLOTS)]))
    return label[order[: int(RARE_RUN * (1 - similarity) * len(words) + 1e-9) + 1]]


def rare_runs_of(weight: np.ndarray, similarity: float, kind: str = "<u4"):
    """rare_runs() of a column of codes."""

    @arrow_udf(ArrayType(LongType()))
    def rare(codes: pa.Array) -> pa.Array:
        each = [rare_runs(np.frombuffer(c.as_buffer(), kind), weight, similarity) for c in codes]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in each])], pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *each]).view(np.int64)))

    return rare


def slots_by(kind: str = "<u4"):
    """The slots of a text's runs, each once."""

    @arrow_udf(ArrayType(LongType()))
    def slots(codes: pa.Array) -> pa.Array:
        return pa.array([np.unique(_runs(np.frombuffer(c.as_buffer(), kind)) % np.uint64(SLOTS)).astype(np.int64) for c in codes], pa.list_(pa.int64()))

    return slots


@arrow_udf(ArrayType(LongType()))
def sketches_of(hashes: pa.Array) -> pa.Array:
    flat, at = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))]
    out, ends = [np.empty(0, np.uint64)], [0]
    for a, b in zip(at[:-1], at[1:]):
        n = b - a
        if n:
            out.append(sketch(flat[a:b], K))
            if n <= SHORT_WORDS:
                out.append(sketch(flat[a:b], SHORT_K))
        ends.append(ends[-1] + SKETCHES * (n > 0) + SKETCHES * (0 < n <= SHORT_WORDS))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out).view(np.int64)))


@arrow_udf(BinaryType())
def codes_of(hashes: pa.Array) -> pa.Array:
    """A text's words, 32 bits each, as one value. Two of some 10^9 pairs of unequal words count as equal in the alignment."""
    flat, at = (hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(32)).astype("<u4"), np.r_[0, np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))]
    return pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())


def bound(words: np.ndarray, longs: int) -> np.ndarray:
    """What _room() compares: how many words there are, and a bit of 64 * longs for each word."""
    bits = np.zeros(64 * longs, bool)
    bits[(words >> np.uint64(20)) % np.uint64(64 * longs)] = True
    return np.r_[len(words), np.packbits(bits, bitorder="little").view(np.int64)]


@arrow_udf(ArrayType(LongType()))
def bounds_of(hashes: pa.Array) -> pa.Array:
    flat, at = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))]
    values = [bound(flat[a:b], BOUND_LONGS) for a, b in zip(at[:-1], at[1:])]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * (BOUND_LONGS + 1), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *values])))


def counted_bounds(words: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Like bound(), for each text of words[first[i] : first[i + 1]], but by how often its words occur: the n-th occurrence of a word
    is another one than the first, each falls into a slot, and bits of PLANES tell that a slot has one, two, three or more. Slots
    grow with the text, so that long texts and texts of a few words again and again are told apart; see _folded() for two sizes."""
    n = np.diff(first)
    slots = np.full(len(n), LEAST_SLOTS)
    while len(grow := np.flatnonzero((slots < n) & (slots < MOST_SLOTS))):
        slots[grow] *= 2
    key = np.sort(np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(32), n) | words.astype(np.uint64) & np.uint64(0xFFFFFFFF))
    row, at = (key >> np.uint64(32)).astype(np.int64), np.arange(len(key))
    rank = at - np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]][: len(key)], at, 0))
    with np.errstate(over="ignore"):
        slot = (_mix((key & np.uint64(0xFFFFFFFF)) * _MULT + rank.astype(np.uint64) * np.uint64(0x94D049BB133111EB)) >> np.uint64(20)).astype(np.int64) % slots[row]
    starts = np.r_[0, np.cumsum(PLANES * slots)]
    times = np.bincount(starts[row] + slot, minlength=starts[-1])
    held = times > 0
    for p in range(1, PLANES):
        more = np.flatnonzero(times > p)
        held[more + p * slots[np.searchsorted(starts, more, "right") - 1]] = True
    ends = np.r_[0, np.cumsum(1 + PLANES * slots // 64)]
    out = np.empty(ends[-1], np.int64)
    bits = np.ones(len(out), bool)
    bits[ends[:-1]] = False
    out[ends[:-1]], out[bits] = n, np.packbits(held, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))


def within(x: np.ndarray, y: np.ndarray, band: int) -> bool:
    """Whether the edit distance of two word sequences is at most `band`; cheap bounds first, then exact alignment."""
    n, m = len(x), len(y)
    if abs(n - m) > band:
        return False
    least = min(n, m)
    same = x[:least] == y[:least]
    if n == m and n - np.count_nonzero(same) <= band:
        return True
    # equal words at both ends are laid on one another
    a = least if same.all() else int(same.argmin())
    same = x[n - least + a :][::-1] == y[m - least + a :][::-1]
    b = least - a if same.all() else int(same.argmin())
    x, y = x[a : n - b], y[a : m - b]
    if max(len(x), len(y)) <= band:
        return True
    if max(len(x), len(y)) <= SHORT_ALIGNED:
        return _bits_within(x.tolist(), y.tolist(), band)
    _, number = np.unique(np.r_[x, y], return_inverse=True)
    x, y = number[: len(x)].astype(np.int32), number[len(x) :].astype(np.int32)
    if any(_shared_runs(x, y, q) < max(len(x), len(y)) - q + 1 - q * band for q in (1, 2, 3)):
        return False
    if _anchored(x, y) <= band:
        return True
    if max(len(x), len(y)) <= BIT_WORDS:
        return _bits_within(x.tolist(), y.tolist(), band)
    few = min(band, FEW_EDITS)
    found = _few_edits(x, y, few)
    return found if found or few == band else _banded(x, y, band)


def _shared_runs(x: np.ndarray, y: np.ndarray, q: int) -> int:
    """How many runs of q words two numbered texts share, each as often as both have it. An edit breaks q of them at most."""
    if min(len(x), len(y)) < q:
        return 0
    base = np.int64(max(x.max(), y.max()) + 1)
    runs = []
    for v in (x, y):
        h = v[: len(v) - q + 1].astype(np.int64)
        for j in range(1, q):
            h = h * base + v[j : len(v) - q + 1 + j]
        runs.append(h)
    _, number = np.unique(np.concatenate(runs), return_inverse=True)
    counts = [np.bincount(v, minlength=number.max() + 1) for v in (number[: len(runs[0])], number[len(runs[0]) :])]
    return int(np.minimum(*counts).sum())


def _bits_within(x: list[int], y: list[int], band: int) -> bool:
    """Whether the edit distance is at most `band`: a column of the band at a time, its vertical differences as bits.

    Bit b of column j is row j - band + b. Along the diagonal that ends at the last words the distance never falls.
    """
    if len(x) < len(y):
        x, y = y, x
    off = len(x) - len(y)
    places: dict[int, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    mask = (1 << 2 * band + 1) - 1
    end, distance = 1 << band + off, off
    up, down = mask & ~((1 << band) - 1), 0
    for j, w in enumerate(y):
        at = places.get(w, 0)
        at = (at >> j - band if j >= band else at << band - j) & mask
        same = (((at & up) + up) ^ up | at | down) & mask
        if not same & end:
            distance += 1
            if distance > band:
                return False
        right, left = down | mask & ~(same | up), same & up
        same >>= 1
        up, down = left | mask & ~(same | right), same & right
    return distance <= band


def _anchored(x: np.ndarray, y: np.ndarray) -> int:
    """The edits of one alignment, so at least the distance: runs of four words that each text has once are laid on one
    another, as many as stay in order, and between them words are replaced place by place or as a whole."""
    n, m = len(x), len(y)
    if min(n, m) < 8:
        return n + m
    with np.errstate(over="ignore"):
        grams = [((v[:-3] * _MULT + v[1:-2]) * _MULT + v[2:-1]) * _MULT + v[3:] for v in (x.astype(np.uint64), y.astype(np.uint64))]
    once = []
    for g in grams:
        u, at, times = np.unique(g, return_index=True, return_counts=True)
        once.append((u[times == 1], at[times == 1]))
    _, a, b = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    i, j = once[0][1][a], once[1][1][b]
    order = np.argsort(i)
    i, j = i[order].tolist(), j[order].tolist()
    tails: list[int] = []  # the last place of the best chain of each length, and which pair it is
    which: list[int] = []
    before = []
    for p, v in enumerate(j):
        c = bisect_left(tails, v)
        before.append(which[c - 1] if c else -1)
        if c == len(tails):
            tails.append(v)
            which.append(p)
        else:
            tails[c], which[c] = v, p
    chain, p = [(n, m)], which[-1] if which else -1
    while p >= 0:
        chain.append((i[p], j[p]))
        p = before[p]
    cost, u, v = 0, 0, 0
    for s, t in reversed(chain):
        if s - u == t - v:
            cost += int(np.count_nonzero(x[u:s] != y[v:t])) if s > u else 0
        else:
            cost += max(s - u, t - v)
        u, v = s + 1, t + 1
    return cost


def _few_edits(x: np.ndarray, y: np.ndarray, most: int) -> bool:
    """Furthest-reaching alignment by diagonals; each diagonal's mismatches are found once."""
    n, m = len(x), len(y)
    differ: dict[int, list[int]] = {}

    def slide(i: int, k: int) -> int:
        if k not in differ:
            a, b = max(0, -k), min(n, m - k)
            differ[k] = (np.flatnonzero(x[a:b] != y[a + k : b + k]) + a).tolist() + [b] if b > a else [a]
        at = differ[k]
        return max(i, at[min(bisect_left(at, i), len(at) - 1)])

    reach = {0: slide(0, 0)}
    for d in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return True
        new = {}
        for k in range(max(-d - 1, -n), min(d + 1, m) + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -1), reach.get(k + 1, -2) + 1)
            if i >= 0:
                i = min(i, n, m - k)
                if i + k >= 0:
                    new[k] = slide(i, k)
        reach = new
    return False


def _banded(x: np.ndarray, y: np.ndarray, band: int) -> bool:
    """Row by row over the band of diagonals."""
    n, m, far = len(x), len(y), band + 1
    k = np.arange(-band, band + 1)
    row = np.where((k >= 0) & (k <= m), k, far)
    padded = np.concatenate([np.full(band + 1, -1, np.int32), y.astype(np.int32), np.full(band + n + 2, -1, np.int32)])
    for i in range(1, n + 1):
        other = padded[i : i + 2 * band + 1]
        new = np.minimum(row + (other != x[i - 1]), np.r_[row[1:], far] + 1)
        j = i + k
        new = np.where((j < 0) | (j > m), far, np.where(j == 0, i, new))
        new = np.minimum.accumulate(new - k) + k
        row = np.minimum(np.where((j < 0) | (j > m), far, new), far)
        if row.min() > band:
            return False
    return bool(row[m - n + band] <= band)


def _aligned(similarity: float, kind: str):
    @arrow_udf(BooleanType())
    def aligned(xs: pa.Array, ys: pa.Array) -> pa.Array:
        (x, a), (y, b) = (_flat(v, kind) for v in (xs, ys))
        n, m = np.diff(a), np.diff(b)
        band = ((1 - similarity) * np.maximum(n, m) + 1e-9).astype(np.int64)
        # pairs of one length: all compared place by place together
        out, same = np.zeros(len(n), bool), np.flatnonzero((n == m) & (n > 0))
        if len(same):
            ends = np.cumsum(n[same])
            inner = np.arange(ends[-1]) - np.repeat(ends - n[same], n[same])
            differ = x[np.repeat(a[same], n[same]) + inner] != y[np.repeat(b[same], n[same]) + inner]
            out[same] = np.add.reduceat(differ, ends - n[same], dtype=np.int64) <= band[same]
        for i in np.flatnonzero(~out & (np.abs(n - m) <= band)).tolist():
            out[i] = within(x[a[i] : a[i + 1]], y[b[i] : b[i + 1]], int(band[i]))
        return pa.array(out)

    return aligned


def _flat(codes: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all words, where each text's words begin and, after the last, end) of a binary column without nulls."""
    at = np.frombuffer(codes.buffers()[1], np.int64 if pa.types.is_large_binary(codes.type) else np.int32, len(codes) + 1, codes.offset * (8 if pa.types.is_large_binary(codes.type) else 4)).astype(np.int64)
    data = codes.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return np.frombuffer(flat.tobytes(), kind), (at - at[0]) // np.dtype(kind).itemsize


def verified(pairs: DataFrame, codes: DataFrame, similarity: float, kind: str = "<u4", few: bool = False) -> DataFrame:
    """Those rows, with a, b and any other columns, whose word sequences (codes: id, codes) align within the band that the similarity leaves.
    few: whether the pairs are known to be some FEW_PAIRS at most."""
    left = codes.select(F.col("id").alias("a"), F.col("codes").alias("x"))
    right = codes.select(F.col("id").alias("b"), F.col("codes").alias("y"))
    first = left.join(F.broadcast(pairs), "a") if few else pairs.hint("merge").join(left, "a")
    both = first.hint("merge").join(right, "b")  # both sides grow with the input
    most = F.greatest(F.length("x"), F.length("y"))
    close = both.where(F.abs(F.length("x") - F.length("y")) <= (1 - similarity) * most + 1e-9)
    return close.where(_aligned(similarity, kind)(F.col("x"), F.col("y"))).select(*pairs.columns)


def tasks_for(rows: int, each: int, spark: SparkSession) -> int:
    """How many tasks so many rows are dealt to, `each` a task at most if they lie evenly."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def shared_keys(rows: DataFrame, most: int) -> DataFrame:
    """(id, key), each once, of the keys that more than one id has. rows: (id, key), again and again perhaps, `most` of them."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, False  # the last row, whose successor is still to come, and whether the row before it has its key
        for batch in batches:
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            key, again = rows["key"].to_numpy(), _again(rows)
            rows, key = rows.filter(pa.array(~again)), key[~again]
            same = np.r_[before, key[1:] == key[:-1]]
            yield from rows.slice(0, len(key) - 1).filter(pa.array((same[:-1] | same[1:])[: len(key) - 1])).to_batches()
            last, before = rows.slice(len(key) - 1).combine_chunks().to_batches()[0], bool(same[-1])
        if before:
            yield last

    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.select("id", "key").repartition(tasks_for(most, KEY_ROWS, rows.sparkSession), "key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(shared, f"id {kind}, key bigint")


def _again(rows: pa.Table) -> np.ndarray:
    """Whether a row has the key and the id of the one before it."""
    key, ids = rows["key"].to_numpy(), rows["id"].combine_chunks()
    if not len(rows):
        return np.zeros(0, bool)
    return np.r_[False, (key[1:] == key[:-1]) & pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)]


def _lacking(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows of bits (last axis), the most that one has and the other lacks."""
    count = lambda u, v: sum(np.bitwise_count(u[..., k] & ~v[..., k]).astype(np.uint16) for k in range(u.shape[-1]))
    return np.maximum(count(x, y), count(y, x))


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of bits of counted_bounds() as texts of fewer slots have them: slots with those half the slots away, their times added."""
    while bits.shape[1] > width:
        a, b = np.split(bits.reshape(len(bits), PLANES, -1), 2, axis=2)
        planes = []
        for p in range(PLANES):
            both = a[:, p] | b[:, p]
            for q in range(p):
                both = both | a[:, q] & b[:, p - 1 - q]
            planes.append(both)
        bits = np.concatenate(planes, axis=1)
    return bits


class _Bounds:
    """The values of bound() or counted_bounds() of some rows: n, the texts' words, and their bits, of one width or several."""

    def __init__(self, column: pa.Array):
        self.flat, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.r_[0, np.cumsum(size)][:-1]
        self.n, self.width = self.flat[self.at], size - 1

    def bits(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Those rows' bits, folded to that width."""
        out = np.empty((len(rows), width), np.uint64)
        own = self.width[rows]
        for w in np.unique(own).tolist():
            at = np.flatnonzero(own == w)
            out[at] = _folded(self.flat[self.at[rows[at], None] + 1 + np.arange(w)].view(np.uint64), width)
        return out


def _room(bounds: _Bounds, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows i and j of the bounds leave room for the similarity, pair by pair: each word of one text that the other lacks
    costs an edit. Never false for a pair that aligns."""
    n, m, width = bounds.n[i], bounds.n[j], np.minimum(bounds.width[i], bounds.width[j])
    band = ((1 - similarity) * np.maximum(n, m) + 1e-9).astype(np.int64)
    out = np.abs(n - m) <= band
    open_width = np.where(out, width, 0)
    for w in np.unique(width[out]).tolist():
        at = np.flatnonzero(open_width == w)
        out[at] = _lacking(bounds.bits(i[at], w), bounds.bits(j[at], w)) <= band[at]
    return out


def _room_within(bounds: _Bounds, start: int, size: int, similarity: float) -> np.ndarray:
    """_room() of all pairs i < j of one bucket, as a matrix; lengths too far apart are not compared."""
    out = np.zeros((size, size), bool)
    order = np.argsort(bounds.n[start : start + size], kind="stable")
    s, width = bounds.n[start + order], bounds.width[start + order]
    i = 0
    while i < size:
        end = i + int(np.searchsorted(width[i : i + 128], width[i], "right"))  # longer texts are of no less width
        to = np.searchsorted(s, s[end - 1] / similarity + 1, "right")
        band = ((1 - similarity) * np.maximum(s[i:end, None], s[None, i:to]) + 1e-9).astype(np.int64)
        bits = bounds.bits(start + order[i:to], int(width[i]))
        ok = (np.abs(s[i:end, None] - s[None, i:to]) <= band) & (_lacking(bits[: end - i, None], bits[None]) <= band)
        out[np.ix_(order[i:end], order[i:to])] = ok
        i = end
    return np.triu(out | out.T, 1)


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A tree of each component of a bucket's possible pairs (upper triangle), from its least member on."""
    both, left = near | near.T, near.any(0) | near.any(1)
    tree = [np.empty((0, 2), np.int64)]
    while left.any():
        queue = [int(left.argmax())]
        left[queue[0]] = False
        for u in queue:
            found = np.flatnonzero(both[u] & left)
            left[found] = False
            tree.append(np.stack([np.minimum(u, found), np.maximum(u, found)], 1))
            queue += found.tolist()
    return tuple(np.concatenate(tree).T)


#: What a row of met() says: PAIR: the only possible pair of its texts; TREE: one of a tree that spans three possible texts or more;
#: STAR: a possible pair with the least id of a bucket beyond BUCKET; BEYOND: an impossible one, or a bucket of too many pairs.
PAIR, TREE, STAR, BEYOND = 0, 1, 2, 3


def _met(similarity: float, of: pa.DataType, labelled: bool):
    """From rows (id, key, bound[, c]) by key and id: a tree of the possible pairs of each bucket, or, labelled, all possible
    pairs of different c. Of buckets beyond BUCKET the pairs with the least id, which takes no memory."""
    schema = pa.schema([("key", pa.int64()), *[(c, of) for c in ("a", "b", "of_a", "of_b")], ("kind", pa.int32())])

    def made(rows: pa.Table, i: np.ndarray, j: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        ids, i, j = rows["id"].combine_chunks(), pa.array(i, pa.int64()), pa.array(j, pa.int64())
        c = rows["c"].combine_chunks() if labelled else pa.nulls(len(rows), of)
        return pa.RecordBatch.from_arrays([rows["key"].combine_chunks().take(i), ids.take(i), ids.take(j), c.take(i), c.take(j), pa.array(kind, pa.int32())], schema=schema)

    def star(rows: pa.Table) -> pa.RecordBatch:
        """The first row with all others."""
        j = np.arange(1, len(rows))
        first = np.zeros(len(j), np.int64)
        return made(rows, first, j, np.where(_room(_Bounds(rows["bound"].combine_chunks()), first, j, similarity), STAR, BEYOND))

    def buckets(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.filter(pa.array(~_again(rows)))
        key, bounds = rows["key"].to_numpy(), _Bounds(rows["bound"].combine_chunks())
        c = np.unique(rows["c"].to_numpy(), return_inverse=True)[1] if labelled else np.arange(len(key))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.repeat(sizes <= FEW_MEMBERS, sizes)
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for d in range(1, min(FEW_MEMBERS, len(key))):
            i = np.flatnonzero((key[d:] == key[:-d]) & small[d:] & (c[d:] != c[:-d]))
            if not len(i):
                break
            i = i[_room(bounds, i, i + d, similarity)]
            left.append(i)
            right.append(i + d)
        i, j = np.concatenate(left), np.concatenate(right)
        if labelled:
            yield made(rows, i, j, np.full(len(i), PAIR))
        else:
            bucket = np.searchsorted(starts, i, "right") - 1
            alone = np.bincount(bucket, minlength=len(starts))[bucket] == 1
            tree = _forest(i[~alone], j[~alone])
            yield made(rows, np.r_[i[alone], tree[0]], np.r_[j[alone], tree[1]], np.repeat([PAIR, TREE], [alone.sum(), len(tree[0])]))
        for at in np.flatnonzero(sizes > FEW_MEMBERS).tolist():
            own = slice(starts[at], starts[at] + sizes[at])
            near = _room_within(bounds, int(starts[at]), int(sizes[at]), similarity)
            if labelled:
                near &= c[own][:, None] != c[own][None, :]
                i, j = np.nonzero(near)
                if len(i) > MANY_PAIRS * sizes[at]:
                    yield made(rows, starts[[at]], starts[[at]], np.array([BEYOND]))
                else:
                    yield made(rows, i + starts[at], j + starts[at], np.full(len(i), PAIR))
            else:
                i, j = _spanning(near)
                yield made(rows, i + starts[at], j + starts[at], np.full(len(i), TREE))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, centre = None, None  # rows of buckets that may go on; the first row of a bucket beyond BUCKET
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if centre is not None:
                size = int(np.searchsorted(batch.column("key").to_numpy(), centre["key"][0].as_py(), "right"))
                if size:
                    yield star(pa.concat_tables([centre, rows.slice(0, size)]).combine_chunks())
                if size == len(rows):
                    continue
                rows, centre = rows.slice(size), None
            rows = rows if held is None else pa.concat_tables([held, rows])
            key = rows["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1], "left"))
            if last:
                yield from buckets(rows.slice(0, last).combine_chunks())
            held = rows.slice(last).combine_chunks()
            if len(held) > BUCKET:
                yield star(held)
                held, centre = None, held.slice(0, 1)
        if held is not None and len(held):
            yield from buckets(held)

    return met, schema


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of these edges a spanning tree of each component, those of the least left ends first."""
    root: dict[int, int] = {}

    def of(i: int) -> int:
        while i in root:
            i = root[i]
        return i

    kept = []
    for at in np.lexsort((right, left)).tolist():
        u, v = of(int(left[at])), of(int(right[at]))
        if u != v:
            root[max(u, v)] = min(u, v)
            kept.append(at)
    return left[kept], right[kept]


def linked(
    keys: DataFrame, bounds: DataFrame, codes: DataFrame, similarity: float, kind: str = "<u4"
) -> tuple[DataFrame, DataFrame]:
    """(verified links (a, b) that join what all pairs with a common key would join; (id, component) of the ids that have one).

    keys: distinct rows (id, key) of the keys that are not alone, as of shared_keys(); bounds: (id, bound), the same bound if an
    id comes again; codes: (id, rank, codes), words of this kind; if an id comes again, its least rank counts.

    The members of a bucket meet within a task by their bounds, so that only pairs that these leave room for become rows. Of each
    bucket first a tree of such pairs is aligned. Buckets where all of the tree align are done; in the others all possible pairs
    of ids that are not joined by then are aligned. Beyond BUCKET members all are aligned with the least id instead. The members
    of such buckets that are not one component by then, and of those with more than MANY_PAIRS possible pairs a member, meet anew,
    which loses no pair of the similarity: up to FEW_TEXTS of them each with each (in_blocks()), more by their rare_runs(), which are
    buckets like others: all possible pairs of ids that are not joined by then, or the pairs with the least id beyond BUCKET; those
    whose pairs are too many, or not all of them, and whose texts are not one component by then leave their texts to in_blocks().
    Ids that are joined already make no pair again.
    """
    spark, of_id = keys.sparkSession, keys.schema["id"].dataType

    def codes_by(ids: DataFrame, few: bool) -> DataFrame:
        """One row of codes for each of these ids. few: whether they are at most 2 * FEW_PAIRS."""
        return codes.join(F.broadcast(ids) if few else ids.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min_by("codes", "rank").alias("codes"))

    def aligned(pairs: DataFrame) -> DataFrame:
        """The pairs that align. A pair carries a text of any length through a shuffle, so no more than FEW_PAIRS go at once."""
        n = pairs.count()
        if not n:
            return pairs
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        if n <= FEW_PAIRS:
            return written(verified(pairs, codes_by(ids, True), similarity, kind, True))
        asked, parts, out = written(codes_by(ids, False)), -(-n // FEW_PAIRS), None
        for k in range(parts):
            part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == k)
            found = written(verified(part, asked, similarity, kind, True))
            out = found if out is None else out.union(found)
        unlink(asked)
        return out

    def met(rows: DataFrame, labelled: bool = False) -> DataFrame:
        made, schema = _met(similarity, to_arrow_type(of_id), labelled)
        ddl = ", ".join(f"{f.name} {of_id.simpleString() if f.name in ('a', 'b', 'of_a', 'of_b') else 'bigint' if f.name == 'key' else 'int'}" for f in schema)
        dealt = rows.join(bounds, "id").repartition(tasks_for(rows.count(), MET_ROWS, spark), "key").sortWithinPartitions("key", "id")
        return written(dealt.mapInArrow(made, ddl))

    tree = met(keys.select("id", "key"))
    tried = written(tree.where(F.col("kind") < BEYOND).select("a", "b").distinct())
    links = aligned(tried)
    joined = written(components(links))
    lost = written(tree.where(F.col("kind") != PAIR).join(links, ["a", "b"], "left_anti").select("key", "a", "b", "kind"))
    apart = lost.where(F.col("kind") != TREE).select("key", "a", "b")
    if not apart.isEmpty():
        of = lambda i, c: joined.select(F.col("id").alias(i), F.col("component").alias(c))
        apart = apart.join(of("a", "c"), "a", "left").join(of("b", "c2"), "b", "left").where(F.coalesce("c", "a") != F.coalesce("c2", "b"))
    apart = apart.select("key")
    broken = lost.where(F.col("kind") == TREE).select("key").distinct()
    if not broken.isEmpty():
        rows = written(keys.join(broken, "key", "left_semi").join(joined, "id", "left").select("id", "key", F.coalesce("component", "id").alias("c")))
        more = met(rows, True)
        pairs = written(more.where(F.col("kind") == PAIR).select("a", "b", "of_a", "of_b").distinct())
        found = aligned(pairs)
        links, joined, tried = links.union(found.select("a", "b")), _joined_on(joined, found), tried.union(pairs.select("a", "b"))
        apart = apart.union(more.where(F.col("kind") == BEYOND).select("key"))
    apart = written(apart.distinct())
    if apart.isEmpty():
        return links, joined
    ids = written(keys.join(apart, "key", "left_semi").select("id").distinct())
    texts = ids.count()
    hot = written(codes_by(ids, texts <= 2 * FEW_PAIRS))
    if texts > FEW_TEXTS:
        weight = np.zeros(SLOTS, np.int64)
        for r in hot.select(F.explode(slots_by(kind)("codes")).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).toLocalIterator():  # SLOTS rows at most
            weight[r["slot"]] = r["n"]
        parts = written(hot.select("id", F.explode(rare_runs_of(weight, similarity, kind)("codes")).alias("key")))
        rows = parts.join(joined, "id", "left").select("id", "key", F.coalesce("component", "id").alias("c"))
        sized = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
        rows = written(rows.join(sized, "key", "left_semi"))
        unlink(parts)
        more = met(rows, True)
        pairs = written(more.where((F.col("kind") < BEYOND) & (F.col("of_a") != F.col("of_b"))).select("a", "b", "of_a", "of_b").distinct().join(tried, ["a", "b"], "left_anti"))
        found = aligned(pairs)
        links, joined = links.union(found.select("a", "b")), _joined_on(joined, found)
        wide = more.where(F.col("kind") != PAIR).select("key").distinct()
        left = rows.join(wide, "key", "left_semi").select("id", "key").join(joined, "id", "left").select("id", "key", F.coalesce("component", "id").alias("c"))
        still = left.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
        rest = left.join(still, "key", "left_semi").select("id").distinct()
        pool = hot.join(rest.hint("merge"), "id", "left_semi")
    else:
        pool = hot
    found = in_blocks(pool.join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("c"), "codes"), similarity, kind)
    return links.union(found.select("a", "b")), _joined_on(joined, found)


def in_blocks(texts: DataFrame, similarity: float, kind: str = "<u4") -> DataFrame:
    """Verified links (a, b, of_a, of_b) that join what all links between texts (id, c, codes) of different c would join, of_ the
    c of that end. Texts lie in blocks by length; blocks meet if their lengths leave room for the similarity, each two once, and
    their pairs are compared within the task. No pair is left out: time grows with the square of the texts of like lengths,
    memory with a block."""
    width = np.dtype(kind).itemsize
    # a text has a partner in its own class of length and in the next ones only
    classed = texts.withColumn("k", F.floor(F.log(F.greatest(F.length("codes") / width, F.lit(1.0))) / F.lit(math.log(1.01 / similarity))).cast("int"))
    many = classed.groupBy("k").agg(F.ceil(F.greatest(F.sum(F.length("codes")) / BLOCK_BYTES, F.count("*") / BLOCK_TEXTS)).alias("many"))
    dealt = classed.join(F.broadcast(many), "k").select("k", F.pmod(F.xxhash64("id"), F.greatest("many", F.lit(1))).cast("int").alias("i"), F.struct("id", "c", "codes").alias("member"))
    blocks = written(dealt.groupBy("k", "i").agg(F.collect_list("member").alias("x")))
    second = blocks.select(F.col("k").alias("k2"), F.col("i").alias("j"), F.col("x").alias("y"))
    own = blocks.select("k", "i").withColumn("k2", F.explode(F.array("k", F.col("k") + 1)))
    both = own.join(second.select("k2", "j"), "k2").where((F.col("k2") > F.col("k")) | (F.col("j") >= F.col("i")))
    both = written(both.select("k", "i", "k2", "j"))
    # two blocks that meet carry a block through a shuffle, so no more of them go at once than there are blocks, twice
    parts, out = -(-both.count() // max(LEAST_MEETINGS, 2 * blocks.count())), None
    for r in range(max(1, parts)):
        part = both.where(F.pmod(F.xxhash64("k", "i", "k2", "j"), F.lit(max(1, parts))) == r)
        part = part.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "i", "k2", "j")  # few bytes, much work
        met = part.join(blocks, ["k", "i"]).join(second, ["k2", "j"])
        same = (F.col("k") == F.col("k2")) & (F.col("i") == F.col("j"))
        found = written(met.select(F.inline(_links_between(similarity, kind, texts.schema["id"].dataType)("x", "y", same))).distinct())
        out = found if out is None else out.union(found)
    unlink(blocks)
    return out


def _links_between(similarity: float, kind: str, of: DataType):
    names = ("a", "b", "of_a", "of_b")
    ends = StructType([StructField(c, of) for c in names])

    def texts(members: pa.Array) -> tuple[list, list, list[np.ndarray]]:
        each = sorted(zip(members.field("id").to_pylist(), members.field("c").to_pylist(), range(len(members))))
        codes = members.field("codes")
        return [e[0] for e in each], [e[1] for e in each], [np.frombuffer(codes[e[2]].as_buffer(), kind) for e in each]

    @arrow_udf(ArrayType(ends))
    def links(xs: pa.Array, ys: pa.Array, same: pa.Array) -> pa.Array:
        out = []
        for x, y, own in zip(xs, ys, same.to_pylist()):
            left = texts(x.values)
            right = left if own else texts(y.values)
            out.append([dict(zip(names, (p[0], q[0], p[1], q[1]))) for p, q in _joining(left, right, own, similarity)])
        return pa.array(out, pa.list_(pa.struct([(c, xs.type.value_type.field("id").type) for c in names])))

    return links


def _joining(left: tuple, right: tuple, own: bool, similarity: float) -> list[tuple[tuple, tuple]]:
    """((id, c), (id, c)) of pairs of both blocks that align and are not joined by those before."""
    (ids, cs, xs), (ids2, cs2, ys) = left, right
    n, m = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    most = np.maximum(n[:, None], m[None, :])
    band = ((1 - similarity) * most + 1e-9).astype(np.int64)
    number = np.unique(np.array([*cs, *cs2]), return_inverse=True)[1]
    open_pairs = (np.abs(n[:, None] - m[None, :]) <= band) & (number[: len(cs), None] != number[None, len(cs) :])
    if own:
        open_pairs &= np.triu(np.ones_like(open_pairs), 1)
    for q in (1, 2, 3):
        rows, columns = np.flatnonzero(open_pairs.any(1)), np.flatnonzero(open_pairs.any(0))
        if not len(rows):
            return []
        # an edit breaks q runs of q words at most
        least = (most - q + 1 - q * band)[np.ix_(rows, columns)]
        open_pairs[np.ix_(rows, columns)] &= _common_runs([xs[i] for i in rows.tolist()], [ys[j] for j in columns.tolist()], q) >= least
    root: dict = {}

    def of(c):
        while c in root:
            c = root[c]
        return c

    found = []
    for i, j in np.argwhere(open_pairs).tolist():
        u, v = of(cs[i]), of(cs2[j])
        if u != v and within(xs[i], ys[j], int(band[i, j])):
            root[max(u, v)] = min(u, v)
            found.append(tuple(sorted(((ids[i], cs[i]), (ids2[j], cs2[j])))))
    return found


def _common_runs(xs: list[np.ndarray], ys: list[np.ndarray], q: int) -> np.ndarray:
    """How many runs of q words each x (row) and each y (column) share, each as often as both have it."""
    labels, places = [], []
    for texts in (xs, ys):
        each = []
        for t in texts:
            h = np.zeros(max(0, len(t) - q + 1), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(q):
                    h = _mix(h * _MULT + t[j : j + len(h)].astype(np.uint64) + np.uint64(1))
                each.append(_occurrence_labelled(h) if len(h) else h)
        labels.append(np.concatenate([np.empty(0, np.uint64), *each]))
        places.append(np.repeat(np.arange(len(texts)), [len(h) for h in each]))
    common = np.intersect1d(labels[0], labels[1])
    sides = []
    for texts, label, place in zip((xs, ys), labels, places):
        at = np.searchsorted(common, label)
        held = at < len(common)
        held[held] = common[at[held]] == label[held]
        side = np.zeros((len(texts), len(common)), np.float32)
        side[place[held], at[held]] = 1
        sides.append(side)
    return sides[0] @ sides[1].T


def _joined_on(joined: DataFrame, found: DataFrame) -> DataFrame:
    """joined (id, component) after more links (a, b, of_a, of_b), of_ the component of that end or, where it has none, its id:
    only the components that the links touch are put together."""
    if found.isEmpty():
        return joined
    moved = components(found.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("now"))
    moved = written(moved)
    every = joined.union(moved.select(F.col("component").alias("id"), "component").join(joined.select("id"), "id", "left_anti"))
    return written(every.join(moved, "component", "left").select("id", F.coalesce("now", "component").alias("component")))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, rep_id (least doc_id of the documents with the same words), class_id (least doc_id of
    its group of near-duplicates), n_words, n_links (verified links of its representative).

    A link joins documents whose word sequences (lower-cased runs of letters and digits) have an edit similarity,
    1 - distance / longer length, of at least `similarity`; classes are the connected components. Documents without
    words, null texts among them, form one class of copies. Rows with the same id count as one (its first text by hash).
    Only doc_id and text are read, so other columns can have any name. Rows with a null id come back as their own class (null).
    An empty table gives an empty result.

    A link is found if some sketch agrees. At similarity 0.8 with spread edits a three-word k-mer survives with 0.8^3, two texts
    share a third of theirs, a sketch agrees in one case of nine and one of 40 in 99 of 100; chains within a group raise that.
    The texts are read once: sketches and word hashes for the alignment are written down. Copies are folded first, so groups
    of copies of any size are one representative. Candidates share a sketch; linked() says how large buckets are split. A
    group that aligns with its least id makes one pair a member, and a passage that many documents share ends in small buckets.
    n_links counts the links that were verified; pairs that others had joined before are not aligned.
    """
    with steps_freed() as kept:
        words = docs.select(F.col(id_col).alias("id"), hashes_of(words_of(text_of(text_col))).alias("w"))
        every = written(words.select("id", F.size("w").alias("n"), F.xxhash64("w").alias("d1"), F.xxhash64(F.lit(7), F.col("w")).alias("d2"), sketches_of("w").alias("keys"), codes_of("w").alias("codes"), bounds_of("w").alias("bound")))
        named = every.where("id is not null")
        first = named.groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("d")).select("id", "d.d1", "d.d2")
        least = first.groupBy("d1", "d2").agg(F.min("id").alias("id"))
        keyed = named.select("id", "d1", "d2", "n", "keys", "bound").join(least, ["id", "d1", "d2"], "left_semi").groupBy("id", "d1", "d2").agg(*[F.first(c).alias(c) for c in ("n", "keys", "bound")])
        reps = written(keyed)
        keys = written(shared_keys(reps.select("id", F.explode("keys").alias("key")), reps.count() * SKETCHES))
        links, joined = linked(keys, reps.select("id", "bound"), named.select("id", F.struct("d1", "d2").alias("rank"), "codes"), similarity)
        unlink(keys)
        degree = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
        classes = (
            reps.select("d1", "d2", F.col("id").alias("rep_id"), "n")
            .join(joined.select(F.col("id").alias("rep_id"), "component"), "rep_id", "left")
            .join(degree.select(F.col("id").alias("rep_id"), "n_links"), "rep_id", "left")
            .select("d1", "d2", "rep_id", F.coalesce("component", "rep_id").alias("class_id"), "n", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        )
        out = first.join(classes, ["d1", "d2"]).select(F.col("id").alias("doc_id"), "rep_id", "class_id", F.col("n").alias("n_words"), "n_links")
        lost = every.where("id is null").select(F.col("id").alias("doc_id"), F.col("id").alias("rep_id"), F.col("id").alias("class_id"), F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_links"))
        return kept(written(out.union(lost)))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class: the one whose id names the class. Rows with a null id stay."""
    classes = near_duplicates(docs, similarity, id_col, text_col).where("doc_id <> class_id").select(F.col("doc_id").alias(id_col))
    return docs.join(classes, id_col, "left_anti")
