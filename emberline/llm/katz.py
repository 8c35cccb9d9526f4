"""Katz backoff language model: Good-Turing discounted n-gram counts, exactly normalised, and texts scored by it (operator 13).

Texts are cut into chunks of some million tokens, written once as numbers of the chunk's own words. An order is then one round
of two shuffles. Each chunk asks for its distinct n-grams, with how often it has them in training texts, at the part of the
order's table that their context is dealt to; the part adds the counts of all chunks up, stores its table, and answers each
chunk with the counts, and for n-grams never seen with what the weight of their context is made of. With the order's counts of
counts, a few numbers on the driver, a chunk has the probabilities of all its n-grams, which the next order's weights sum up.

P(w | h) is d(c) c(hw) / c(h) where c(hw) > 0, and weight(h) P(w | h without its first word) elsewhere; weight(h) is what the
discounts leave of h over what the lower order gives to words not seen after h, so that all words, the end and one unknown
word sum to one. A context all of whose followers are too frequent to be discounted counts as if seen once more. Contexts
never seen have weight one. Two empty words precede a text, as often as the order asks.

A context of many tokens is dealt to several parts by word, and its sums over parts are joined back; chunks and parts have a
bounded size, so that memory is.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from emberline.llm.common import scratch, text_of, unlink, written

#: Tokens of a chunk (and the rest of its last text), tokens a part of a table, tokens of a context that several parts share.
CHUNK, PART, SPLIT = 1 << 21, 1_500_000, 1_000_000
#: Counts up to this are discounted.
K = 5

_ROUND = "chunk bigint, level int, part int, k1 binary, k2 binary, cnt binary, lc binary, lcc binary, ctx bigint, n array<bigint>, low double"
_BIN, _LONG = pa.binary(), pa.int64()
_ARROW = pa.schema([("chunk", _LONG), ("level", pa.int32()), ("part", pa.int32()), *[(c, _BIN) for c in ("k1", "k2", "cnt", "lc", "lcc")], ("ctx", _LONG), ("n", pa.list_(_LONG)), ("low", pa.float64())])
#: Values of `part` of rows that answer no request: counts of counts, sums of a shared context, who needs them, the table.
COUNTS, SUMS, NEEDS, TABLE = -1, -2, -3, -4


class Model(NamedTuple):
    """scores: a row a document; tables: the stored parts of each order (packed); levels: discounts and sizes of each order."""

    scores: DataFrame
    tables: list[DataFrame]
    levels: list[dict]


def pack(a: np.ndarray, delta: bool = False) -> bytes:
    """Integers as compressed planes of bytes; `delta` for those that mostly rise."""
    a = np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64)
    if delta:
        a = np.diff(a, prepend=0)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(b: bytes, delta: bool = False) -> np.ndarray:
    a = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return np.cumsum(a) if delta else a


def discounts(n: list[int]) -> np.ndarray:
    """d(r) for r = 0..K+1, from the counts of counts n_1..n_(K+1): Katz's form of Good-Turing, or where the counts of counts
    are too uneven for it (an empty or rising one), the absolute discount n_1 / (n_1 + 2 n_2), within 0.1 and 0.9. Counts
    beyond K aren't discounted; all up to K are."""
    d = np.ones(K + 2)
    a = (K + 1) * n[K] / n[0] if n[0] else 1.0
    if a < 1 and all(n[: K + 1]):
        d[1 : K + 1] = [((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a) for r in range(1, K + 1)]
    if not (all(0 < x < 1 for x in d[1 : K + 1])):
        off = min(0.9, max(0.1, n[0] / (n[0] + 2 * n[1]))) if n[0] else 0.5
        d[1 : K + 1] = [(r - off) / r for r in range(1, K + 1)]
    return d


def seen_probability(count: np.ndarray, total: np.ndarray | float, d: np.ndarray) -> np.ndarray:
    """Of n-grams of a positive count; negative counts mark contexts without a discounted follower, which have one more token."""
    c = np.abs(count)
    return np.where(count > 0, d[np.minimum(c, K + 1)] * c / np.maximum(total, 1), c / (total + 1.0))


def _mixed(a: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _chunks(id_type: pa.DataType):
    schema = pa.schema([("chunk", _LONG), ("ids", pa.list_(id_type)), ("train", pa.list_(pa.bool_())), ("lens", pa.list_(_LONG)), ("toks", _BIN), ("by_hash", _BIN), ("hashes", _BIN), ("cnt", _BIN), ("n_tokens", _LONG), ("n_train", _LONG)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, train, lens, toks, held = [], [], [], [], 0
        own: defaultdict = defaultdict()
        own.default_factory = own.__len__

        def rows() -> pa.RecordBatch:
            """The chunk, and its words by hash with their counts in training texts."""
            words, every = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)), np.concatenate(toks)
            often = np.argsort(-np.bincount(every), kind="stable")  # frequent words get small numbers, which pack well
            rank = np.empty(len(own), np.int64)
            rank[often] = np.arange(len(own))
            words, toks_now = words[often], rank[every]
            by_hash = np.argsort(words)
            count = np.bincount(toks_now[np.repeat(train, lens)], minlength=len(own))
            one = [(part << 32) + made, ids, train, lens, pack(toks_now), pack(by_hash), None, None, held, sum(train)]
            two = [(part << 32) + made, None, None, None, None, None, pack(words[by_hash], True), pack(count[by_hash]), None, None]
            return pa.RecordBatch.from_arrays([pa.array([v, w], f.type) for v, w, f in zip(one, two, schema)], schema=schema)

        for b in batches:
            for key, text, t in zip(*b.columns):
                w = text.as_py().encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone parts
                w.append(b"")  # the end
                toks.append(np.fromiter(map(own.__getitem__, w), np.int32, len(w)))
                ids.append(key.as_py())
                train.append(t.as_py())
                lens.append(len(w))
                held += len(w)
                if held >= CHUNK:
                    yield rows()
                    made += 1
                    ids, train, lens, toks, held = [], [], [], [], 0
                    own = defaultdict()
                    own.default_factory = own.__len__
        if ids:
            yield rows()

    return cut


class _Chunk:
    """A chunk and, order by order, the probabilities of its n-grams."""

    def __init__(self, head: dict, answers: pa.Table | None, parts: int, levels: list[dict], n_docs: int):
        self.chunk, self.parts, self.levels, self.n_docs = head["chunk"], parts, levels, n_docs
        self.ids, self.doc_train, self.lens = head["ids"], np.array(head["train"], bool), np.array(head["lens"])
        self.toks, self.by_hash = unpack(head["toks"]), unpack(head["by_hash"])
        self.train = np.repeat(self.doc_train, self.lens)
        self.first = np.r_[0, np.cumsum(self.lens)[:-1]]
        self.answers = defaultdict(dict)
        self.shared = defaultdict(dict)
        for r in answers.to_pylist() if answers else ():
            if r["part"] >= 0:
                self.answers[r["level"]][r["part"]] = r | {"size": r["n"][0] if r["level"] == 1 else None}
            else:
                self.shared[r["level"]][r["ctx"]] = (np.array(r["n"]), r["low"])
        self.loc, self.count = self.toks, self.by_hash
        for k, level in enumerate(levels):
            if k:
                self.ask(k + 1)
            self.take(k + 1, level)

    def ask(self, n: int) -> None:
        """Requests of order n: distinct (context, word), the context a number of the order below, 0 before a text's start."""
        size, words = len(self.gid), len(self.by_hash)
        ctx = np.r_[size, self.loc[:-1]]
        ctx[self.first] = size
        every = ctx * words + self.toks
        order = np.argsort(every)
        every = every[order]
        new = np.r_[True, every[1:] != every[:-1]]
        keys, lower, loc = every[new], self.loc[order[new]], np.empty(len(order), np.int64)
        loc[order] = np.cumsum(new) - 1
        self.low, self.lc = self.p[lower], self.c[lower]
        self.lcc = self.total[lower] if n > 2 else None
        above, word = keys // words, keys % words
        self.total = np.r_[np.abs(self.c), self.n_docs][above]
        self.k1, self.k2 = np.r_[self.gid, 0][above], self.word_gid[word]
        self.loc, self.count = loc, np.bincount(loc[self.train], minlength=len(keys))
        salts = 1 + self.total // SPLIT
        self.split = salts > 1
        self.part = (_mixed(self.k1 * 31 + self.k2 % salts) % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((self.k2, self.k1, self.part))
        self.wanted = order[self.total[order] > 0]

    def slices(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """The parts that order n was asked of, and which n-grams of each, in the order of the request."""
        if n == 1:  # ranges of hashes
            at = 0
            for p in sorted(self.answers[1]):
                size = self.answers[1][p]["size"]
                yield p, self.by_hash[at : at + size]
                at += size
            return
        part = self.part[self.wanted]
        for p, at in zip(*np.unique(part, return_index=True)):
            yield int(p), self.wanted[at : np.searchsorted(part, p, "right")]

    def requests(self, n: int) -> pa.Table:
        out = []
        for p, i in self.slices(n):
            count, k1 = self.count[i], self.k1[i]
            row = {"chunk": self.chunk, "level": n, "part": p, "k1": pack(k1, True), "k2": pack(self.k2[i]), "cnt": pack(count), "n": np.unique(k1[self.split[i]]).tolist()}
            row |= {"lc": pack(self.lc[i] * (count > 0))}
            if n > 2:
                row |= {"lcc": pack(self.lcc[i] * (count > 0))}
            out.append(row)
        return pa.Table.from_pylist(out, _ARROW)

    def take(self, n: int, level: dict) -> None:
        """Counts and probabilities of order n, from the answers."""
        size, d = len(self.count), level["d"]
        gid, c = np.zeros(size, np.int64), np.zeros(size, np.int64)
        lost, low_sum = np.zeros(size), np.zeros(size)
        for p, i in self.slices(n):
            a = self.answers[n][p]
            c[i] = unpack(a["cnt"])
            if a["k1"]:
                gid[i] = 1 + p + self.parts * unpack(a["k1"], n > 1)
            if n > 1:
                unseen = i[c[i] == 0]
                stats = unpack(a["k2"]).reshape(K + 1, -1)
                lost[unseen] = _left(stats, d)
                low_sum[unseen] = unpack(a["lc"]).view(np.float64)
        if n == 1:
            left = _left(np.array([*level["n"][:K], level["tokens"]]).reshape(-1, 1), d)[0]
            plain = not any(level["n"][:K])
            c = -c if plain else c
            self.p = np.where(c != 0, seen_probability(c, level["tokens"], d), left)
            self.word_gid, self.known = gid, c != 0
            self.word_count = np.abs(c)
        else:
            for g, (stats, low) in self.shared[n].items():
                own = self.split & (self.k1 == g)
                c[own] = np.abs(c[own]) * (1 if stats[:K].any() else -1)
                lost[own], low_sum[own] = _left(stats.reshape(-1, 1), d)[0], low
            weight = np.where(self.total > 0, lost / np.maximum(1 - low_sum, 1e-300), 1.0)
            self.p = np.where(c != 0, seen_probability(c, self.total, d), weight * self.low)
        self.gid, self.c = gid, c

    def scores(self, levels: list[dict]) -> pa.Table:
        one = levels[0]
        known = self.known[self.toks]
        base = np.log10((self.word_count[self.toks] + 0.5) / (one["tokens"] + 0.5 * (one["words"] + 1)))
        total = lambda x: np.add.reduceat(x, self.first)
        return pa.table({"id": self.ids, "train": self.doc_train, "n_tokens": self.lens, "n_known": total(known.astype(np.int64)), "base_score": total(base), "score": total(np.log10(self.p[self.loc]))})


def _left(stats: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What discounts leave of contexts, by their followers' counts n_1..n_K and all their tokens (rows of stats)."""
    total = stats[K]
    free = ((1 - d[1 : K + 1]) * np.arange(1, K + 1)) @ stats[:K]
    return np.where(free > 0, free / np.maximum(total, 1), 1 / (total + 1.0))


def _merge(parts: int, n: int, below: dict | None, top: bool):
    """One part of order n's table: the counts of all chunks added up, and an answer to each; of the top order no numbers, since
    no order asks by them."""

    def merge(table: pa.Table) -> pa.Table:
        rows = table.select(["chunk", "part", "k1", "k2", "cnt", "lc", "lcc", "n"]).to_pylist()
        p = rows[0]["part"]
        k1 = [unpack(r["k1"], True) for r in rows]
        ends = np.cumsum([len(x) for x in k1])
        k1, cnt = np.concatenate(k1), np.concatenate([unpack(r["cnt"]) for r in rows])
        k2 = np.concatenate([unpack(r["k2"]) for r in rows]) if n > 1 else np.zeros(len(k1), np.int64)
        order = np.lexsort((k2, k1)) if n > 1 else np.argsort(k1.view(np.uint64), kind="stable")
        s1, s2 = k1[order], k2[order]
        new = np.r_[True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])]
        starts, place = np.flatnonzero(new), np.empty(len(k1), np.int64)
        place[order] = np.cumsum(new) - 1
        counts = np.add.reduceat(cnt[order], starts)
        u1, u2, seen = s1[starts], s2[starts], counts > 0
        made = [{"level": n, "part": COUNTS, "n": [*[int((counts == r).sum()) for r in range(1, K + 2)], int(counts.sum()), int(seen.sum())]}]
        if n == 1:  # numbers by falling count, so that frequent words have small ones
            rank = np.empty(len(counts), np.int64)
            rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
            made.append({"level": n, "part": TABLE, "ctx": p, "k1": pack(u1[seen], True), "k2": pack(1 + p + parts * rank[seen]), "cnt": pack(counts[seen])})
            for r, a, b in zip(rows, np.r_[0, ends[:-1]], ends):
                made.append({"chunk": r["chunk"], "level": n, "part": p, "k1": pack(rank[place[a:b]]), "cnt": pack(counts[place[a:b]]), "n": [int(b - a)]})
            return pa.Table.from_pylist(made, _ARROW)
        made.append({"level": n, "part": TABLE, "ctx": p, "k1": pack(u1[seen], True), "k2": pack(u2[seen]), "cnt": pack(counts[seen])})
        # the lower order's probability of what was seen, of any chunk that has it
        of_any = lambda c: _either(np.concatenate([unpack(r[c]) for r in rows])[order], starts)
        lc, lcc = of_any("lc"), of_any("lcc") if n > 2 else float(below["tokens"])
        low = np.where(seen, seen_probability(lc, lcc, below["d"]), 0.0)
        first = np.flatnonzero(np.r_[True, u1[1:] != u1[:-1]])
        of = np.cumsum(np.r_[True, u1[1:] != u1[:-1]]) - 1
        stats = np.stack([*[np.add.reduceat((counts == r).astype(np.int64), first) for r in range(1, K + 1)], np.add.reduceat(counts, first)])
        low_sum = np.add.reduceat(low, first)
        signed = np.where(stats[:K].any(axis=0)[of], counts, -counts)
        shared = np.unique(np.concatenate([np.array(r["n"] or [], np.int64) for r in rows]))
        for g in shared:
            at = np.searchsorted(u1[first], g)
            made.append({"level": n, "part": SUMS, "ctx": int(g), "n": stats[:, at].tolist(), "low": float(low_sum[at])})
        for r, a, b in zip(rows, np.r_[0, ends[:-1]], ends):
            at = place[a:b]
            unseen = of[at[~seen[at]]]
            made.append({"chunk": r["chunk"], "level": n, "part": p, "k1": None if top else pack(at, True), "cnt": pack(signed[at]), "k2": pack(stats[:, unseen].ravel()), "lc": pack(low_sum[unseen].view(np.int64))})
            made += [{"chunk": r["chunk"], "level": n, "part": NEEDS, "ctx": g} for g in r["n"] or []]
        return pa.Table.from_pylist(made, _ARROW)

    return merge


def _either(a: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The value other than 0 of each run, which is the same wherever it is given."""
    most = np.maximum.reduceat(a, starts)
    return np.where(most > 0, most, np.minimum.reduceat(a, starts))


def _asked(n: int, parts: int, known: list[dict], n_docs: int):
    """A chunk's requests of order n: its words by ranges of their hashes, then from its answers of the orders below."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, hashes, cnt in zip(*[c.to_pylist() for c in b.columns]):
                hashes, cnt = unpack(hashes, True), unpack(cnt)
                part = (hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                for p, at in zip(*np.unique(part, return_index=True)):
                    end = np.searchsorted(part, p, "right")
                    yield pa.RecordBatch.from_pylist([{"chunk": chunk, "level": 1, "part": int(p), "k1": pack(hashes[at:end], True), "cnt": pack(cnt[at:end])}], _ARROW)

    def asked(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chunk(chunk.to_pylist()[0], answers, parts, known, n_docs)
        c.ask(n)
        return c.requests(n)

    return first if n == 1 else asked


def _bucketed(chunks: DataFrame) -> DataFrame:
    """Chunks written in buckets by their number, so that only answers are shuffled to them, not their tokens with each order.
    The table's name is given up at once; its files are read by their plan."""
    spark, name = chunks.sparkSession, f"chunks_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks.write.option("path", f"{scratch(spark)}/{name}").option("compression", "none").bucketBy(n, "chunk").saveAsTable(name)
    out = spark.table(name)
    out.schema
    spark.sql(f"drop table {name}")
    return out


def fit_score(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train") -> Model:
    """A model of the given order learnt from the documents whose `train` holds, and the scores of all documents.

    Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, and an end after each text. scores: (<id>, train, n_tokens,
    n_known, train_tokens, base_score, score), a row a document; repeated rows and ids give a row each, null texts are empty
    (an end alone), a null `train` is false, other columns aren't looked at, and an empty table has no scores. base_score is
    that of single tokens with half a count added, score the model's log10 probability. Words and n-grams are told apart by
    64-bit hashes of words. To score other documents by what some have, pass both, with train false for the others."""
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    ddl = id_type.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.coalesce(F.col(train_col).cast("boolean"), F.lit(False)).alias("train"))
    cut = written(rows.mapInArrow(_chunks(to_arrow_type(id_type)), f"chunk bigint, ids array<{ddl}>, train array<boolean>, lens array<bigint>, toks binary, by_hash binary, hashes binary, cnt binary, n_tokens bigint, n_train bigint"))
    size = cut.agg(F.sum("n_tokens"), F.sum("n_train")).first()
    parts, n_docs = 1 + (size[0] or 0) // PART, size[1] or 0
    heads = _bucketed(cut.where("ids is not null").select("chunk", "ids", "train", "lens", "toks", "by_hash"))
    answers, tables, levels = None, [], []
    for n in range(1, order + 1):
        asked = _asked(n, parts, list(levels), n_docs)
        requests = cut.where("hashes is not null").select("chunk", "hashes", "cnt").mapInArrow(asked, _ROUND) if n == 1 else heads.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(asked, _ROUND)
        met = written(requests.groupBy("part").applyInArrow(_merge(parts, n, levels[-1] if levels else None, n == order), _ROUND))
        if n == 1:
            unlink(cut)
        sums = met.where(F.col("part") == COUNTS).select([F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(K + 3)]).first()
        levels.append({"n": [int(x) for x in sums[: K + 1]], "tokens": int(sums[K + 1]), "words": int(sums[K + 2]), "d": discounts([int(x) for x in sums[: K + 1]])})
        answer = met.where(F.col("part") >= 0)
        if n > 1:
            added = met.where(F.col("part") == SUMS).groupBy("ctx").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(K + 1)]).alias("n"), F.sum("low").alias("low"))
            needed = met.where(F.col("part") == NEEDS).select("chunk", "level", "part", "ctx").distinct().join(added, "ctx")
            answer = answer.unionByName(needed, allowMissingColumns=True)
        answer = answer.select("chunk", "level", "part", "k1", "k2", "cnt", "lc", "ctx", "n", "low")
        answers = answer if answers is None else answers.union(answer)
        tables.append(met.where(F.col("part") == TABLE).select(F.col("ctx").cast("int").alias("part"), "k1", "k2", "cnt"))

    def scored(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        return _Chunk(chunk.to_pylist()[0], answers, parts, levels, n_docs).scores(levels)

    found = heads.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, f"id {ddl}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    scores = found.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(levels[0]["tokens"]).cast("bigint").alias("train_tokens"), "base_score", "score")
    return Model(scores, tables, levels)


def grams(table: DataFrame) -> DataFrame:
    """(context, word, n) of a stored table of order 2 or more, as numbers of the orders below; (hash, word, n) of order 1."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k1, k2, cnt in zip(*[c.to_pylist() for c in b.columns]):
                yield pa.RecordBatch.from_pydict({"context": unpack(k1, True), "word": unpack(k2), "n": unpack(cnt)})

    return table.select("k1", "k2", "cnt").mapInArrow(rows, "context bigint, word bigint, n bigint")
