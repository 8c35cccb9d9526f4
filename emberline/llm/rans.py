"""Token-ID output by static range asymmetric numeral systems (operator 5)."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from emberline.llm.common import scratch, text_of, unlink

#: Frequencies sum to 2^SCALE; states lie in [LOW, 2^63); 32 bits move at a time.
SCALE, LOW = 20, 1 << 31
#: Symbols coded side by side, steps between two checkpoints, and ids after which a block ends (with a document).
LANES, CHECK_STEPS, BLOCK_IDS = 1024, 256, 1 << 20
#: Words whose ids are kept at hand in a worker.
CACHED_WORDS = 1_600_000
#: Marks that may follow a word's letters: neither letters, digits nor white space, and no apostrophe.
MARKS = '.,!?;:%$&*#"()-'
#: Bytes of text whose words are made distinct together.
_CHUNK = 16 << 20
MAGIC = b"RNS1"
BLOCKS = "part int, block int, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"

_U = np.uint64
_LONGS = pa.list_(pa.int64())
_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", _LONGS), ("lengths", _LONGS), ("payload", pa.binary())])


class Table:
    """Frequencies of ids, from their counts: each id seen has one at least."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.size = int(ids.max()) + 1 if len(ids) else 1
        self.freq = np.zeros(self.size, _U)
        self.freq[ids] = freq
        self.start = np.r_[0, np.cumsum(self.freq)[:-1]].astype(_U)
        self.symbol = np.repeat(np.arange(self.size, dtype=np.uint32), self.freq.astype(np.int64))

    @staticmethod
    def frequencies(counts: np.ndarray) -> np.ndarray:
        if len(counts) == 0:
            return counts
        spare = (1 << SCALE) - len(counts)
        assert spare >= 0, "more distinct ids than the scale holds"
        freq = 1 + np.floor(counts / counts.sum() * spare).astype(np.int64)
        freq[np.argmax(counts)] += (1 << SCALE) - freq.sum()
        return freq


def pack(ids: np.ndarray, table: Table, lanes: int = LANES, check_steps: int = CHECK_STEPS) -> bytes:
    """One block: id i belongs to lane i mod lanes; with a checkpoint every `check_steps` steps (all lanes' states and the
    place in the stream), a checksum of the ids between two checkpoints, and one of the stream."""
    n = len(ids)
    k = max(1, min(lanes, n // 64))
    steps = -(-n // k)
    x = np.full(k, LOW, _U)
    f, c = table.freq[ids], table.start[ids]
    out: list[np.ndarray] = []
    emitted, checks = 0, []
    for t in range(steps - 1, -1, -1):
        a, b = t * k, min(n, t * k + k)
        y, g = x[: b - a], f[a:b]
        over = y >= g << _U(43)
        if over.any():
            out.append((y[over] & _U(0xFFFFFFFF)).astype("<u4"))
            emitted += len(out[-1])
            y[over] >>= _U(32)
        q = y // g
        y[:] = (q << _U(SCALE)) + (y - q * g) + c[a:b]
        if t % check_steps == 0:
            checks.append((t, emitted, x.copy()))
    stream = np.concatenate([np.empty(0, "<u4"), *out[::-1]]).tobytes()
    parts = [MAGIC, struct.pack("<QIIQI", n, k, len(checks), emitted, zlib.crc32(stream))]
    little = ids.astype("<u4")
    for t, e, state in checks[::-1]:
        crc = zlib.crc32(little[t * k : (t + check_steps) * k].tobytes())
        parts.append(struct.pack("<QQI", t, emitted - e, crc) + state.astype("<u8").tobytes())
    return b"".join([*parts, stream])


def unpack(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block, or of its checkpoints first..last (each can be decoded alone); checks the checksums."""
    n, k, n_checks, words, crc = struct.unpack_from("<QIIQI", block, 4)
    assert block[:4] == MAGIC, "not a block"
    at, checks = 4 + struct.calcsize("<QIIQI"), []
    for _ in range(n_checks):
        checks.append((*struct.unpack_from("<QQI", block, at), np.frombuffer(block, "<u8", k, at + 20)))
        at += 20 + 8 * k
    stream = np.frombuffer(block, "<u4", words, at)
    if zlib.crc32(stream.tobytes()) != crc:
        raise ValueError("the stream's checksum differs")
    last = n_checks if last is None else last
    out = []
    mask = _U((1 << SCALE) - 1)
    for i in range(first, last):
        t0, place, crc, state = checks[i]
        t1 = checks[i + 1][0] if i + 1 < n_checks else -(-n // k)
        x = state.astype(_U)
        part = np.empty(min(n, t1 * k) - t0 * k, np.uint32)
        for t in range(t0, t1):
            a, b = (t - t0) * k, min(len(part), (t - t0) * k + k)
            y = x[: b - a]
            slot = y & mask
            s = table.symbol[slot.astype(np.int64)]
            part[a:b] = s
            y[:] = table.freq[s] * (y >> _U(SCALE)) + slot - table.start[s]
            low = y < _U(LOW)
            m = int(low.sum())
            if m:
                y[low] = (y[low] << _U(32)) | stream[place : place + m].astype(_U)
                place += m
        if zlib.crc32(part.astype("<u4").tobytes()) != crc:
            raise ValueError(f"the checksum of part {i} differs")
        out.append(part)
    return np.concatenate([np.empty(0, np.uint32), *out])


class Words:
    """Packed ids of texts, by a tokenizer that lower-cases and drops white space, so that words encode each by itself.

    Most words are letters, in some case, and then perhaps marks. Letters followed by marks always part there, and the
    letters' ids don't depend on case, so each lower-cased run of letters is encoded once and kept; other words are
    encoded as they stand, many together.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.kind = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def packed(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, one after another, each with end_id behind; how many each text has).

        The words of many texts are made distinct first, so that each is looked up once and its ids are laid out by number.
        """
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        distinct, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        ids = [*map(self.known.get, distinct)]
        if None in ids:
            self.learn({w for w, x in zip(distinct, ids) if x is None})
            ids = [*map(self.known.__getitem__, distinct)]
        flat = np.frombuffer(b"".join(ids), self.kind)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize
        first, n = (np.cumsum(size) - size)[index], size[index]
        upto = np.r_[0, np.cumsum(n)]
        plain = flat[np.repeat(first - upto[:-1], n) + np.arange(upto[-1])]
        ends = upto[np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))]
        return np.insert(plain, ends, np.array(end_id, self.kind)), np.diff(np.r_[0, ends]) + 1

    def learn(self, words: set[str]) -> None:
        parts, odd, bases = {}, set(), set()
        for w in words:
            core = w.rstrip(MARKS)
            base = core.lower()
            if base.isalpha() and "\u03a3" not in core and is_normalized("NFC", base):
                parts[w] = base, w[len(core) :]
                bases.add(base)
                if len(core) < len(w):
                    odd.add(w[len(core) :])
            else:
                odd.add(w)
        self.encode([*bases.difference(self.known)], self.letters)
        self.encode([*odd.difference(self.known)], self.whole)
        self.known.update((w, self.known[base] + self.known[tail] if tail else self.known[base]) for w, (base, tail) in parts.items())

    def encode(self, words: list[str], tokenizer: Tokenizer) -> None:
        for a in range(0, len(words), 2000):
            part = words[a : a + 2000]
            e = tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, self.kind)
            if tokenizer is self.letters:
                cuts = np.r_[0, np.flatnonzero(self.ends[ids]) + 1]
            else:
                cuts = np.searchsorted([o for o, _ in e.offsets], np.cumsum([0, *(len(w) + 1 for w in part)]))
            assert len(cuts) == len(part) + 1
            self.known.update((w, ids[i:j].tobytes()) for w, i, j in zip(part, cuts[:-1].tolist(), cuts[1:].tolist()))


@cache
def words(path: str) -> Words:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(path)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (doc_id, text) with some _CHUNK bytes of text each, one row at least."""
    done = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + _CHUNK)))
        yield batch.slice(a, b - a)
        a = b


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, ids) per document, ids packed; and after each part of the input a row without ids, with the part's counts
    of ids (seen, n)."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = words(tokenizer_path), np.zeros(end_id + 1, np.int64)
        for batch in batches:
            for piece in _pieces(batch):
                ids, lengths = encode.packed(piece.column(1), end_id)
                got = np.bincount(ids, minlength=len(total))
                total = got + np.r_[total, np.zeros(len(got) - len(total), np.int64)]
                ends = np.r_[0, np.cumsum(lengths)] * ids.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                none = pa.nulls(piece.num_rows, _LONGS)
                yield pa.RecordBatch.from_arrays([piece.column(0), packed, none, none], ["doc_id", "ids", "seen", "n"])
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen], _LONGS), pa.array([total[seen]], _LONGS)], ["doc_id", "ids", "seen", "n"])

    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise ValueError("documents are written in the order of integer ids: doc_id has to be of an integer type")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(tokenize, "doc_id bigint, ids binary, seen array<bigint>, n array<bigint>")


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Write the ids of docs (doc_id, text), each document's followed by end_id, in ascending doc_id order, under `path`.

    path/table holds the shared frequencies (id, freq), counted over all documents; path/blocks the blocks: part and block
    in order, doc_ids and lengths of the documents in it, and the payload of pack(). The texts are tokenized once, where they
    lie: packed ids are written down, and they, not the texts, are dealt out by ranges of doc_id (nulls first), so parts
    follow each other in order; a block ends at a document's end. The table has a row for each id of the vocabulary at most,
    and goes to the tasks. Null and empty texts have the end id alone. Rows with equal or null doc_id are documents of their
    own, in the order of a hash of their ids, by which they are dealt out too, so that no id fills a task. Ids have to be of
    an integer type, else ValueError. Other columns aren't read. An empty table writes no blocks.
    """
    spark = docs.sparkSession
    plain = f"{path}/plain"
    tokenized(docs, tokenizer_path, end_id).write.option("compression", "zstd").parquet(plain)
    rows = spark.read.schema("doc_id bigint, ids binary, seen array<bigint>, n array<bigint>").parquet(plain)
    counts = rows.where("ids is null").select(F.explode(F.arrays_zip("seen", "n")).alias("x")).groupBy("x.seen").agg(F.sum("x.n").alias("n")).orderBy("seen").toPandas()
    ids, freq = counts["seen"].to_numpy(np.int64), Table.frequencies(counts["n"].to_numpy(np.int64))
    spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, freq)], "id bigint, freq bigint").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((ids, freq))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kind, part, block = Table(*shared.value), words(tokenizer_path).kind, TaskContext.get().partitionId(), 0
        width = np.dtype(kind).itemsize
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        n = 0

        def row() -> pa.RecordBatch:
            got = np.frombuffer(b"".join(held), kind).astype(np.uint32)
            columns = ([part], [block], [len(got)], [doc_ids], [[len(h) // width for h in held]], [pack(got, table)])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCKS)], schema=_BLOCKS)

        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(i)
                held.append(packed)
                n += len(packed) // width
                if n >= BLOCK_IDS:
                    yield row()
                    held, doc_ids, n, block = [], [], 0, block + 1
        if held:
            yield row()

    by = ["doc_id", "h"]
    dealt = rows.where("ids is not null").select("doc_id", "ids", F.xxhash64("ids").alias("h")).repartitionByRange(*by).sortWithinPartitions(*by, "ids")
    dealt.select("doc_id", "ids").mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    rows.written_path = plain
    unlink(rows)


def read_back(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, all ids checked against the blocks' checksums."""
    freq = spark.read.parquet(f"{path}/table").orderBy("id").toPandas()
    shared = spark.sparkContext.broadcast((freq["id"].to_numpy(np.int64), freq["freq"].to_numpy(np.int64)))
    files = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            for r in range(batch.num_rows):
                part, block, _, doc_ids, lengths, payload = (batch.column(j)[r].as_py() for j in range(6))
                little = unpack(payload, table).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - np.array(lengths)
                crc = [zlib.crc32(little[4 * a : 4 * b]) for a, b in zip(starts, ends)]
                m = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array([block] * m, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = files.mapInArrow(documents, "part int, block int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = files.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a file: few
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = sizes.select("part", "block", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")).alias("inner"))
    places = inner.join(before, "part").select("part", "block", (F.col("before") + F.col("inner")).alias("base"))
    return docs.join(places, ["part", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """write() into the shared folder, then read_back()."""
    path = f"{scratch(docs.sparkSession)}/{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path, end_id)
    return read_back(docs.sparkSession, path)
