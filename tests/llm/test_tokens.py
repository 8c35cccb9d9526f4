import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from helpers import ODD_DOCS, ODD_SCHEMA, sha
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberline.llm import bpe, queries, rans

PIECES = [" ", "  ", "\n", "\t", "a", "bc", "'re", "'", "é", "é", "12", "!!", "　", "\x1c", "\x85", "日本", "🙂", "Σ", "can't ", " \n", "x" * 70, "\r", "İ", "<|endoftext|>", "́", "​", "가", "Å", ".", "-", "\x00"]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_tree_encoding_equals_the_library():
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in texts(800):
        for leaf in (1, 7, 33):
            ids = bpe.encode_tree(enc, t, leaf)
            assert ids.tolist() == enc.encode_ordinary(t)
            assert bpe.decode_tree(enc, ids, 3) == t.encode()


def test_long_runs_without_boundaries():
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in ("x" * 9000, " " * 5000 + "y", "日本" * 3000, "1" * 7000, "ab\n" * 4000):
        assert bpe.encode_tree(enc, t, 500).tolist() == enc.encode_ordinary(t)


def test_bpe_query(spark, sf):
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_byte_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(docs[r.doc_id]))


def test_bpe_odd_rows(spark):
    d = spark.createDataFrame(ODD_DOCS, ODD_SCHEMA).withColumn("ids", bpe.encode(F.col("text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    rows = d.withColumn("back", bpe.decode(F.col("ids"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).collect()
    assert len(rows) == len(ODD_DOCS) and all(bytes(r.back) == (r.text or "").encode() for r in rows)
    assert d.where("false").count() == 0


def test_words_equal_the_library():
    path = P.path("word_bpe_49k.json")
    whole, words = Tokenizer.from_file(path), rans.words(path)
    for t in texts(1500, 2):
        assert np.frombuffer(words.packed([t], 2)[0], words.kind)[:-1].tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000])
def test_blocks(n):
    r = np.random.default_rng(n)
    ids = (r.zipf(1.3, n) % 900).astype(np.uint32)
    seen, counts = np.unique(np.r_[ids, 7], return_counts=True)
    table = rans.Table(seen, rans.Table.frequencies(counts))
    for lanes, steps in ((1, 16), (8, 16), (1024, 256)):
        b = rans.pack(ids, table, lanes, steps)
        assert (rans.unpack(b, table) == ids).all()
    b = rans.pack(ids, table, 8, 16)
    if n == 5000:
        assert (rans.unpack(b, table, 2, 4) == ids[2 * 128 : 4 * 128]).all()  # from a checkpoint alone
        broken = bytearray(b)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            rans.unpack(bytes(broken), table)


def test_rans_query(spark, sf):
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got, start = {r.doc_id: r for r in queries.op5_rans_tokens(spark, sf).collect()}, 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*whole.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        g = got.pop(r.doc_id)
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_rans_odd_rows(spark):
    d = spark.createDataFrame(ODD_DOCS, ODD_SCHEMA)
    rows = rans.round_trip(d, P.path("word_bpe_49k.json")).collect()
    assert len(rows) == len(ODD_DOCS) and sum(r.n_tokens == 1 for r in rows) == 2
    assert rans.round_trip(d.where("false"), P.path("word_bpe_49k.json")).count() == 0
