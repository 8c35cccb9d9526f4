"""Byte-level BPE by monoid tree reduction (operator 2)."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: Characters of a leaf, and of a boundary window to begin with.
LEAF, WINDOW = 8192, 32


@cache
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _cut(text: str, a: int, b: int) -> int | None:
    """The first place in (a, b) between a character that isn't white space and a plain space or newline, or None.

    No alternative of the pattern matches other characters and then white space, so every encoding of a text that holds
    both has a token boundary there, whatever lies around: tokens on either side are final.
    """
    at = [p for p in (text.find(" ", a + 1, b), text.find("\n", a + 1, b)) if p > 0]
    while at:
        p = min(at)
        if not text[p - 1].isspace() and text[p - 1] not in "\x1c\x1d\x1e\x1f":
            return p
        at = [q for q in (text.find(" ", p + 1, b), text.find("\n", p + 1, b)) if q > 0]
    return None


def _tail(enc, ids: np.ndarray, n_bytes: int) -> int:
    """How many of the last ids make up the last n_bytes bytes."""
    k = 0
    while n_bytes > 0:
        k += 1
        n_bytes -= len(enc.decode_single_token_bytes(int(ids[-k])))
    assert n_bytes == 0
    return k


def _head(enc, ids: np.ndarray, n_bytes: int) -> int:
    k = 0
    while n_bytes > 0:
        n_bytes -= len(enc.decode_single_token_bytes(int(ids[k])))
        k += 1
    assert n_bytes == 0
    return k


def _ids(enc, text: str) -> np.ndarray:
    return np.array(enc.encode_ordinary(text), np.int32)


def join(enc, text: str, a: int, m: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids of text[a:b] from those of text[a:m] and text[m:b].

    The window around m doubles on each side until it begins and ends at a place that _cut() proves final, or at an end
    of its half; the window is encoded anew and what is outside stays.
    """
    w = WINDOW
    while True:
        lo = max(a, m - w)
        cut = _cut(text, lo, m)
        if cut is not None or lo == a:
            lo = a if cut is None else cut
            break
        w *= 2
    w = WINDOW
    while True:
        hi = min(b, m + w)
        cut = _cut(text, m, hi)
        if cut is not None or hi == b:
            hi = b if cut is None else cut
            break
        w *= 2
    keep_l = len(left) - _tail(enc, left, len(text[lo:m].encode())) if lo > a else 0
    skip_r = _head(enc, right, len(text[m:hi].encode())) if hi < b else len(right)
    return np.concatenate([left[:keep_l], _ids(enc, text[lo:hi]), right[skip_r:]])


def encode_tree(enc, text: str, leaf: int = LEAF) -> np.ndarray:
    """The ids that the tiktoken library gives for the whole text, by halves."""

    def node(a: int, b: int) -> np.ndarray:
        if b - a <= leaf:
            return _ids(enc, text[a:b])
        m = (a + b) // 2
        return join(enc, text, a, m, b, node(a, m), node(m, b))

    return node(0, len(text))


def decode_tree(enc, ids: np.ndarray, leaf: int = LEAF) -> bytes:
    """The bytes of the ids: halves are decoded and put together."""
    if len(ids) <= leaf:
        return enc.decode_bytes(ids.tolist())
    m = len(ids) // 2
    return decode_tree(enc, ids[:m], leaf) + decode_tree(enc, ids[m:], leaf)


def encode(text: Column, ranks_path: str, pattern: str) -> Column:
    """ids (array<int>) of each whole text by the rank file, without special tokens; null and empty texts get no ids."""

    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        enc = encoding(ranks_path, pattern)
        parts = [encode_tree(enc, t or "") for t in texts.to_pylist()]
        ends = np.r_[0, np.cumsum([len(p) for p in parts])]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *parts])))

    return ids(text)


def decode(ids: Column, ranks_path: str, pattern: str) -> Column:
    """The bytes (binary) that the ids stand for; null ids give no bytes. Ids outside the vocabulary fail with KeyError."""

    @arrow_udf("binary")
    def content(lists: pa.Array) -> pa.Array:
        enc = encoding(ranks_path, pattern)
        flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        return pa.array([decode_tree(enc, flat[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())

    return content(ids)
