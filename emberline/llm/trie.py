"""Conversation prefix trie: what training on shared prefixes once would save, by time-forward processing (operator 11).

A node is a distinct sequence of a conversation's first turns. Its identity is the exclusive or of two 64-bit hashes of each
(place, role, text), so that prefixes are running aggregates over turns dealt out by ranges, and no conversation has to be in
one task. Totals of subtrees go from the deepest level up: nodes are sorted externally by reverse level order, and each sends
its totals to its parent through a priority queue that spills to disk. Nodes that few conversations reach are grouped into
shards by the highest such node above them; what the shards' roots add up to then goes, summed by parent, into one pass over
the nodes above. With a limit of sqrt(turns) conversations a shard, both passes see at most about sqrt(turns) nodes a level.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from emberline.llm.common import text_of, written
from emberline.operators.ranking import numbered_each

#: Messages that a queue holds before it writes a sorted run; conversation ids whose decimal numbers one row may hold.
HELD, BLOCK = 200_000, 4096
#: Conversations that a shard may hold at least.
LEAST_SHARD = 1024
_KEY = ["depth", "a", "b"]


class SpillingQueue:
    """A priority queue of tuples: a heap, and sorted runs in temporary files once it holds more than `held`."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs = held, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            f = tempfile.TemporaryFile()
            for x in sorted(self.heap):
                pickle.dump(x, f)
            f.seek(0)
            self.heap = []
            self._next(f)

    def _next(self, f) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(f), id(f), f))
        except EOFError:
            f.close()

    def first(self) -> tuple | None:
        return min((q[0] for q in (self.heap, [r[0] for r in self.runs[:1]]) if q), default=None)

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, _, f = heapq.heappop(self.runs)
            self._next(f)
            return item
        return heapq.heappop(self.heap)


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, role, text) of turns (conv_id, turn, role, text): turns numbered from 1 in each conversation by turn,
    null first, then role and text; null roles and texts are empty, rows without conv_id drop out."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", text_of("role").alias("role"), text_of().alias("text"))
    return numbered_each(rows, "conv_id", F.col("turn").asc_nulls_first(), "role", "text", name="depth").select("conv_id", "depth", "role", "text")


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, words): each turn's prefix and the one before it, as running aggregates over ranges of
    (conv_id, depth) that start from the sums of the ranges before."""
    one = turns.select("conv_id", "depth", *[F.xxhash64(F.lit(k), "depth", "role", "text").alias(h) for k, h in ((1, "x"), (2, "y"))], F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).cast("bigint").alias("words"))
    dealt = written(one.repartitionByRange("conv_id", "depth").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("sx"), F.bit_xor("y").alias("sy"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    start = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("sx", "sy")])
    own = W.partitionBy("conv_id", "part").orderBy("depth")
    run = dealt.join(start, ["conv_id", "part"]).select("conv_id", "depth", "words", "x", "y", *[F.col(s).bitwiseXOR(F.bit_xor(c).over(own)).alias(h) for s, c, h in (("sx", "x", "a"), ("sy", "y", "b"))])
    return run.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "words")


_TOTALS = "depth int, a bigint, b bigint, n_children bigint, n_leaves bigint, saved bigint"


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of nodes (depth, a, b, pa, pb, saved, children, leaves, below) in reverse level order; children, leaves and below
    are what came from subtrees elsewhere. A message is (level order of the parent, children, leaves, saved)."""
    queue = SpillingQueue()
    for batch in batches:
        out = []
        for depth, a, b, pa_, pb_, saved, children, leaves, below in zip(*[c.to_pylist() for c in batch.columns]):
            here, total = (-depth, a, b), saved + below
            while (m := queue.first()) is not None and m[0] <= here:
                if m[0] == here:  # else its parent is in no node of this task: the root of a shard
                    children, leaves, total = children + m[1], leaves + m[2], total + m[3]
                queue.pop()
            leaves = leaves if children else 1
            out.append((depth, a, b, children, leaves, total))
            if depth:
                queue.push(((1 - depth, pa_, pb_), 1, leaves, total))
        yield pa.RecordBatch.from_pylist([dict(zip(("depth", "a", "b", "n_children", "n_leaves", "saved"), r)) for r in out], pa.schema([("depth", pa.int32()), *[(n, pa.int64()) for n in ("a", "b", "n_children", "n_leaves", "saved")]]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node (depth, a, b), of its blocks of ids in order, comma-joined."""
    node, digest = None, None
    for batch in batches:
        out = []
        for depth, a, b, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if (depth, a, b) == node:
                digest.update(b"," + ids.encode())
                continue
            if node:
                out.append((*node, digest.hexdigest()))
            node, digest = (depth, a, b), hashlib.sha256(ids.encode())
        yield _digest_rows(out)
    yield _digest_rows([(*node, digest.hexdigest())] if node else [])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("depth", "a", "b", "ends_sha256"), r)) for r in rows], pa.schema([("depth", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())]))


def prefix_trie(turns: DataFrame, conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node): a row a node of the
    trie of turns (conv_id, depth, role, text), numbered from 1 as ordered() does.

    conversations (conv_id) names all members, those without turns too; ids are whole numbers, null ones drop out and repeated
    ones count once. conv_id is a node's smallest member and parent_conv_id its parent's; n_convs its members; saved_tokens sums
    (members - 1) * words of the last turn over the subtree, and ends_sha256 digests the members that end there. The root, at
    depth 0, is always there unless there is no conversation. `limit`: conversations a shard, sqrt(turns) if not given. Other
    columns aren't looked at. Two different prefixes share a node by chance only, at 128 bits."""
    members = written(conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct())
    rows = written(_prefixes(turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("depth").cast("int").alias("depth"), "role", "text")))
    zero = F.lit(0).cast("bigint")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(F.lit(0).alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"), "conv_id", "n_convs", zero.alias("words"))
    grown = rows.groupBy(*_KEY).agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    nodes = written(root.unionByName(grown))
    limit = limit or max(LEAST_SHARD, math.isqrt(rows.count()))

    # a conversation's shard is its highest node with at most `limit` members; above it are nodes of more
    upper = (F.col("n_convs") > limit) | (F.col("depth") == 0)
    cut = rows.join(nodes.where(upper).select(*_KEY), _KEY, "left_semi").groupBy("conv_id").agg((F.max("depth") + 1).alias("cut"))
    tops = rows.join(cut, "conv_id", "left").where(F.col("depth") == F.coalesce("cut", F.lit(1))).select("conv_id", "depth", F.col("a").alias("sa"), F.col("b").alias("sb"))
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    order = [F.desc("depth"), "a", "b"]
    low = nodes.where(~upper).join(tops.select("conv_id", "sa", "sb"), "conv_id").select(*_KEY, "pa", "pb", saved, zero.alias("children"), zero.alias("leaves"), zero.alias("below"), "sa", "sb")
    low = low.repartition("sa", "sb").sortWithinPartitions(*order).drop("sa", "sb")
    low = written(low.mapInArrow(_forward, _TOTALS))

    # what the shards' roots add up to, by parent
    shard_roots = tops.select(*["depth", F.col("sa").alias("a"), F.col("sb").alias("b")]).distinct()
    sent = low.join(shard_roots, _KEY, "left_semi").join(nodes.select(*_KEY, "pa", "pb"), _KEY)
    sent = sent.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("below"))
    high = nodes.where(upper).select(*_KEY, "pa", "pb", saved).join(sent, _KEY, "left").select(*_KEY, "pa", "pb", "saved", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("children", "leaves", "below")])
    high = high.coalesce(1).sortWithinPartitions(*order).mapInArrow(_forward, _TOTALS)

    last = members.join(rows.groupBy("conv_id").agg(F.max("depth").alias("depth")), "conv_id", "left")
    ends = last.where("depth is null").select(F.lit(0).alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id").union(rows.join(last.where("depth is not null"), ["conv_id", "depth"]).select(*_KEY, "conv_id"))
    block = F.floor(F.col("conv_id") / F.lit(BLOCK)).alias("block")
    blocks = ends.groupBy(*_KEY, block).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ended = blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "block").drop("block").mapInArrow(_digests, "depth int, a bigint, b bigint, ends_sha256 string")

    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(low.union(high), _KEY).join(ended, _KEY, "left").join(parent, ["depth", "pa", "pb"], "left")
    return full.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), F.concat(F.lpad(F.hex("a"), 16, "0"), F.lpad(F.hex("b"), 16, "0")).alias("node"))
