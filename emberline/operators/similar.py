"""All pairs of like vectors: an exact cosine join by blocks whose distances to pivots leave room for a pair.

On the unit sphere angles keep the triangle inequality, so two vectors within an angle t of one another have angles to any
pivot that differ by t at most. Vectors are dealt out to cells by their nearest pivot, large cells to several blocks by a
hash, and a block meets another only if the ranges of their angles to every pivot come within t. Within a pair of blocks all
cosines are one matrix product. Clustered vectors thus meet few blocks; vectors spread evenly in many dimensions meet all of
them, as no exact bound parts those.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.sources.stores import checkpointed

#: Rows of a block that are multiplied at once: bounds the product's memory.
_ROWS = 256
#: Products this close to a half of the last place kept are added up again, place by place: a matrix product adds in another order.
_TIE = 1e-10


def vector_classes(rows: DataFrame, key: str, vector: str, group: str | None = None) -> DataFrame:
    """(group, rep, members, vector): equal vectors of a group folded to the least key. Null and zero vectors have no direction
    and drop out; vectors of one group have to be of one length."""
    grp = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    longs = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.where(F.col(vector).isNotNull() & (longs > 0)).groupBy(grp.alias("grp"), F.col(vector).cast("array<double>").alias("vector")).agg(F.min(key).alias("rep"), F.count("*").alias("members"))


def vectors_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = pc.list_flatten(column)
    flat = flat.to_numpy() if isinstance(flat, pa.ChunkedArray) else flat.to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    v = vectors_of(column)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def products(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, product) in bounded parts: the pairs whose product, rounded to 4 places with halves away from zero,
    is at least `least`. What is next to a half is added from the first place to the last, as a plain loop does."""
    tie = _TIE * 1e4 * max(1.0, *(float(np.linalg.norm(v, axis=1).max(initial=0)) for v in (x, y))) ** 2
    for at in range(0, len(x), _ROWS):
        product = x[at : at + _ROWS] @ y.T
        i, j = np.nonzero(product >= least - 5e-5 - tie)
        score, i = product[i, j], i + at
        places = np.abs(score) * 1e4
        close = np.flatnonzero(np.abs(places - np.floor(places) - 0.5) < tie)
        for part in np.array_split(close, len(close) // 65536 + 1):
            score[part] = np.cumsum(x[i[part]] * y[j[part]], axis=1)[:, -1] if len(part) else 0
        places = np.abs(score) * 1e4
        whole = np.floor(places)
        score = np.copysign(whole + (places - whole >= 0.5), score) / 1e4
        kept = score >= least
        yield i[kept], j[kept], score[kept]


def block_pairs(classes: DataFrame, least: float, pivots: int = 32, block: int = 8192, lengths: bool = False) -> tuple[DataFrame, DataFrame]:
    """(placed, pairs): classes with their block (cell, sub), and the blocks that may hold pairs of a cosine of `least`; with
    `lengths`, of a product of `least`, by the longest vectors of both."""
    chosen = classes.select("vector", F.xxhash64("rep", "grp").alias("h"), "rep", "grp").orderBy("h", "rep", "grp").limit(pivots).collect()  # at most `pivots` rows
    centre = np.array([r["vector"] for r in chosen], np.float64)
    centre = centre / np.linalg.norm(centre, axis=1, keepdims=True) if len(chosen) else centre.reshape(0, 0)
    low = least - 1e-4
    angle = F.lit(math.acos(max(-1.0, min(1.0, low))))
    if lengths:
        angle = F.when(F.col("long1") * F.col("long2") * (1 + 1e-9) < low, -1.0).otherwise(F.acos(F.least(F.lit(1.0), low / (F.col("long1") * F.col("long2"))))) if low > 0 else F.lit(math.pi)

    def place(batches):
        for b in batches:
            vectors = vectors_of(b.column(b.schema.get_field_index("vector")))
            long = np.linalg.norm(vectors, axis=1)
            theta = np.arccos(np.clip(vectors / long[:, None] @ centre.T, -1, 1)) if len(long) else np.empty((0, 0))
            extra = [pa.array(theta.argmin(1) if len(theta) else [], pa.int32()), pa.array(list(theta), pa.list_(pa.float64())), pa.array(long)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "cell", "theta", "long"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    cells = classes.mapInArrow(place, f"{ddl}, cell int, theta array<double>, long double")
    sizes = cells.groupBy("grp", "cell").agg(F.ceil(F.count("*") / block).alias("subs"))
    placed = checkpointed(cells.join(sizes, ["grp", "cell"]).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs"))).drop("subs"))
    k = range(len(chosen))
    box = [F.array(*[f(F.col("theta")[i]) for i in k]).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))] if chosen else [F.array().cast("array<double>").alias(n) for n in ("lo", "hi")]
    box.append(F.max("long").alias("long"))
    near = lambda a, b: F.forall(F.zip_with(F.zip_with(f"lo{a}", f"hi{b}", lambda x, y: x - y), F.zip_with(f"lo{b}", f"hi{a}", lambda x, y: x - y), lambda x, y: F.greatest(x, y)), lambda gap: gap <= angle)
    named = lambda df, s, *cols: df.select("grp", *[F.col(c).alias(f"{c}{s}") for c in cols])
    cell = placed.groupBy("grp", "cell").agg(*box)
    met = named(cell, 1, "cell", "lo", "hi", "long").join(named(cell, 2, "cell", "lo", "hi", "long"), "grp").where("cell1 <= cell2").where(near(1, 2)).select("grp", "cell1", "cell2")
    blocks = placed.groupBy("grp", "cell", "sub").agg(*box)
    both = met.join(named(blocks, 1, "cell", "sub", "lo", "hi", "long"), ["grp", "cell1"]).join(named(blocks, 2, "cell", "sub", "lo", "hi", "long"), ["grp", "cell2"])
    return placed, both.where("cell1 < cell2 or sub1 <= sub2").where(near(1, 2)).select("grp", "cell1", "sub1", "cell2", "sub2")


def cosine_pairs(rows: DataFrame, key: str, vector: str, least: float, group: str | None = None, pivots: int = 32, block: int = 8192, as_unit: bool = False) -> DataFrame:
    """(grp, a, b, cosine), a < b: all pairs of different vectors of a group with a cosine (to 4 places) of at least `least`.

    as_unit: vectors count as of unit length as they stand, so that the cosine is their product, to the last bit; `least` has to be
    positive then. Equal vectors are one class, named by its least key, as vector_classes() gives them; so a group of copies makes
    no pairs among itself. No row is sampled or capped: only the pivots are a bounded choice, and they change no result."""
    if as_unit and least <= 0:
        raise ValueError("products of at least 0 or less hold for vectors of no length")
    classes = checkpointed(vector_classes(rows, key, vector, group).select("grp", "rep", "vector"))
    placed, pairs = block_pairs(classes, least, pivots, block, as_unit)
    pairs = checkpointed(pairs)
    sent = lambda s: placed.withColumnsRenamed({"cell": f"cell{s}", "sub": f"sub{s}"}).join(pairs, ["grp", f"cell{s}", f"sub{s}"]).select("grp", "cell1", "sub1", "cell2", "sub2", F.lit(s).alias("side"), "rep", "vector")
    own = (F.col("cell1") == F.col("cell2")) & (F.col("sub1") == F.col("sub2"))
    every = sent(1).union(sent(2).where(~own))
    kind = placed.schema["rep"].dataType.simpleString()
    vectors = vectors_of if as_unit else _units

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        one, two = (table.filter(pc.equal(table["side"], s)).combine_chunks() for s in (1, 2))
        alone = not len(two) and table["cell1"][0] == table["cell2"][0] and table["sub1"][0] == table["sub2"][0]
        if alone:
            two = one
        x, y = _chunk(one["rep"]), _chunk(two["rep"])
        grp = table["grp"][0].as_py()
        for i, j, cosine in products(vectors(one["vector"]), vectors(two["vector"]), least) if len(two) else ():
            a, b = x.take(pa.array(i)), y.take(pa.array(j))
            kept = pc.less(a, b) if alone else pc.not_equal(a, b)
            first = pc.less(a, b)
            made = pa.RecordBatch.from_arrays([pa.array([grp], pa.string()).take(pa.array(np.zeros(len(i), np.int64))), pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(cosine)], names=["grp", "a", "b", "cosine"])
            yield made.filter(kept)

    return every.groupBy("grp", "cell1", "sub1", "cell2", "sub2").applyInArrow(compare, f"grp string, a {kind}, b {kind}, cosine double")


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def cosine_search(asked: DataFrame, rows: DataFrame, key: str, vector: str, least: float, block: int = 4096) -> DataFrame:
    """(a, b, cosine) of unit vectors as they stand: every pair of a query and a row, but itself, with a product (to 4 places) of at
    least `least`. Rows are dealt out to blocks by a hash, queries to four times larger ones, and each block of rows meets each of
    queries as a matrix product; so a task's memory is bounded, and its pairs come in parts. Nulls give no pair."""
    whole = lambda df: df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    q, r = whole(asked), whole(rows)
    of_q, of_r = (max(1, math.ceil(df.count() / most)) for df, most in ((q, 4 * block), (r, block)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = q.select(dealt(of_q).alias("qb"), every(of_r).alias("rb"), F.size("v").alias("n"), F.lit(1).alias("side"), "id", "v")
    both = both.union(r.select(every(of_q).alias("qb"), dealt(of_r).alias("rb"), F.size("v").alias("n"), F.lit(2).alias("side"), "id", "v"))
    kind = q.schema["id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        one, two = (table.filter(pc.equal(table["side"], s)).combine_chunks() for s in (1, 2))
        if not len(one) or not len(two):
            return
        x, y = _chunk(one["id"]), _chunk(two["id"])
        for i, j, cosine in products(vectors_of(one["v"]), vectors_of(two["v"]), least):
            a, b = x.take(pa.array(i)), y.take(pa.array(j))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(cosine)], names=["a", "b", "cosine"]).filter(pc.not_equal(a, b))

    return both.groupBy("qb", "rb", "n").applyInArrow(compare, f"a {kind}, b {kind}, cosine double")
