"""The exact cosine join and tree contributions against brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from emberline.operators import ml, similar
from emberline.operators.ranking import confusion


def made(n=160, dims=6, seed=1):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(8)]
    rows = []
    for i in range(n):
        c = centres[i % 8]
        rows.append((i, f"g{i % 3}", [x + r.gauss(0, 0.15) for x in c]))
    rows += [(900, "g0", rows[0][2]), (901, "g0", rows[0][2]), (902, "g1", rows[0][2]), (903, "g0", None), (904, "g0", [0.0] * dims), (905, None, rows[3][2])]
    return rows


def brute(rows, least, grouped):
    reps = {}
    for i, g, v in sorted((r for r in rows if r[2] and any(r[2])), key=lambda r: r[0]):
        reps.setdefault((g or "" if grouped else "", tuple(v)), i)
    out = []
    for ((g, v), i), ((h, w), j) in combinations(reps.items(), 2):
        c = round(sum(a * b for a, b in zip(v, w)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w)), 4)
        if g == h and c >= least:
            out.append((g, min(i, j), max(i, j), c))
    return sorted(out)


@pytest.mark.parametrize("group", [None, "g"])
@pytest.mark.parametrize("least,block", [(0.95, 8192), (0.3, 7), (0.99, 4), (-0.5, 50)])
def test_cosine_pairs_against_brute_force(spark, group, least, block):
    rows = made()
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    got = [(r.grp, r.a, r.b, round(r.cosine, 4)) for r in similar.cosine_pairs(df, "id", "v", least, group, pivots=6, block=block).collect()]
    assert sorted(got) == brute(rows, least, group is not None)


def test_clustered_blocks_meet_few_others(spark):
    df = spark.createDataFrame(made(400), "id long, g string, v array<double>")
    classes = similar.vector_classes(df, "id", "v")
    placed, pairs = similar.block_pairs(classes, 0.99, pivots=16, block=10)
    n = placed.select("cell", "sub").distinct().count()
    assert pairs.count() < 0.5 * n * (n + 1) / 2


def test_cosine_pairs_of_strings_and_nothing(spark):
    none = spark.createDataFrame([], "id string, v array<float>")
    assert similar.cosine_pairs(none, "id", "v", 0.5).count() == 0
    two = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("c", [0.0, 1.0])], "id string, v array<float>")
    assert [(r.a, r.b) for r in similar.cosine_pairs(two, "id", "v", 0.9).collect()] == [("a", "b")]


# trees


def value(leaves, x, known):
    """The game's value: leaves on the row's path for known features, by training shares for others."""
    total = 0.0
    for leaf in leaves:
        p = leaf["value"]
        for f, (low, high, share) in leaf["path"].items():
            p *= (low < x[f] <= high) if f in known else share
        total += p
    return total


@pytest.fixture(scope="module")
def fitted(spark):
    r = random.Random(3)
    rows = []
    for i in range(240):
        x = [r.random() for _ in range(5)]
        rows.append((i, int(x[0] + x[1] * x[2] > 0.8), x, 1.0))
    df = spark.createDataFrame(rows, "key long, label int, x array<double>, weight double").withColumn("features", array_to_vector("x"))
    return df, ml.tree_model(rounds=6).fit(df)


def test_tree_contributions_equal_shapley_values_by_subsets(spark, fitted, tmp_path):
    df, model = fitted
    leaves = ml.tree_paths(model, str(tmp_path / "m"))
    assert max(len(leaf["path"]) for leaf in leaves) >= 3
    xs = np.array([r.x for r in df.orderBy("key").limit(6).collect()])
    base, got = ml.shapley(leaves, xs)
    assert base == pytest.approx(value(leaves, xs[0], set()))
    k = xs.shape[1]
    for x, c in zip(xs, got):
        for f in range(k):
            others = [g for g in range(k) if g != f]
            want = sum(math.factorial(s) * math.factorial(k - 1 - s) / math.factorial(k) * (value(leaves, x, {*t, f}) - value(leaves, x, set(t))) for s in range(k) for t in combinations(others, s))
            assert c[f] == pytest.approx(want, abs=1e-10)


def test_tree_contributions_add_up_to_the_margin(fitted, tmp_path):
    df, model = fitted
    got = ml.tree_contributions(model, df, str(tmp_path / "m"))
    total = got.groupBy("key").agg((F.first("base") + F.sum("contribution")).alias("total"))
    margins = model.transform(df).select("key", vector_to_array("rawPrediction")[1].alias("margin"))
    worst = total.join(margins, "key").select(F.max(F.abs(F.col("total") - F.col("margin")))).first()[0]
    assert worst < 1e-9
    order = [r.feature for r in ml.importance(got).orderBy(F.desc("importance")).collect()]
    assert set(order[:3]) == {0, 1, 2}


def test_folds_score_every_row_once(spark, fitted):
    df, _ = fitted
    scored = ml.out_of_fold(df.select("key", "label", "features"), ml.tree_model(rounds=3), folds=3)
    assert scored.count() == 240 and scored.select("key").distinct().count() == 240
    assert confusion(scored).first().accuracy > 0.7


def test_products_as_they_stand_round_as_a_plain_loop(spark):
    """Vectors that are of unit length to 1e-7 only, and products next to a half of the last place: what SQL's dot product says."""
    r = random.Random(3)
    rows = []
    for i in range(120):
        v = [r.gauss(0, 1) for _ in range(8)]
        n = math.sqrt(sum(x * x for x in v)) * (1 + r.uniform(-4e-3, 4e-3))
        rows.append((i, [x / n for x in v]))
    rows += [(200, [0.5, 0.5, 0.5, 0.5, 0, 0, 0, 0]), (201, [0.6001, 0.6, 0.5, 0.1, 0, 0, 0, 0]), (202, [0.59995, 0.8, 0, 0, 0, 0, 0, 0]), (203, [1.0, 0, 0, 0, 0, 0, 0, 0]), (204, [2.0, 0, 0, 0, 0, 0, 0, 0])]
    rows = [(i, [float(x) for x in v]) for i, v in rows]

    def score(v, w):
        total = 0.0
        for x, y in zip(v, w):
            total += x * y
        return math.floor(total * 1e4 + 0.5) / 1e4

    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = {(i, j): score(v, w) for (i, v), (j, w) in combinations(rows, 2) if score(v, w) >= 0.6}
    for block in (8192, 9):
        got = {(x.a, x.b): x.cosine for x in similar.cosine_pairs(df, "id", "v", 0.6, pivots=5, block=block, as_unit=True).collect()}
        assert got == want
    asked = df.where("id % 5 = 0")
    both = want | {(j, i): c for (i, j), c in want.items()}
    for block in (4096, 10):
        found = similar.cosine_search(asked, df, "id", "v", 0.6, block=block).collect()
        assert len(found) == len({(x.a, x.b) for x in found})
        assert {(x.a, x.b): x.cosine for x in found} == {k: c for k, c in both.items() if k[0] % 5 == 0}
