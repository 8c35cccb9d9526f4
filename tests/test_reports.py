"""Reports over mergeable sketches, splits with reasons, and the native word similarity."""

import json
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from emberline.operators import dedupe, names, reports, rules
from emberline.sources import readers


def test_matching_blocks_against_the_library(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde1") for _ in range(rng.randint(1, 14)))
    pairs = [(word(), word()) for _ in range(150)]
    for _ in range(150):  # near ones, at the threshold too
        w = list(word() + word())
        v = [c for c in w if rng.random() > 0.1]
        pairs.append(("".join(w), "".join(v) or "a"))
    df = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    got = df.select("a", "b", names.matched_letters(F.col("a"), F.col("b")).alias("m"), names.alike(F.col("a"), F.col("b")).alias("near")).collect()
    for r in got:
        s = SequenceMatcher(None, r.a, r.b)
        assert r.m == sum(x.size for x in s.get_matching_blocks()), (r.a, r.b)
        assert r.near == (s.ratio() >= names.ALIKE), (r.a, r.b)
    assert 20 < sum(r.near for r in got) < 280


def test_distinct_sketches_roll_up(spark):
    rows = spark.range(40_000).select(F.concat(F.lit("t"), F.col("id") % 3).alias("term"), (F.col("id") % 7).alias("year"), F.pmod(F.xxhash64("id"), F.lit(9_000)).alias("org"))
    rolled = {r.term: r.estimate for r in reports.rolled_up(reports.distinct_sketches(rows, ["term", "year"], "org"), ["term"]).collect()}
    exact = {r.term: r.distinct_orgs for r in reports.distinct_organisations(rows, "term", "org", most=1 << 30).collect()}
    assert set(rolled) == set(exact) and all(abs(rolled[t] - n) <= 0.06 * n for t, n in exact.items())
    assert {r.distinct_orgs for r in reports.distinct_organisations(rows, "term", "org").collect()} == {200}


def test_quantile_sketches_merge_within_their_rank_error(spark):
    rows = spark.range(30_000).select((F.col("id") % 2).alias("kind"), (F.col("id") % 11).alias("part"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("v"))
    got = {r.kind: r for r in reports.sketched_quartiles(reports.quantile_sketches(rows, ["kind", "part"], "v"), ["kind"]).collect()}
    for kind in (0, 1):
        values = sorted(r.v for r in rows.where(F.col("kind") == kind).collect())
        for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
            rank = sum(v <= got[kind][name] for v in values) / len(values)
            assert abs(rank - q) < 0.03 and got[kind].n == len(values)
    exact = reports.quartiles(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", None)], "k string, v double"), "k", "v")
    assert sorted(tuple(r) for r in exact.collect()) == [("a", 1.5, 2.0, 3.0), ("b", None, None, None)]


def test_split_tells_why(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    flagged = spark.createDataFrame([(2, "old"), (2, "bad"), (9, "x")], "k int, reason string")
    got = sorted(((r.k, r.part, r.reason) for r in reports.split_by_keys(rows, flagged, "k").collect()), key=str)
    assert got == [(1, "kept", None), (2, "removed", "bad"), (2, "removed", "bad"), (None, "kept", None)]


def test_type_counts_run_files_and_limits(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"term": "kelp", "group_by": [{"key": "https://x.example/types/preprint", "count": 3}, {"key": "article", "count": 5}, {"key": None, "count": 1}]}))
    assert sorted(tuple(r) for r in readers.type_counts(spark, str(tmp_path / "t.json")).collect()) == [("kelp", "article", 5), ("kelp", "preprint", 3)]
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "a.json").write_text('{\n  "run_id": "1",\n  "query": "q"\n}\n')
    (runs / "b.json").write_text("{broken\n")
    (runs / "c.json").write_text('{"query": "no id"}')
    good, bad = readers.run_files(spark, str(runs))
    assert [r.run_id for r in good.collect()] == ["1"] and sorted(r.raw for r in bad.collect()) == ['{"query": "no id"}', "{broken\n"]
    (tmp_path / "l.json").write_text('{"name": "mature_min", "value": 70}\n{"name": "hype_ratio_min", "value": 0.25}\n{"name": "other", "value": 1}\n')
    assert rules.limits_of(readers.dimension(spark, str(tmp_path / "l.json"), "name string, value double")) == rules.Limits(mature_min=70, hype_ratio_min=0.25)


def test_variants_of_string_ids_stay_in_their_run(spark):
    rows = [("a", "x1", "kelp farm robots", 0.9), ("a", "x2", "kelp farm", 0.8), ("b", "x3", "kelp farm robots", 0.7), ("b", "x4", "kelp farm robots deep", 0.6), ("b", "x5", "peat wall", 0.5)]
    df = spark.createDataFrame(rows, "run string, id string, name string, score double")
    assert sorted(map(tuple, dedupe.containment_pairs(df, "run").collect())) == [("x1", "x2"), ("x4", "x3")]
    got = sorted((r.run, r.id, r.place) for r in dedupe.without_variants(df).collect())
    large = spark.createDataFrame([(r, 9_000_000_000_000_000_000 + i, n, s) for i, (r, _, n, s) in enumerate(rows)], "run string, id long, name string, score double")
    want = sorted((r.run, f"x{r.id - 9_000_000_000_000_000_000 + 1}", r.place) for r in dedupe.without_variants(large).collect())
    assert got == want == [("a", "x1", 0), ("b", "x4", 0), ("b", "x5", 1)]
