"""Every registered query with SQL against DuckDB over the smallest tables."""

import math

import duckdb
import pytest

from emberline.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, con, sf, name):
    df = Q.QUERIES[name](spark, sf)
    got = sorted([tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()], key=str)
    cur = con.execute(Q.SQL[name])
    cols = [c[0] for c in cur.description]
    want = sorted([tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()], key=str)
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def test_backfill_passes_some_over(spark):
    """At the scale its limits fit, some of the best terms have no documents and the next move up."""
    from pyspark.sql import functions as F

    from emberline.operators import ranking, rules

    sf = "/root/testdata/sf0.01"
    got = Q.w6_top_signals(spark, sf).orderBy("rank").collect()
    kept = ranking.heuristic(rules.decided(Q.table(spark, sf), Q.LIMITS).where("not excluded"), Q.AS_OF)
    best = [r.term for r in kept.orderBy(F.desc("score"), "term").limit(15).collect()]
    assert got and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert set(best) - {r.term for r in got}


def test_suppression_over_all_vectors(spark, sf):
    """Greedy over every vector of each label, against a plain loop."""
    rows = sorted((r.label, r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    kept: dict = {}
    for label, i, v in rows:
        mine = kept.setdefault(label, [])
        if all(v != w and round(sum(a * b for a, b in zip(v, w)), 4) < 0.3 for _, w in mine):
            mine.append((i, v))
    got = sorted((r.run, r.id) for r in Q.w13_greedy_suppression(spark, sf).select("run", "id").collect())
    assert got == sorted((str(label), i) for label, vs in kept.items() for i, _ in vs)
