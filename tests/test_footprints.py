"""Folded counts and refreshed features against recounts, cards against brute force, reason texts by hand."""

import random
import re
from collections import Counter
from datetime import date, datetime

from pyspark.sql import functions as F

from emberline.functions.text import reason_texts
from emberline.operators import dedupe, footprints, ranking

ROWS = "doc string, term string, day date"


def counted(rows):
    return Counter((t, d.year) for _, t, d in {(doc, t, date(d.year, 1, 1)) for doc, t, d in rows if doc and t and d})


def as_counts(df):
    return {(r.term, r.year): r.n for r in df.collect()}


def versions(rng, docs, n):
    return [(rng.choice(docs), rng.choice(["a b", "c", "é", None]), rng.choice([date(2019, 5, 1), date(2020, 1, 1), date(2020, 12, 31), None])) for _ in range(n)]


def test_increments_equal_a_full_recount(spark, tmp_path):
    """Documents come, change and go over four landings; repeated batches count once."""
    rng, path = random.Random(5), str(tmp_path / "counts")
    now: dict = {}
    for step in range(4):
        docs = [f"d{i}" for i in range(step * 10, step * 10 + 20)]
        new = versions(rng, docs, 40)
        seen = [r for d in docs for r in now.get(d, [])]
        for d in docs:
            now[d] = [r for r in new if r[0] == d]
        frame = lambda rows: spark.createDataFrame(rows, ROWS)
        deltas = footprints.count_deltas(frame(seen) if seen else None, frame(new), "doc", "term", "day")
        for _ in range(2):
            footprints.fold_into(path, deltas, f"landing-{step}", buckets=4)
        assert as_counts(footprints.stored_counts(spark, path)) == dict(counted(r for rows in now.values() for r in rows))


def test_fold_leaves_other_buckets_and_cancels(spark, tmp_path):
    path = tmp_path / "counts"
    first = spark.createDataFrame([(f"t{i}", 2020, 1) for i in range(40)], "term string, year int, n bigint")
    footprints.fold_into(str(path), first, "one", buckets=8)
    files = {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    footprints.fold_into(str(path), spark.createDataFrame([("t3", 2020, -1), ("t3", 2021, 2)], first.schema), "two", buckets=8)
    after = {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    touched = {f.split("_bucket=")[1].split("/")[0] for f in set(files.items()) ^ set(after.items()) for f in [f[0]]}
    assert len(touched) == 1
    got = as_counts(footprints.stored_counts(spark, str(path)))
    assert len(got) == 40 and got[("t3", 2021)] == 2 and ("t3", 2020) not in got


def test_a_batch_that_failed_half_way_is_folded_once_everywhere(spark, tmp_path):
    """Only some buckets of the batch were written: putting it again completes the others."""
    path = str(tmp_path / "counts")
    rows = spark.createDataFrame([(f"t{i}", 2020, 1) for i in range(30)], "term string, year int, n bigint")
    footprints.fold_into(path, rows, "one", buckets=4)
    both = rows.withColumn("n", F.lit(5).cast("bigint"))
    part = both.where(F.pmod(F.xxhash64("term"), F.lit(4)) < 2)
    footprints.fold_into(path, part, "two", buckets=4)
    footprints.fold_into(path, both, "two", buckets=4)
    assert set(as_counts(footprints.stored_counts(spark, path)).values()) == {6}


def test_unchanged_and_empty_deltas(spark):
    rows = spark.createDataFrame([("d", "t", date(2020, 1, 1)), ("d", "t", date(2020, 1, 1)), (None, "t", date(2020, 1, 1))], ROWS)
    assert footprints.count_deltas(rows, rows, "doc", "term", "day").count() == 0
    assert as_counts(footprints.count_deltas(None, rows, "doc", "term", "day")) == {("t", 2020): 1}
    none = rows.where("false")
    assert footprints.folded(None, footprints.count_deltas(None, none, "doc", "term", "day")).count() == 0


def test_stale_or_touched_terms_only(spark):
    at = datetime(2024, 1, 31)
    shots = spark.createDataFrame([("old", datetime(2024, 1, 1)), ("new", datetime(2024, 1, 30)), ("hit", datetime(2024, 1, 30))], "term string, at timestamp")
    wanted = spark.createDataFrame([("old",), ("new",), ("hit",), ("unseen",), (None,)], "term string")
    deltas = spark.createDataFrame([("hit", 2020, 1)], "term string, year int, n int")
    got = footprints.to_refresh(wanted, shots, deltas, "at", F.lit(at), 7)
    assert sorted(r.term for r in got.collect()) == ["hit", "old", "unseen"]


def test_refreshed_rows(spark):
    kept = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "term string, total bigint")
    series = spark.createDataFrame([("b", 2020, 7), ("b", 2021, 1), ("a", 2020, 50), ("d", 2020, 4)], "term string, year int, n bigint")
    terms = spark.createDataFrame([("b",), ("c",), ("d",)], "term string")
    got = footprints.refreshed(kept, terms, series, lambda s: s.groupBy("term").agg(F.sum("n").alias("total")))
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 8), ("d", 4)]


def test_cards_by_name_or_description(spark):
    cards = [(1, "Federated graph learning", "x"), (2, "Graphs", "we use federated graph, learning"), (3, None, "Federated  graph"), (4, "Learning", "a federated graph-based way"), (5, "Learn federated", None), (6, "other", "(federated graph)")]
    items = [("i", "federated graph"), ("j", "learning"), ("k", None), ("i", "federated graph"), ("l", "")]
    got = dedupe.cards_naming(spark.createDataFrame(cards, "id int, name string, description string"), spark.createDataFrame(items, "item string, term string"))
    found = {(r.item, r.id): r.by for r in got.collect()}
    want = {("i", 1): "name"}
    for item, term in {("i", "federated graph"), ("j", "learning")}:
        for i, _, text in cards:
            if text and re.search(rf"(?<![\w-]){term}(?![\w-])", text.lower()):
                want.setdefault((item, i), "description")
    assert found == want


def test_reason_texts(spark):
    schema = "total_pubs long, pubs_last_year long, growth_3y double, recent_share double, first_seen_year int, news_total long, news_recent long, news_to_science_ratio double, has_wikipedia boolean, preprint_share double"
    df = spark.createDataFrame([(1234567, None, 0.605, 0.125, 2019, 7, 0, 0.4567, True, 1.0), (None,) * 10], schema)
    full, none = [r.t for r in df.select(reason_texts().alias("t")).collect()]
    assert full["log_total_pubs"].endswith(": 1 234 567") and full["log_pubs_last_year"].endswith("нет данных")
    assert " 60% " in full["growth_3y"] and full["recent_share"].startswith("12% ") and "2019" in full["age_years"]
    assert full["news_to_science"].endswith("0.46") and full["has_wikipedia"].startswith("Есть")
    assert none["has_wikipedia"].startswith("Нет") and none["news_to_science"].endswith("0.00") and all(none.values())


def test_told_reasons(spark):
    df = spark.createDataFrame([(500, 9, 0.2, 0.5, 2019, 3, 1, 0.1, True, None, True)], "total_pubs long, pubs_last_year long, growth_3y double, recent_share double, first_seen_year int, news_total long, news_recent long, news_to_science_ratio double, has_wikipedia boolean, preprint_share double, has_standard boolean")
    (row,) = ranking.told(ranking.heuristic(df, 2024)).collect()
    assert [r.feature for r in row.reasons] == ["has_standard", "total_pubs", "first_seen_year"]
    assert row.reasons[0].text is None and row.reasons[1].text.endswith(": 500")


def test_more_rows_are_dealt_over_more_tasks(spark, monkeypatch):
    """A task compares PART_ROWS rows, whatever the number of shuffle partitions, with the counts of a full recount."""
    monkeypatch.setattr(footprints, "PART_ROWS", 50)
    rng = random.Random(8)
    for n, parts in ((40, 1), (400, 8), (4000, 80)):
        rows = [(f"d{rng.randrange(n // 3)}", rng.choice("abc"), date(2019 + rng.randrange(3), 1, 1)) for _ in range(n)]
        frame = footprints.dealt(spark.createDataFrame(rows, ROWS), "doc", n)
        assert frame.rdd.getNumPartitions() == parts
        assert as_counts(footprints.count_deltas(None, frame, "doc", "term", "day")) == dict(counted(rows))
