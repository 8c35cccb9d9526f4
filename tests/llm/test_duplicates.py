import random
import re
from collections import Counter

import numpy as np
from helpers import ODD_DOCS, ODD_SCHEMA, classes, edit_distance, similarity, words
from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import common, lines, omh, queries


def made_docs(seed=3):
    """Groups of near copies with a share of changed words, copies, and unrelated texts with a common passage."""
    r = random.Random(seed)
    w = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    passage, out = w(60), []
    for _ in range(15):
        base = w(r.randint(40, 120))
        for share in (0, 0, 0.02, 0.05, 0.1):
            out.append([x if r.random() >= share else f"z{r.randrange(9999)}" for x in base])
    for _ in range(60):
        out.append(w(30) + passage + w(30))
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_near_duplicates_against_brute_force(spark):
    rows = made_docs()
    got = {r.doc_id: r for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ws = [(i, words(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(ws) for b, y in ws[:k] if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and similarity(x, y) >= 0.8]
    want = classes([i for i, _ in rows], links)
    assert len(got) == len(rows)
    # sketches find a link with a chance that falls with its edits: all but 1 % at 0.9, 9 in 10 from 0.8 on
    found = {p for p in links if got[p[0]].class_id == got[p[1]].class_id}
    by = dict(ws)
    close = [(a, b) for a, b in links if similarity(by[a], by[b]) >= 0.9]
    assert len(found) >= 0.9 * len(links) and sum(p in found for p in close) >= 0.99 * len(close) > 0
    assert all(want[r.doc_id] == want[r.class_id] for r in got.values())  # nothing else is put together


def test_large_group_and_passage(spark):
    r = random.Random(5)
    base = [f"b{r.randrange(900)}" for _ in range(120)]
    near = [[x if r.random() > 0.03 else f"c{r.randrange(9999)}" for x in base] for _ in range(300)]
    passage = [f"p{i}" for i in range(100)]
    other = [passage + [f"o{i}x{j}" for j in range(60)] for i in range(200)]
    rows = [(i, " ".join(t)) for i, t in enumerate(near + other)]
    got = {x.doc_id: x.class_id for x in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(300)} == {0} and all(got[i] == i for i in range(300, 500))


def test_recall_at_the_threshold(spark):
    """Pairs of long texts at edit similarity 0.8 to 0.82, one pair a group, against what the rule asks: all of them."""
    r = random.Random(9)
    rows = []
    for i in range(200):
        a = [f"w{r.randrange(10**6)}" for _ in range(r.choice((60, 100, 250)))]
        b = list(a)
        for k in r.sample(range(len(a)), len(a) // 5):
            b[k] = f"z{r.randrange(10**6)}"
        assert 0.8 <= similarity(a, b) <= 0.82
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = {x.doc_id: x.class_id for x in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(200)) >= 0.95 * 200


def test_links_in_large_buckets(spark):
    """150 pairs of texts that all share a passage of 60 words; of a pair's 40 own words every fifth differs (0.92): all are found."""
    r = random.Random(14)
    passage, rows = [f"p{i}" for i in range(60)], []
    for _ in range(150):
        own = [f"w{r.randrange(10**6)}" for _ in range(40)]
        rows += [" ".join(passage + own), " ".join(passage + [f"z{r.randrange(10**6)}" if k % 5 == 0 else w for k, w in enumerate(own)])]
    got = {x.doc_id: x.class_id for x in omh.near_duplicates(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()}
    assert all(got[2 * i + 1] == got[2 * i] == 2 * i for i in range(150))


def test_alignment_against_brute_force(monkeypatch):
    """The bounds, the trimming and all three alignments agree with the edit distance on random texts."""
    import numpy as np

    r = random.Random(15)
    for short, bits, few in ((100, 20_000, 64), (0, 20_000, 64), (0, 0, 64), (0, 0, 2)):
        for name, value in (("SHORT_ALIGNED", short), ("BIT_WORDS", bits), ("FEW_EDITS", few)):
            monkeypatch.setattr(omh, name, value)
        for _ in range(300):
            a = [r.randrange(r.choice((3, 50, 10**6))) for _ in range(r.randint(1, 40))]
            b = [w for w in a for w in r.choice(([w],) * 12 + ([], [w, r.randrange(50)], [r.randrange(50)]))]
            d = edit_distance(a, b)
            for band in {0, 1, max(0, d - 1), d, d + 1, 12}:
                assert omh.within(np.array(a, np.uint64), np.array(b, np.uint64), band) == (d <= band)


def test_texts_of_one_word(spark):
    """Lengths chain up to one class although the ends are far apart."""
    rows = [(n, "word " * n) for n in range(60, 460)]
    assert {x.class_id for x in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {60}


def test_near_duplicate_odd_rows(spark):
    docs = spark.createDataFrame(ODD_DOCS, ODD_SCHEMA)
    got = omh.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 1), (None, None)]
    kept = omh.deduplicated(docs)
    assert sorted(kept.columns) == sorted(docs.columns) and kept.where("doc_id is null").count() == 1 and kept.where("doc_id in (2, 5)").count() == 0
    assert omh.near_duplicates(docs.where("false")).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(60)] + [(700, 700)]
    got = {x.id: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == classes({i for e in edges for i in e}, edges)


def lettered(n):
    """A word for a number."""
    return "".join("abcdefghij"[int(c)] for c in str(n)) + "z"


def line_fixture():
    r = random.Random(2)
    line = lambda n: " ".join(lettered(r.randrange(5000)) for _ in range(n))
    same, fuzzy = line(60), line(80)
    changed = fuzzy.split()
    changed[7] = "otherword"
    docs = [(1, f"{same}\n{line(20)}\nshort line"), (2, f"{line(30)}\n{same.upper()}!!\nshort line"), (3, f"{fuzzy}\n\n{fuzzy}"), (4, " ".join(changed)), (5, line(40))]
    return docs, same, fuzzy


def test_lines(spark):
    docs, same, fuzzy = line_fixture()
    got = {r.doc_id: r.text for r in lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    was = dict(docs)
    assert got[1] == was[1] and got[5] == was[5]
    assert got[2] == was[2].split("\n")[0] + "\nshort line" and got[3] == fuzzy + "\n"


def test_line_recall_of_small_edits(spark):
    """One changed, added or lost word in lines of 5 to 160 words: 0.95 of the links that the rule asks for."""
    r = random.Random(6)
    sizes, rows = (5, 6, 8, 10, 20, 40, 80, 160), []
    for n in sizes:
        for i in range(100):
            a = [lettered(r.randrange(10**6)) for _ in range(n)]
            b, at = list(a), r.randrange(n)
            b[at : at + (i % 3 > 0)] = ["changed"] if i % 3 < 2 else []
            assert similarity(a, b) >= 0.8
            rows += [" ".join(a), " ".join(b)]
    out = {x.doc_id: x.text for x in lines.deduplicated(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()}
    for m, _ in enumerate(sizes):
        assert all(out[200 * m + 2 * i] for i in range(100)) and sum(out[200 * m + 2 * i + 1] == "" for i in range(100)) >= 95


def test_lines_against_brute_force(spark):
    """Documents of many kinds of lines: what goes is what all pairs of lines, compared, say."""
    r = random.Random(12)
    bases = [[lettered(r.randrange(3000)) for _ in range(r.choice((1, 2, 3, 4, 6, 9, 15, 40)))] for _ in range(60)]
    passage = [lettered(10000 + i) for i in range(30)]

    def line():
        kind = r.random()
        if kind < 0.2:
            return passage + [lettered(r.randrange(10**6)) for _ in range(20)]
        words_of_line = list(r.choice(bases))
        if kind < 0.5:
            words_of_line[r.randrange(len(words_of_line))] = lettered(r.randrange(10**6))
        return words_of_line if kind < 0.9 else []

    docs = [(i, [line() for _ in range(r.randint(1, 6))]) for i in range(150)]
    out = {x.doc_id: x.text for x in lines.deduplicated(spark.createDataFrame([(i, "\n".join(" ".join(w) for w in ls)) for i, ls in docs], "doc_id long, text string"), exact_words=1).collect()}
    every = [(i, k, tuple(w)) for i, ls in docs for k, w in enumerate(ls) if w]
    distinct = sorted({w for *_, w in every})
    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[:k] if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and similarity(a, b) >= 0.8]
    group, kept, wrong = classes(distinct, links), set(), 0
    for i, ls in docs:
        want = []
        for w in ls:
            if not w or group[tuple(w)] not in kept:
                want.append(" ".join(w))
                kept.add(group.get(tuple(w)))
        got, want = Counter(out[i].split("\n")), Counter(want or [""])
        wrong += sum((got - want).values()) + sum((want - got).values())
    assert len(links) > 50 and wrong <= 0.02 * len(every)


def test_links_in_large_line_buckets(spark):
    """150 pairs of lines that all share a passage; of a pair's own words every fifth differs."""
    r = random.Random(13)
    passage, rows = [lettered(i) for i in range(60)], []
    for _ in range(150):
        own = [lettered(r.randrange(10**6)) for _ in range(40)]
        rows += [" ".join(passage + own), " ".join(passage + [lettered(r.randrange(10**6)) if k % 5 == 0 else w for k, w in enumerate(own)])]
    out = {x.doc_id: x.text for x in lines.deduplicated(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()}
    assert all(out[2 * i] for i in range(150)) and sum(out[2 * i + 1] == "" for i in range(150)) >= 145


def test_line_recall_at_the_threshold(spark):
    """Pairs at edit similarity 0.8 to 0.85, on short and long lines, against what the rule asks: all of them."""
    r = random.Random(8)
    pairs = {n: [] for n in (5, 10, 20, 50)}
    for n in pairs:
        for _ in range(100):
            a = [lettered(r.randrange(10**6)) for _ in range(n)]
            b = list(a)
            for i in r.sample(range(n), n // 5):
                b[i] = lettered(r.randrange(10**6)) + "y"
            pairs[n].append((a, b))
    rows = [(k, " ".join(t)) for k, t in enumerate(t for n in pairs for p in pairs[n] for t in p)]
    out = {x.doc_id: x.text for x in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for m, n in enumerate(pairs):
        assert all(similarity(a, b) >= 0.8 for a, b in pairs[n])
        assert sum(out[200 * m + 2 * i + 1] == "" for i in range(100)) >= 90 and all(out[200 * m + 2 * i] for i in range(100))


def test_large_line_family(spark):
    """Lines of one repeated word, whose lengths chain up although the ends are far apart, and one line with ever more words changed."""
    rows = [(n, "la " * n) for n in range(40, 440)]
    base = [lettered(i) for i in range(100)]
    for i in range(300):
        base[(i * 7) % 70] = lettered(1000 + i)  # the last 30 words stay, so keys that lie there are shared by all
        rows.append((1000 + i, " ".join(base)))
    out = {x.doc_id: x.text for x in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(i for i, t in out.items() if t) == [40, 1000]


def test_line_query_leaves_no_equal_lines(spark, sf):
    """Short lines too: whatever has a word is there once."""
    left = [" ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())) for r in queries.op10_fuzzy_lines(spark, sf).collect() for t in (r.text or "").split("\n")]
    assert (n := [t for t in left if t]) and len(n) == len(set(n))


def test_lines_without_spaces(spark):
    a = "我们今天在这里讨论数据去重的方法，并且比较不同的结果。"
    rows = [(1, a), (2, a.replace("，", "、")), (3, a.replace("今天", "昨天")), (4, "完全不同的另一句话，与上面没有任何关系。"), (5, "人々の声を聞いた。"), (6, "人の声を聞いた。ある日のこと"), (7, "Émile 数据"), (8, "émile　数据！")]
    out = {x.doc_id: x.text for x in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), exact_words=1).collect()}
    assert sorted(i for i, t in out.items() if t) == [1, 4, 5, 6, 7]


def test_line_odd_rows(spark):
    docs = spark.createDataFrame(ODD_DOCS, ODD_SCHEMA)
    got = lines.deduplicated(docs)
    assert got.columns == docs.columns and got.count() == len(ODD_DOCS) and got.where("text is null").count() == 1
    assert lines.deduplicated(docs.where("false")).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.written(stage(spark, docs, sf))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert sorted(out.columns) == sorted(names)
        assert out.select("doc_id").distinct().count() == out.count() <= docs.count()
        docs = out
    assert docs.where("not round_trip").count() == 0 and docs.count() > 0.7 * n


def test_exact_copies_share_a_class(spark, sf):
    got = queries.op9_near_duplicates(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    per = got.join(docs, "doc_id").groupBy("text").agg(F.count_distinct("class_id").alias("n"))
    assert per.where("n > 1").count() == 0


def test_large_buckets_lose_no_pair(spark):
    """One bucket of 400 texts that share a passage; every second is the one before it, edited up to the threshold."""
    r = np.random.default_rng(11)
    passage, rows = r.integers(1, 1 << 63, 20).astype(np.uint64), []
    for i in range(200):
        text = np.r_[passage, r.integers(1, 1 << 63, 40).astype(np.uint64)]
        other = text.copy()
        other[r.choice(60, 12, replace=False)] = r.integers(1, 1 << 63, 12).astype(np.uint64)
        rows += [(2 * i, text), (2 * i + 1, other)]
    keys = spark.createDataFrame([(i, 0, 77, len(rows), 0) for i, _ in rows], "id long, j int, key long, size long, id2 long")
    bounds = spark.createDataFrame([(i, [int(x) for x in omh.bound(w, omh.BOUND_LONGS).view(np.int64)]) for i, w in rows], "id long, bound array<long>")
    codes = spark.createDataFrame([(i, 0, bytearray((w >> np.uint64(32)).astype("<u4").tobytes())) for i, w in rows], "id long, rank int, codes binary")
    links, joined = omh.linked(keys, bounds, codes, 0.8)
    assert sorted((x.a, x.b) for x in links.collect()) == [(2 * i, 2 * i + 1) for i in range(200)]
    assert sorted((x.id, x.component) for x in joined.collect()) == [(i, i - i % 2) for i in range(400)]


def test_each_two_near_texts_share_a_rare_run():
    """Whatever the weights: random texts and copies with up to a fifth of their words replaced, put in or taken out share a
    label; texts of the same words in another order mostly share none."""
    rng = random.Random(11)
    apart = 0
    for n in [*range(2, 30), 50, 200] * 6:
        weight = np.array([rng.randrange(50) for _ in range(omh.SLOTS)])
        x = [rng.randrange(rng.choice([2, 8, 1000])) for _ in range(n)]
        y, edits = list(x), 0
        while edits + 1 <= 0.2 * max(n, len(y)) and rng.random() < 0.95:
            i, kind = rng.randrange(len(y)), rng.randrange(3)
            y[i : i + (kind < 2)] = [rng.randrange(1000)] * (kind != 1)
            edits += 1
        if edits <= int(0.2 * max(n, len(y)) + 1e-9) and len(y) > 1:
            a, b = (set(omh.rare_runs(np.array(v, "<u4"), weight, 0.8).tolist()) for v in (x, y))
            assert a & b, (x, y)
        v = list(range(n))
        rng.shuffle(v)
        a, b = (set(omh.rare_runs(np.array(w, "<u4"), weight, 0.8).tolist()) for w in (v, range(n)))
        apart += not a & b
    assert apart > 90


def pools():
    """Texts as in large buckets: a shared passage of three quarters, and families of near copies of many lengths."""
    r = random.Random(21)
    passage, out = [f"p{i}" for i in range(45)], []
    for _ in range(60):
        out.append(passage + [f"w{r.randrange(300)}" for _ in range(15)])
    for n in (3, 7, 12, 33, 60, 90):
        base = [f"b{r.randrange(200)}" for _ in range(n)]
        for _ in range(12):
            out.append([w for x in base for w in r.choice(([x],) * 30 + ([], [f"c{r.randrange(99)}"], [x, f"c{r.randrange(99)}"]))])
    return [(i, t) for i, t in enumerate(out) if t]


def test_blocks_lose_no_pair(spark, monkeypatch):
    """What meets in blocks, of few texts each, is joined as all pairs join it, and no two texts make a link twice."""
    monkeypatch.setattr(omh, "BLOCK_TEXTS", 7)
    rows = pools()
    code = lambda t: bytearray(b"".join(("pwbc".index(w[0]) * 100_000 + int(w[1:])).to_bytes(4, "little") for w in t))
    texts = spark.createDataFrame([(i, i, code(t)) for i, t in rows], "id long, c long, codes binary")
    got = [(x.a, x.b) for x in omh.in_blocks(texts, 0.8).collect()]
    by = dict(rows)
    links = [(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[:k] if edit_distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)]
    assert len(got) == len(set(got)) and all(edit_distance(by[a], by[b]) <= int(0.2 * max(len(by[a]), len(by[b])) + 1e-9) for a, b in got)
    assert classes([i for i, _ in rows], got) == classes([i for i, _ in rows], links) and len(links) > 100


def test_few_pairs_are_made_of_a_large_bucket(spark):
    """Texts that share three quarters without being near are compared in blocks: their pairs are no rows of a join."""
    made = []
    r = random.Random(22)
    passage = [f"p{i}" for i in range(90)]
    rows = [(i, " ".join(passage + [f"w{r.randrange(3000)}" for _ in range(30)])) for i in range(600)]
    real = omh.verified
    omh.verified = lambda pairs, *rest: made.append(pairs.count()) or real(pairs, *rest)
    try:
        got = omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        omh.verified = real
    assert sum(made) <= 20 * len(rows) and len({x.class_id for x in got}) == len(rows)


def test_steps_are_freed(spark):
    """Of the written steps only the results of the operators stay."""
    from pathlib import Path

    docs, *_ = line_fixture()
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    there = lambda: {p.name for p in Path(common.scratch(spark)).iterdir()}
    before = there()
    kept, classed = lines.deduplicated(docs), omh.near_duplicates(docs)
    assert len(there() - before) <= 2 and kept.count() == classed.count() == 5


def test_large_pools_meet_by_rare_runs_first(spark, monkeypatch):
    """More texts than FEW_TEXTS: rare runs, then blocks, with the same result."""
    monkeypatch.setattr(omh, "FEW_TEXTS", 10)
    test_large_buckets_lose_no_pair(spark)
    test_links_in_large_buckets(spark)


def test_pairs_of_a_bucket_are_made_by_their_bounds(spark, monkeypatch):
    """Buckets of every size: what is joined is what all pairs of a bucket join, and of 300 unrelated texts in one bucket no
    pair is made; the same where buckets count as large or as those of many pairs."""
    r = random.Random(31)
    near = lambda t: [w if r.random() > 0.12 else r.randrange(1 << 31) for w in t]
    fresh = lambda n: [r.randrange(1 << 31) for _ in range(n)]
    texts, keys = [], []
    for key, size in enumerate((2, 3, 5, 15, 16, 17, 40)):
        bases = [fresh(r.randint(20, 60)) for _ in range(1 + size // 4)]
        for _ in range(size):
            keys.append((len(texts), key))
            texts.append(near(r.choice(bases)))
    linked = len(texts)
    keys += [(i, 99) for i in range(linked, linked + 300)]
    texts += [fresh(30) for _ in range(300)]
    links = [(a, b) for k, (a, x) in enumerate(keys) for b, y in keys[:k] if x == y < 99 and edit_distance(texts[a], texts[b]) <= int(0.2 * max(len(texts[a]), len(texts[b])) + 1e-9)]
    want = {i: c for i, c in classes(range(linked), links).items()}
    codes = spark.createDataFrame([(i, 0, bytearray(np.array(t, "<u4").tobytes())) for i, t in enumerate(texts)], "id long, rank int, codes binary")
    bounds = spark.createDataFrame([(i, [int(x) for x in omh.bound(np.array(t, np.uint64) << np.uint64(20), 4).view(np.int64)]) for i, t in enumerate(texts)], "id long, bound array<long>")
    alone = [(i, 1000 + i) for i in range(50)]
    held = common.written(omh.shared_keys(spark.createDataFrame([*keys, *keys[:90], *alone], "id long, key long"), 1000))
    assert sorted((x.id, x.key) for x in held.collect()) == sorted(keys)
    made, real = [], omh.verified
    monkeypatch.setattr(omh, "verified", lambda pairs, *rest: made.append(pairs.count()) or real(pairs, *rest))
    for name, value in (("FEW_MEMBERS", 16), ("FEW_MEMBERS", 2), ("MANY_PAIRS", 0), ("BUCKET", 10)):
        monkeypatch.setattr(omh, name, value)
        made.clear()
        _, joined = omh.linked(held, bounds, codes, 0.8)
        got = {x.id: x.component for x in joined.collect()}
        assert len(links) > 50 and {i: got.get(i, i) for i in range(len(texts))} == want | {i: i for i in range(linked, len(texts))}
        assert name == "BUCKET" or sum(made) <= 2 * linked


def test_counted_bounds_lose_no_pair():
    """Texts of many lengths, of few words or many, and copies edited up to and beyond the threshold: bounds of one size or two
    leave room for all pairs that are near, row by row as by buckets, and for few that the counts of each word exclude."""
    r = random.Random(41)
    texts = []
    for _ in range(60):
        v = r.choice((2, 8, 1 << 30))
        base = [r.randrange(v) * 2654435761 % (1 << 32) for _ in range(r.choice((1, 3, 10, 60, 64, 65, 70, 128, 130, 160)))]
        texts.append(base)
        for p in (0.05, 0.15, 0.25):
            texts.append([w for x in base for w in ([x] if r.random() > p else r.choice(([], [r.randrange(1 << 32)], [x, r.randrange(1 << 32)])))] or [1])
    first = np.r_[0, np.cumsum([len(t) for t in texts])]
    bounds = omh._Bounds(omh.counted_bounds(np.concatenate([np.array(t, "<u4") for t in texts]), first))
    room = omh._room_within(bounds, 0, len(texts), 0.8)
    i, j = np.triu_indices(len(texts), 1)
    assert bounds.n.tolist() == [len(t) for t in texts] and len(set(bounds.width.tolist())) == 3
    assert (room[i, j] == omh._room(bounds, i, j, 0.8)).all()
    near = counted = 0
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = texts[a], texts[b]
        band = int(0.2 * max(len(x), len(y)) + 1e-9)
        counted += max((Counter(x) - Counter(y)).total(), (Counter(y) - Counter(x)).total()) <= band
        if abs(len(x) - len(y)) <= band and edit_distance(x, y) <= band:
            near += 1
            assert room[a, b], (x, y)
    assert near > 60 and room.sum() < 1.6 * counted


def test_lines_that_repeat_phrases_make_no_pairs(spark, monkeypatch):
    """Lines of one phrase eighteen times, three words of it common to all: they share keys, but no two are near (F1, F2)."""
    r, made, real = random.Random(42), [], omh.verified
    monkeypatch.setattr(omh, "verified", lambda pairs, *rest: made.append(pairs.count()) or real(pairs, *rest))
    rows = [(i, " ".join(([lettered(k) for k in range(3)] + [lettered(100 + r.randrange(10**6)) for _ in range(5)]) * 18)) for i in range(60)]
    out = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.text for x in out) and len(out) == 60 and sum(made) == 0


def test_pairs_are_aligned_in_parts(spark, monkeypatch):
    """More pairs than FEW_PAIRS carry their texts through shuffles a part at a time, with the same result (F1, F2); so do blocks."""
    r, made, real = random.Random(43), [], omh.verified
    monkeypatch.setattr(omh, "verified", lambda pairs, *rest: made.append(pairs.count()) or real(pairs, *rest))
    monkeypatch.setattr(omh, "FEW_PAIRS", 20)
    rows = []
    for _ in range(80):
        a = [lettered(r.randrange(10**6)) for _ in range(30)]
        rows += [" ".join(a), " ".join(a[:-1] + [lettered(r.randrange(10**6))])]
    out = {x.doc_id: x.text for x in lines.deduplicated(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()}
    assert all(out[2 * i] for i in range(80)) and sum(out[2 * i + 1] == "" for i in range(80)) >= 78
    assert len(made) >= 4 and max(made) <= 40
    monkeypatch.setattr(omh, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(omh, "LEAST_MEETINGS", 5)
    test_blocks_lose_no_pair(spark, monkeypatch)
