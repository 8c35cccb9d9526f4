"""Prefix trie, spelling variants and the backoff model against brute force."""

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import duckdb
import pytest
from pyspark.sql import functions as F

from emberline.llm import katz, queries, spelling, trie

TABLES = ["documents", "conversations"]


def same(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    cur = con.execute(queries.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = Counter(cur.fetchall())
    assert want and Counter(tuple(r[c] for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_trie_query_against_sql(spark, sf):
    same(spark, sf, "op11_prefix_trie")


def test_spelling_query_against_sql(spark, sf):
    same(spark, sf, "op12_spelling_variants")


# trie


def brute_trie(turns, members):
    seqs = {c: [] for c in members if c is not None}
    for c, turn, role, text in sorted((t for t in turns if t[0] is not None), key=lambda t: (t[0], t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        seqs.setdefault(c, []).append((role or "", text or ""))
    at = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            at[tuple(s[:d])].append(c)
    out = []
    for p, cs in at.items():
        below = [q for q in at if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(at[q]) - 1) * len((q[-1][1].encode().split()) if q else []) for q in below)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(seqs[c]) == len(p)))
        out.append((min(cs), len(p), min(at[p[:-1]]) if p else None, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got_trie(spark, turns, members, limit=None):
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    m = spark.createDataFrame([(c, "x") for c in members], "conv_id long, depth string")
    df = trie.prefix_trie(trie.ordered(t).withColumn("a", F.lit("clash")), m, limit)
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def made_turns(seed=5, n=70):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), r.choice(["a b", "c", "a  b", " x\ty\vz "])) for c in range(-5, n) for t in range(r.randint(0, 6))]


@pytest.mark.parametrize("limit", [None, 1, 4])
def test_trie_against_brute_force(spark, limit):
    turns = made_turns()
    members = list(range(-5, 70))
    assert got_trie(spark, turns, members, limit) == brute_trie(turns, members)


def test_trie_of_odd_rows(spark):
    turns = [(1, None, None, None), (1, 2, "user", "hi"), (1, 2, "user", "hi"), (2, 1, "", ""), (2, 7, "user", "hi"), (None, 1, "user", "lost"), (3, 1, "user", "w " * 50_000)]
    members = [1, 2, 3, 4, 4, None]
    assert got_trie(spark, turns, members) == brute_trie(turns, members)
    assert got_trie(spark, [], [9]) == brute_trie([], [9])
    assert got_trie(spark, [], []) == []


def test_trie_with_one_long_and_one_common_conversation(spark):
    turns = [(0, t, "user", f"t{t % 3}") for t in range(400)] + [(c, t, "user", "same") for c in range(1, 40) for t in range(3)]
    want = brute_trie(turns, list(range(40)))
    assert got_trie(spark, turns, list(range(40)), 8) == want


def test_queue_spills_in_order():
    r = random.Random(2)
    q, plain = trie.SpillingQueue(held=10), []
    got = []
    for _ in range(2000):
        if plain and r.random() < 0.45:
            assert q.first() == plain[0]
            got.append(q.pop() == heapq.heappop(plain))
        else:
            x = (r.randint(0, 500), r.randint(0, 9))
            q.push(x)
            heapq.heappush(plain, x)
    while plain:
        got.append(q.pop() == heapq.heappop(plain))
    assert all(got) and q.first() is None


# spelling


def brute_near(words):
    near = defaultdict(set)
    for a in words:
        for b in words:
            if a < b and abs(len(a) - len(b)) <= 1:
                i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                if a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]:
                    near[a].add(b)
                    near[b].add(a)
    return near


def test_near_words_against_brute_force(spark):
    r = random.Random(4)
    words = {"".join(r.choice("abß") for _ in range(r.randint(1, 7))) for _ in range(500)}
    words |= {"a" * n for n in range(1, 60)} | {"x" * 3000, "x" * 3001, "x" * 2999 + "y", "y" + "x" * 2999}
    near = brute_near(words)
    got = Counter((x.word, x.near) for x in spelling.near_words(spark.createDataFrame([(w,) for w in sorted(words)], "word string")).collect())
    assert got == Counter((a, b) for a in near for b in near[a])


def test_variant_groups(spark):
    counts = [("kelpfarm", 2000), ("kelpfarn", 150), ("kelpfann", 3), ("kelpfar", 150), ("zzzzzzz", 4), ("kelpfatm", 199), ("kelpfatx", 20)]
    got = {x.word: tuple(x)[1:] for x in spelling.variant_groups(spark.createDataFrame(counts, "word string, n long")).collect()}
    assert got["kelpfann"] == ("kelpfarn", "kelpfarm", 3, 1, 150)
    assert got["kelpfarn"] == ("kelpfarm", "kelpfarm", 150, 3, 2000)
    assert got["kelpfatx"] == (None, "kelpfatx", 20, 1, None)  # 199 < 10 * 20
    assert got["zzzzzzz"] == (None, "zzzzzzz", 4, 0, None)
    assert spelling.variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0


def test_word_counts_of_odd_rows(spark):
    docs = [(1, "Kelpfarm kelpfarm KELPFÄRM short", 1), (1, "Kelpfarm kelpfarm KELPFÄRM short", 1), (None, "kelpfÄrm naïveté×x", 2), (2, None, 3), (3, "", 4), (4, "y" * 40_000 + " " + "y" * 40_000, 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n int")
    got = {x.word: x.n for x in spelling.word_counts(df).collect()}
    assert got == {"kelpfarm": 4, "kelpfÄrm": 3, "y" * 40_000: 2}
    noisy: Counter = Counter()
    for i, t, _ in docs:
        for w in (t or "").encode().lower().decode().replace("short", "").split():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            noisy[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 2 == 0 else w] += 1
    got = {x.word: x.n for x in spelling.word_counts(df, noise=2).collect()}
    assert got == {w: n for w, n in noisy.items() if n > 1 and len(w) > 6}


# backoff model


def brute_katz(docs, order):
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = [Counter() for _ in range(order + 1)]
    for _, text, train in docs:
        s = ["<s>"] * (order - 1) + tokens(text)
        for j in range(order - 1, len(s)) if train else ():
            for n in range(1, order + 1):
                counts[n][tuple(s[j - n + 1 : j + 1])] += 1
    d = [katz.discounts([Counter(c.values())[r] for r in range(1, katz.K + 2)]) for c in counts]
    after = [defaultdict(dict) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            after[n][g[:-1]][g[-1]] = c

    @cache
    def context(h):
        f = after[len(h) + 1][h]
        free = sum((1 - d[len(h) + 1][c]) * c for c in f.values() if c <= katz.K)
        total = sum(f.values())
        return f, total, free, 1 - sum(p(h[1:], v) for v in f) if h else 1.0

    @cache
    def p(h, w):
        n = len(h) + 1
        if h not in after[n]:
            return p(h[1:], w) if n > 1 else 1.0
        f, total, free, rest = context(h)
        if w in f:
            return d[n][min(f[w], katz.K + 1)] * f[w] / total if free else f[w] / (total + 1)
        left = free / total if free else 1 / (total + 1)
        return left if n == 1 else left / rest * p(h[1:], w)

    n_all, one = sum(counts[1].values()), counts[1]
    out = []
    for i, text, train in docs:
        w = tokens(text)
        s = ["<s>"] * (order - 1) + w
        score = sum(math.log10(p(tuple(s[j - order + 1 : j]), s[j])) for j in range(order - 1, len(s)))
        base = sum(math.log10((one[(x,)] + 0.5) / (n_all + 0.5 * (len(one) + 1))) for x in w)
        out.append((str(i), bool(train), len(w), sum(one[(x,)] > 0 for x in w), n_all, base, score))
    words = [g[0] for g in one] + ["unknown"]
    for h in [h for n in range(1, order + 1) for h in list(after[n])[: 40 if len(words) < 1000 else 0]]:
        assert abs(sum(p(h, w) for w in words) - 1) < 1e-9
    return sorted(out, key=str)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-6)


def made_texts():
    r = random.Random(3)
    docs = [(i, " ".join(f"w{min(59, int(r.expovariate(0.1)))}" for _ in range(r.randint(0, 60))), i % 5 != 1) for i in range(120)]
    return [*docs, (500, "w1 w2 zzz yyy w1 w2 w3", False), (501, None, True), (501, None, True), (None, "A b　c  C", None)]


def scored(df, **kw):
    return sorted(((str(x.doc_id), *tuple(x)[1:]) for x in katz.fit_score(df, **kw).scores.collect()), key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_against_brute_force(spark, order):
    docs = made_texts()
    close(scored(spark.createDataFrame(docs, "doc_id long, text string, train boolean").repartition(3), order=order), brute_katz(docs, order))


def test_katz_in_small_chunks_with_shared_contexts(spark, monkeypatch):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(katz)  # so that workers see the small sizes
    try:
        for name, v in (("CHUNK", 300), ("PART", 500), ("SPLIT", 40)):
            monkeypatch.setattr(katz, name, v)
        docs = made_texts()
        close(scored(spark.createDataFrame(docs, "doc_id long, text string, train boolean").repartition(3), order=3), brute_katz(docs, 3))
    finally:
        cloudpickle.unregister_pickle_by_value(katz)


def test_katz_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    docs = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 != 1) for r in rows]
    got = sorted(((str(r.doc_id), not r.held_out, *tuple(r)[2:]) for r in queries.op13_katz_scores(spark, sf).collect()), key=str)
    close(got, brute_katz(docs, 3))


def test_katz_of_odd_tables(spark):
    schema = "doc_id string, text string, train boolean, n_tokens int"
    assert katz.fit_score(spark.createDataFrame([], schema)).scores.count() == 0
    none = spark.createDataFrame([("x", "a b", False, 1), ("x", "a b", False, 1)], schema)
    assert scored(none) == [("x", False, 3, 0, 0, 0.0, 0.0)] * 2
    long = [("x", "a b " * 40_000, True, 1), ("y", "a b", False, 1)]
    got = scored(spark.createDataFrame(long, schema))
    close(got, brute_katz([r[:3] for r in long], 3))


def test_katz_tables_hold_the_counts(spark):
    docs = [(1, "a b a b", True), (2, "a b", True), (3, "q", False)]
    m = katz.fit_score(spark.createDataFrame(docs, "doc_id long, text string, train boolean"), order=2)
    assert sorted(r.n for r in katz.grams(m.tables[0]).collect()) == [2, 3, 3]
    assert sorted(r.n for r in katz.grams(m.tables[1]).collect()) == [1, 2, 2, 3]  # ba, b., .a, ab
    assert m.levels[1]["n"][:3] == [1, 2, 1]


def test_katz_beats_single_tokens_on_held_out_texts(spark, sf):
    rows = [r for r in queries.op13_katz_scores(spark, sf).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)
