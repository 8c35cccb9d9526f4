import re

from pyspark.sql import functions as F

from emberline.operators import names


def test_proper_names(spark):
    t = "Startup Boreal Kelp raised money. It met Tidal Loom's team and RailIQ. Probe of IBM Probe fame"
    got = spark.createDataFrame([(t,)], "t string").select(names.proper_names(F.col("t")).alias("n")).first().n
    assert [(r.key, r.words) for r in got] == [("borealkelp", 2), ("tidalloom", 2), ("railiq", 1)]


def test_candidates(spark):
    docs = spark.createDataFrame([
        (1, "a note", "We saw Tidal Looms launch a chip. Then Boreal AI came, and Boreal AI won."),
        (2, "a note", "The new Floating AI is floating ai. The LLM is here. Many use Nordwint for work."),
    ], "doc_id int, title string, text string")
    c = spark.createDataFrame([(1, "tidallooms"), (2, "boreal ai model"), (3, "floating ai"), (4, "LLM"), (5, "nordwind"), (6, "chip")], "id int, name string")
    links = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 1)], "id int, doc_id int")
    got = {r.id: r.is_proper for r in names.proper_candidates(c, links, docs).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False}


def test_each_two_words_are_compared_once(spark, monkeypatch):
    """Many candidates of one spelling over documents with one misspelt word make one comparison, not one each (F6)."""
    compared, alike = spark.sparkContext.accumulator(0), names.alike

    @F.udf("boolean")
    def counted(_):
        compared.add(1)
        return True

    monkeypatch.setattr(names, "alike", lambda a, b: counted(a) & alike(a, b))
    docs = spark.createDataFrame([(i, "a note", "Many use Nordwint for work.") for i in range(50)], "doc_id int, title string, text string")
    c = docs.select(F.col("doc_id").alias("id"), F.lit("nordwind").alias("name"))
    got = names.proper_candidates(c, c.select("id", F.col("id").alias("doc_id")), docs).collect()
    assert len(got) == 50 and all(r.is_proper for r in got)
    assert compared.value == 1


def test_lower_case_keys(spark):
    """Against a plain loop: words of other scripts, digits, keys over word ends, control characters, null and empty texts."""
    texts = ["the Tidal loom's élan vital", "Tidal loom", "x\x01tidal Loom", "Élan vital 3d print", "ab cd Ef gh ij", "ΣΑΣ tidal-loom", "", None]
    keys = ["tidalloom", "lanvital", "loomslanvital", "dprint", "3dprint", "abcd", "abcdefgh", "cdefghij", "abcdefghij", "loom", ""]
    want = set()
    for t in texts:
        w = re.findall(r"[^\W_]+", t or "")
        for i, first in enumerate(w):
            if first[0].islower():
                want |= {re.sub("[^a-z0-9]", "", "".join(w[i : i + n]).lower()) for n in range(1, names.MOST_WORDS + 1)}
    docs, wanted = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(k,) for k in keys], "key string")
    got = [r.key for r in names.lower_case_keys(docs, wanted).collect()]
    assert sorted(got) == sorted(want & set(keys))


def test_long_runs_and_long_names(spark):
    """Runs of thousands of capitalised words and names of thousands of letters, as in pages of one repeated word: each took
    frames of the stack, whose end took the whole process down (F3)."""
    t = "We saw " + "Boreal Kelp " * 9000 + "here. It met Tidal Loom's team. So " + "Hashwh " * 20000
    got = spark.createDataFrame([(t,)], "t string").select(names.proper_names(F.col("t")).alias("n")).first().n
    assert [(len(r.key), r.words) for r in got] == [(90_000, 18_000), (9, 2), (120_000, 20_000)]
    for n in (7, 299, 300, 301, 302, 501, 10_001, 40_000):
        key = "ab" * (n // 2) + "c" * (n % 2)
        apart = "-".join(key.upper())
        t = f"we use {key}, x{key} {key}x @{key} {apart} {' '.join(key)} {key}.org {key[:-1]}  {key[-1]} {key}_ {key}."
        rows = spark.createDataFrame([(t, key)], "t string, k string").select(names.spellings(F.col("t"), F.col("k")).alias("s")).first().s
        assert rows == [key, apart, " ".join(key), key]
    words = ["((Boreal''s)", "....a....b....", "(((", "a(((b", ""]
    made = spark.createDataFrame([("So " + " ".join(f"X{w}" for w in words) + " Tidal Loom",)], "t string").select(names.proper_names(F.col("t")).alias("n")).first().n
    assert [(r.key, r.words) for r in made][-1][0].endswith("tidalloom")
