import json

from pyspark.sql import functions as F

from emberline.sources import readers, stores
from emberline.streaming import jobs


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>A chip</title><link>https://r.example/x?url=https%3A%2F%2Fwww.site.example%2Fa</link><description>&lt;p&gt;Hello   there&lt;/p&gt;</description><pubDate>Mon, 02 Sep 2024 10:00:00 GMT</pubDate></item><item><title>no link</title></item></channel></rss>")
    r = readers.rss(spark, str(tmp_path / "a.xml"), "chips").collect()
    assert len(r) == 1 and r[0].url == "https://www.site.example/a" and r[0].abstract == "Hello there" and r[0].id.startswith("site.example:")
    (tmp_path / "b.xml").write_text("<feed><entry><id>http://a.example/1</id><title>T\n  x</title><summary>s</summary><published>2024-01-02T00:00:00Z</published><author><name>N</name></author><author><name>M</name></author></entry></feed>")
    e = readers.atom(spark, str(tmp_path / "b.xml"), "q").first()
    assert e.title == "T x" and e.authors == ["N", "M"] and str(e.published) == "2024-01-02"


def test_json_readers(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"id": "w1", "display_name": "T", "abstract_inverted_index": {"b": [1], "a": [0]}, "publication_date": "bad", "authorships": [{"author": {"display_name": "N"}, "institutions": [{"display_name": "O"}, {"display_name": "O"}]}]}))
    w = readers.works(spark, str(tmp_path / "w.json"), "q").first()
    assert (w.url, w.abstract, w.published, w.organizations) == ("w1", "a b", None, ["O"])
    (tmp_path / "g.json").write_text(json.dumps({"term": "t", "group_by": [{"key": "2020", "count": 3}, {"key": "unknown", "count": 1}]}))
    assert [tuple(r) for r in readers.group_counts(spark, str(tmp_path / "g.json")).collect()] == [("t", 2020, 3)]
    (tmp_path / "r.json").write_text('{"run_id": "1", "query": "q"}\n{broken\n')
    good, bad = readers.runs(spark, str(tmp_path / "r.json"))
    assert good.count() == 1 and bad.count() == 1


def test_upsert_and_fresh(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id long, v string, at int")
    b = spark.createDataFrame([(1, "z", 1), (3, "w", 0)], "id long, v string, at int")
    assert sorted(tuple(r) for r in stores.upserted(a, b, "id", "at").collect()) == [(1, "z", 1), (2, "y", 1), (3, "w", 0)]


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([("https://doi.org/10.1/a", "t", "2024-01-01 00:00:00"), ("http://dx.doi.org/10.1/A", "u", "2024-01-01 01:00:00"), ("https://b.example", "v", "2024-01-01 02:00:00")], "url string, title string, at string").select("url", "title", F.col("at").cast("timestamp").alias("fetched_at"))
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = jobs.first_documents(s).writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from firsts").first()[0] == 2
    keyed = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = keyed.writeStream.foreachBatch(jobs.upsert_into(str(tmp_path / "t"), "url", "fetched_at")).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "t" / "rows")).count() == 3


def test_sheets_labels_and_evidence(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,name,domain,stage,moving,sources\n1,Kelp,sea,"прототип → серийн",x,"[a](https://a.b/c)"\n,none,sea,poc,,\n2,Peat,land,исследован,,\n')
    terms = spark.createDataFrame([(1, "kelp farm")], "id int, term_en string")
    s = {r.id: r for r in readers.signals(spark, str(tmp_path / "s.csv"), terms).collect()}
    assert set(s) == {1, 2} and (s[1].stage, s[1].moving, s[1].source_urls, s[1].term_en) == ("prototype", True, ["https://a.b/c"], "kelp farm")
    assert readers.unmatched(readers.signals(spark, str(tmp_path / "s.csv"), terms)) == 1
    (tmp_path / "l.csv").write_text("name,label\nkelp,1\npeat,0\n")
    assert [tuple(r) for r in readers.labels(spark, str(tmp_path / "l.csv"), "name string, label int").collect()] == [("kelp", 1), ("peat", 0)]
    (tmp_path / "d.json").write_text('{"pattern": "a.b", "level": "high"}\n')
    assert readers.dimension(spark, str(tmp_path / "d.json"), "pattern string, level string").first().level == "high"
    rows = spark.createDataFrame([("r1", "kelp"), ("r2", "peat")], "run_id string, term string")
    readers.write_evidence(rows, str(tmp_path / "e"))
    assert [r.term for r in readers.read_evidence(spark, str(tmp_path / "e"), "r2").collect()] == ["peat"]


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_bucketed_upsert_leaves_other_buckets_files(spark, tmp_path):
    path, put = tmp_path / "b", jobs.upsert_into(str(tmp_path / "b"), "id", "at", buckets=8)
    rows = lambda d: spark.createDataFrame(d, "id long, v string, at int")
    put(rows([(i, "a", 1) for i in range(40)]), 0)
    before = files(path / "rows")
    put(rows([(3, "b", 2), (3, "old", 0), (99, "new", 1), (5, "tie", 1)]), 1)
    after = files(path / "rows")
    changed = {f.split("_bucket=")[1].split("/")[0] for f in before.keys() ^ after.keys()}
    assert 1 <= len(changed) <= 3 and {f.split("_bucket=")[1].split("/")[0] for f in before} - changed
    got = {r.id: r.v for r in spark.read.parquet(str(path / "rows")).collect()}
    assert len(got) == 41 and (got[3], got[5], got[99], got[7]) == ("b", "tie", "new", "a")
    kept = stores.read_buckets(spark, str(path / "rows"), [3, 99, 1000], "id", 8)
    assert sorted(r.v for r in kept.collect()) == ["b", "new"]
    put(rows([(3, "never", 9)]), 1)  # the batch is recorded
    assert files(path / "rows") == after
    # a batch that failed after its rows were written, before it was recorded, is put again and changes nothing
    (path / "batches" / "batch=1" / "_SUCCESS").unlink()
    put(rows([(3, "b", 2), (3, "old", 0), (99, "new", 1), (5, "tie", 1)]), 1)
    assert {r.id: r.v for r in spark.read.parquet(str(path / "rows")).collect()} == got


def test_upsert_stream_restarts_from_its_checkpoint(spark, tmp_path):
    def run():
        s = spark.readStream.schema("id long, v string, at int").parquet(str(tmp_path / "in"))
        q = s.writeStream.foreachBatch(jobs.upsert_into(str(tmp_path / "t"), "id", "at", 4)).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        return {r.id: r.v for r in spark.read.parquet(str(tmp_path / "t" / "rows")).collect()}

    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, at int").write.parquet(str(tmp_path / "in"))
    assert run() == {1: "a", 2: "b"}
    spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "id long, v string, at int").write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == {1: "a", 2: "c", 3: "d"}


def test_evidence_run_by_run(spark, tmp_path):
    put = jobs.evidence_into(str(tmp_path / "e"))
    rows = lambda d: spark.createDataFrame(d, "run_id string, term string, n int")
    put(rows([("r1", "kelp", 1), ("r1", "kelp", 1), ("r2", "peat", 2)]), 0)
    r2 = {f: t for f, t in files(tmp_path / "e" / "rows").items() if "run_id=r2" in f}
    put(rows([("r1", "kelp", 1), ("r1", "moss", None)]), 1)
    got = spark.read.parquet(str(tmp_path / "e" / "rows"))
    assert sorted((r.run_id, r.term) for r in got.collect()) == [("r1", "kelp"), ("r1", "moss"), ("r2", "peat")]
    assert r2 == {f: t for f, t in files(tmp_path / "e" / "rows").items() if "run_id=r2" in f}
    one = readers.read_evidence(spark, str(tmp_path / "e" / "rows"), "r2")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(run_id" in one._jdf.queryExecution().executedPlan().toString()
