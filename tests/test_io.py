"""Readers, sinks, saved indexes, requests and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from wordloom.operators.index import Index
from wordloom.plans import request
from wordloom.sources import readers, sinks
from wordloom.streaming import feeds


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, f"title {w} page", f"the {w} of {w} lies near the river {x}") for i, (w, x) in enumerate([("forest", "bank"), ("forest", "mouth"), ("meadow", "bank"), ("desert", "sand")])]
    return Index.build(spark.createDataFrame(rows, "doc_id long, title string, body string"))


def test_index_round_trip(spark, small, tmp_path):
    small.save(str(tmp_path / "ix"), parts=2)
    back = Index.load(spark, str(tmp_path / "ix"))
    for name in ("tokens", "doc_tf", "term_stats", "doc_stats"):
        a, b = getattr(small, name), getattr(back, name)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))
    plan = back.doc_tf.where("term = 'forest'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,forest)]" in plan


def test_search(small):
    ask = lambda q: request.search(small, request.SearchRequest.parse(q))
    lines = [r[0].split("\t")[0] for r in ask("query=forest+bank&ranker=cosine").collect()]
    assert lines == ["0"]
    got = json.loads(ask("query=foresst&ranker=cosine&format=json&checker=bk").first()[0])
    assert [r["doc_id"] for r in got["results"]] == [0, 1] and got["correctedQuery"] == {"isCorrect": False, "query": "forest"}
    got = json.loads(ask("query=foresst&ranker=ql&format=json&checker=ngram").first()[0])
    assert len(got["results"]) == 2
    got = json.loads(ask('query="forest+of+forest"&ranker=conjunctive&format=json').first()[0])
    assert [r["doc_id"] for r in got["results"]] == [0, 1]
    assert "<li>" in ask("query=meadow&ranker=comprehensive&format=html").first()[0]
    for bad in ("query=&ranker=cosine", "query=forest", "query=the&ranker=cosine", "query=forest&ranker=news"):
        with pytest.raises(ValueError):
            ask(bad)


def test_news_and_expansion(spark, small):
    buckets = spark.createDataFrame([(0, 0), (1, 13)], "doc_id long, bucket long")
    got = request.search_news(small, request.SearchRequest.parse("query=forest&ranker=news"), buckets).collect()
    assert [r[0].split("\t")[0] for r in got] == ["1", "0"]
    with pytest.raises(ValueError):
        request.search_news(small, request.SearchRequest.parse("query=forest&ranker=cosine"), buckets)
    terms = [r["term"] for r in request.expand(small, request.SearchRequest.parse("query=forest&numterms=3")).collect()]
    assert len(terms) == 3 and "forest" not in terms
    assert request.expand(small, request.SearchRequest.parse("query=river+forrest")).first()["term"] == "river forest"


def test_readers(spark, tmp_path):
    write = lambda name, s: (tmp_path / name).write_text(s) and str(tmp_path / name)
    lines = readers.numbered(spark, write("sources", "# One\nhttp://a\n\n// no\nhttp://b\n# Two\nhttp://c\n"))
    assert [(r["url"], r["publisher"]) for r in readers.rss_sources(lines).orderBy("line").collect()] == [("http://a", "One"), ("http://b", "One"), ("http://c", "Two")]
    lines = readers.numbered(spark, write("missp", "$access\nacess\naccess1\n$receive\nrecieve\n"))
    assert {tuple(r) for r in readers.misspellings(lines).collect()} == {("acess", "access"), ("access1", "access"), ("recieve", "receive")}
    log = spark.read.text(write("log", "en Page 12\nen Page x\nen too many 3\n"))
    assert [(r["article"], r["views"]) for r in readers.view_log(log).collect()] == [("Page", 12)]
    assert {tuple(r) for r in readers.spelling_tests(spark, write("tests", "{'access': 'acess',\n 'two': 'tow  twoo'}")).collect()} == {("acess", "access"), ("tow", "two"), ("twoo", "two")}
    assert [r["term"] for r in readers.words(spark, write("words", "Good\nno1\n\nword\n")).collect()] == ["Good", "word"]
    assert readers.judgements(spark, write("qrels", "q\t5\tGood\n")).first() == ("q", 5, "Good")
    assert readers.doc_topics(spark, write("dt", "#doc\n0\td1\t3\t0.5\n")).first() == ("d1", 3, 0.5)
    assert readers.topic_keys(spark, write("tk", "0\t0.25\ta b c\n")).first() == (0, "a b c")
    xml = "<rss><channel><title>c</title><item><title>T</title><description>&lt;b&gt;x&lt;/b&gt; y</description><link>l</link></item></channel></rss>"
    item = readers.rss_items(spark, write("feed.xml", xml)).first()
    assert (item["title"], item["description"], item["link"]) == ("T", "x y", "l")
    feed = json.dumps({"publisher": "P", "entries": [{"title": "a", "link": "l1"}, {"title": "b", "publisher": "Q"}]})
    assert [(r["title"], r["publisher"]) for r in readers.feed_messages(spark, write("feed.json", feed)).collect()] == [("a", "P"), ("b", "Q")]
    news = readers.news(spark, write("news.json", json.dumps({"source": "s", "title": "t", "content": "c"}))).first()
    assert (news["title"], news["body"]) == ("t", "c")
    (tmp_path / "pages").mkdir()
    for name in ("b", "a", ".hidden"):
        (tmp_path / "pages" / name).write_text(f"<p>{name}</p>")
    assert [(r["doc_id"], r["name"]) for r in readers.directory(spark, str(tmp_path / "pages")).orderBy("doc_id").collect()] == [(0, "a"), (1, "b")]
    assert readers.settings("# c\na: 1\nb : two: 3\n", ("a",)) == {"a": "1", "b": "two: 3"}
    with pytest.raises(ValueError):
        readers.settings("a: 1", ("b",))
    assert readers.line_count(spark, str(tmp_path / "words")) == 4
    html = "<title>t</title><nav><a>x y z u v w</a></nav><p>one two three four five</p><p><a>links only are left out here</a></p>"
    assert readers.main_text_of(html) == "one two three four five"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", "c")], "doc_id long, title string, description string")
    assert sinks.model_lines(df).first()[0] == "1 X a b c"
    sinks.text_lines(sinks.model_lines(df), str(tmp_path / "t"))
    sinks.text_lines(sinks.model_lines(df), str(tmp_path / "t"), append=True)
    assert spark.read.text(str(tmp_path / "t")).count() == 2
    sinks.json_lines(df, str(tmp_path / "j"))
    sinks.delimited(df.select("doc_id", "description"), str(tmp_path / "d"))
    sinks.tables({"x": df}, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.csv(str(tmp_path / "d"), sep="\t").count() == spark.read.parquet(str(tmp_path / "p/x")).count() == 1


def test_streams(spark, tmp_path):
    schema = "link string, ts timestamp, source string"
    rows = [("a", "2024-01-01 01:00:00", "s"), ("b", "2024-01-01 02:00:00", "s"), ("a", "2024-01-01 03:00:00", "s")]
    make = lambda rows: spark.createDataFrame(rows, "link string, ts string, source string").withColumn("ts", F.col("ts").cast("timestamp"))
    make(rows).coalesce(1).write.json(str(tmp_path / "in"))
    seen = []
    stream = lambda: feeds.files(spark, str(tmp_path / "in"), schema, "json")
    take = lambda batch, _: seen.extend(r["link"] for r in batch.collect())
    feeds.ingest(feeds.new_items(stream(), ["link"]), take, str(tmp_path / "c1"), period=None).awaitTermination()
    make([("b", "2024-01-02 01:00:00", "s"), ("c", "2024-01-02 02:00:00", "s")]).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    feeds.ingest(feeds.new_items(stream(), ["link"]), take, str(tmp_path / "c1"), period=None).awaitTermination()
    assert sorted(seen) == ["a", "b", "c"]
    feeds.to_table(feeds.daily_counts(stream(), "source"), str(tmp_path / "out"), str(tmp_path / "c2"), mode="complete").awaitTermination()
    batch = spark.read.schema(schema).json(str(tmp_path / "in")).groupBy(F.date_trunc("day", "ts").alias("day"), "source").agg(F.count("*").alias("n"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))
