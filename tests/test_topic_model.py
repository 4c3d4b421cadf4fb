"""The topic model: two plain topics, no cap on the vocabulary, and the query's parameters."""

from pyspark.sql import functions as F

from wordloom.operators import topics
from wordloom.plans.registry import QUERIES


def test_two_topics(spark):
    docs = spark.createDataFrame([(i, ("alpha beta gamma delta " if i % 2 else "omega sigma kappa lambda ") * 5) for i in range(40)], "doc_id long, text string")
    shares, terms = topics.topic_model(docs, topics=2, words=4)
    names = {}
    for r in terms.collect():
        names.setdefault(r.topic_id, set()).add(r.term)
    assert sorted(map(sorted, names.values())) == [["alpha", "beta", "delta", "gamma"], ["kappa", "lambda", "omega", "sigma"]]
    main = {r.doc_id: r.topic_id for r in shares.where("proportion > 0.5").collect()}
    assert all("alpha" in names[main[i]] if i % 2 else "omega" in names[main[i]] for i in range(40))


def test_all_terms_count(spark):
    word = lambda i: "q" + "".join("abcdefghij"[int(c)] for c in f"{i:05d}")
    text = " ".join(map(word, range(21000)))
    _, terms = topics.topic_model(spark.createDataFrame([(1, text), (2, text), (3, "once")], "doc_id long, text string"), topics=2, words=21000, rounds=1)
    assert terms.select("term").distinct().count() == 21000


def test_query(spark, sf_dir):
    got = QUERIES["lda_topics"](spark, sf_dir).cache()
    assert got.groupBy("doc_id").count().agg(F.min("count"), F.max("count")).first() == (5, 5)
    assert got.agg(F.max("topic_id")).first()[0] >= 20
