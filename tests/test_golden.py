"""Worked values on a hand-made corpus."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from wordloom.functions import codec, distance, text
from wordloom.operators import evaluate, feedback, graph, index, match, rank, spell, topics
from wordloom.operators.index import Index


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(0, "alpha beta", "alpha gamma beta alpha"), (1, "gamma", "alpha beta gamma delta"), (2, "delta", "beta beta delta epsilon")]
    return Index.build(spark.createDataFrame(rows, "doc_id long, title string, body string"))


def scores(df, column="score", digits=6):
    return {r["doc_id"]: round(r[column], digits) for r in df.collect()}


def test_statistics(corpus):
    stats = {r["term"]: (r["cf"], r["df"]) for r in corpus.term_stats.collect()}
    assert stats == {"alpha": (4, 2), "beta": (5, 3), "gamma": (3, 2), "delta": (3, 2), "epsilon": (1, 1)}
    assert corpus.totals().first().asDict() == {"n_docs": 3, "total_views": 0, "total_tf": 16}
    post = index.position_deltas(index.postings(corpus.tokens)).where("term = 'alpha' AND doc_id = 0").first()
    assert (post["positions"], post["deltas"]) == ([0, 2, 5], [0, 2, 3])
    assert {r["term"]: r["term_id"] for r in index.dictionary(corpus.tokens).collect()} == {"alpha": 0, "beta": 1, "gamma": 2, "delta": 3, "epsilon": 4}
    assert corpus.lookup(["alpha", "nothing"]).orderBy("term").collect() == [("alpha", 4, 2), ("nothing", 0, 0)]


def test_matching(corpus):
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    assert ids(match.match_all(corpus.doc_tf, ["alpha", "gamma"])) == {0, 1}
    assert ids(match.match_all(corpus.doc_tf, ["alpha", "epsilon"])) == set()
    assert ids(match.match_any(corpus.doc_tf, ["alpha", "epsilon"])) == {0, 1, 2}
    assert match.next_doc(corpus.doc_tf, ["alpha"], 0).first()["doc_id"] == 1 and match.next_doc(corpus.doc_tf, ["alpha"], 1).first()["doc_id"] is None
    assert {r["doc_id"]: r["in_title"] for r in match.in_title(corpus.tokens, corpus.doc_stats, ["alpha", "beta"]).collect()} == {0: True, 1: False}
    assert scores(match.phrase_counts(corpus.tokens, ["alpha", "beta"]), "occurrences") == {0: 1, 1: 1}
    assert scores(match.phrase_counts(corpus.tokens, ["beta", "alpha"]), "occurrences") == {0: 2}


def test_phrase_without_overlap(spark):
    rows = index.token_rows(spark.createDataFrame([(0, "a a a"), (1, "a a a a"), (2, "a b a b a")], "doc_id long, text string"))
    assert scores(match.phrase_counts(rows, ["a", "a"]), "occurrences") == {0: 1, 1: 2}
    assert scores(match.phrase_counts(rows, ["a", "b", "a"]), "occurrences") == {2: 1}


@pytest.mark.parametrize(
    "terms, want",
    [(["alpha"], {0: 0.948683, 1: 0.408248}), (["alpha", "gamma"], {0: 0.894427, 1: 0.866025}), (["gamma", "beta"], {0: 0.316228, 1: 0.816497})],
)
def test_cosine(corpus, terms, want):
    assert scores(rank.cosine(corpus, terms)) == want


def test_other_rankers(corpus, spark):
    assert scores(rank.query_likelihood(corpus, ["alpha", "gamma"], "none")) == {0: 0.020833, 1: 0.02}
    assert scores(rank.query_likelihood(corpus, ["alpha", "gamma"])) == {0: 0.066406, 1: 0.066094}
    assert scores(rank.conjunctive(corpus, ["alpha", "gamma"])) == {0: 4, 1: 3}
    assert scores(rank.conjunctive(corpus, ["beta", "alpha", "gamma"], [["beta", "alpha"]])) == {0: 11}
    assert scores(rank.phrase(corpus, ["alpha", "beta"], [["beta", "alpha"]])) == {0: 7, 1: 1}
    ages = spark.createDataFrame([(13,), (6,), (-1,), (None,)], "b int").select(F.round(rank.age_divisor(F.col("b")), 6)).collect()
    assert [r[0] for r in ages] == [1.0, 1.232661, 1.432959, 1.432959]
    best = rank.top(corpus, rank.cosine(corpus, ["alpha"]), 1).collect()
    assert [r["doc_id"] for r in best] == [0]
    assert [r["doc_id"] for r in rank.top(corpus, rank.cosine(corpus, ["alpha", "gamma"]), 2, banded=True).collect()] == [0, 1]


def test_batch_equals_single(corpus, spark):
    asked = spark.createDataFrame([(1, "alpha"), (2, "alpha"), (2, "gamma"), (3, "zeta")], "query_id long, term string")
    got = {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in rank.batch_cosine(corpus, asked, 10).collect()}
    assert got == {(1, 0): 0.948683, (1, 1): 0.408248, (2, 0): 0.894427, (2, 1): 0.866025}


def test_feedback(corpus, spark):
    top = spark.createDataFrame([(0,), (1,)], "doc_id long")
    assert [tuple(r) for r in feedback.expand(corpus.doc_tf, top, ["alpha"], 2).orderBy("term").collect()] == [("beta", 3, 0.5), ("gamma", 3, 0.5)]
    weights = spark.createDataFrame([("x", "a", 0.5), ("x", "b", 0.5), ("y", "b", 0.25), ("y", "c", 0.75), ("z", "d", 1.0)], "query string, term string, prf double")
    got = {(r["q1"], r["q2"]): round(r["coefficient"], 6) for r in feedback.bhattacharyya(weights).collect()}
    assert got[("x", "y")] == got[("y", "x")] == 0.353553 and got[("x", "z")] == 0 and len(got) == 6


def test_page_rank(spark):
    vertices = spark.createDataFrame([(i,) for i in range(4)], "id long")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 0), (3, 2)], "src long, dst long")
    values = lambda df: [round(r["page_rank"], 6) for r in df.orderBy("id").collect()]
    assert values(graph.page_rank(vertices, edges, iterations=1)) == [0.925, 0.475, 2.275, 0.025]
    assert values(graph.page_rank(vertices, edges)) == [2.0725, 0.44125, 0.89125, 0.025]
    assert values(graph.page_rank(vertices, edges, iterations=12, cut_every=5)) == values(graph.page_rank(vertices, edges, iterations=12, cut_every=100))
    assert values(graph.page_rank_sequential(vertices, edges, iterations=1)) == [0.925, 0.44125, 1.738375, 0.025]
    assert values(graph.page_rank_sequential(vertices, edges)) == [1.589538, 0.740292, 1.429055, 0.025]


def test_spearman(spark):
    a = spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.9), (3, 0.3)], "id long, value double")
    b = spark.createDataFrame([(0, 10.0), (1, 2.0), (2, 7.0), (3, 0.0)], "id long, value double")
    assert round(graph.spearman(a, b).first()["rho"], 6) == 0.6 and round(graph.spearman(a, a).first()["rho"], 6) == 1


def test_links(spark):
    page = '<html><head><title>t</title>{}</head><body><a class="x" href="/b">b</a><A href="c">c</A><a href="http://x">x</a><a href="../d">d</a><a href="a">a</a></body></html>'
    pages = spark.createDataFrame([("a", page.format("")), ("b", page.format('<meta http-equiv="refresh" content="0; url=c">')), ("c", "<p>none</p>"), ("e", page.format('<meta http-equiv="refresh" content="0; url=e">'))], "name string, html string")
    assert {tuple(r) for r in graph.link_graph(pages).collect()} == {("a", "c")}
    hops = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "4"), ("4", None), ("5", "6"), ("6", "5"), ("7", "9")], "name string, redirect_to string")
    assert {tuple(r) for r in graph.resolve_redirects(hops).collect()} == {(x, "4") for x in "1234"}


def test_views(spark):
    docs = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "doc_id long, name string")
    log = spark.createDataFrame([("x", 5, 0), ("x", 3, 1), ("y", 2, 2)], "article string, views long, line long")
    assert scores(graph.num_views(docs, log), "num_views") == {0: 3, 1: 2, 2: 0}
    assert scores(graph.num_views(docs, log, "sum"), "num_views") == {0: 8, 1: 2, 2: 0}


@pytest.mark.parametrize("number, code", [(0, "80"), (1, "81"), (127, "ff"), (128, "0081"), (300, "2c82"), (16383, "7fff"), (16384, "000081"), (2097151, "7f7fff"), (2097152, "00000081"), (268435456, "0000000081")])
def test_codes(spark, number, code):
    assert codec.encode([number]).hex() == code and codec.decode(bytes.fromhex(code)) == [number]
    assert spark.range(1).select(codec.size_of(F.lit(number))).first()[0] == len(code) // 2


def test_text(spark):
    one = lambda *cols: spark.range(1).select(*cols).first()
    assert one(text.ngrams(F.lit("word"), 1, 2), text.ngrams(F.lit("cat"))) == (["w", "o", "r", "d", "wo", "or", "rd"], None)
    assert one(text.ngrams(F.lit("word")))[0][-3:] == ["wor", "ord", "word"]
    words = "caresses ponies caress cats feed agreed plastered motoring sing conflated troubled sized hopping falling filing happy sky was".split()
    want = "caress poni caress cat feed agree plaster motor sing conflate trouble size hop fall file happi sky wa".split()
    assert one(F.transform(F.array(*map(F.lit, words)), lambda w: text.stem(w)))[0] == want
    assert one(text.stem(F.lit("Häusern"), "de"), text.stem(F.lit("canciones"), "es"))[1] == "cancion"
    assert one(text.tokens(F.lit("See http://a.b/c?d don't 3.14, U.S. 漢字 x_y"), rich=True))[0] == ["see", "don't", "3.14", "u.s", "漢", "字", "x_y"]
    assert one(text.duration(F.lit(3_723_004)))[0] == "01:02:03:004"
    assert one(text.token_type(F.lit("漢")), text.token_type(F.lit("3.5")), text.token_type(F.lit("word"))) == ("IDEOGRAPHIC", "NUMERIC", "WORD")
    assert one(text.server_url(F.lit("Page")), text.server_url(F.lit("https://x"))) == ("data/wiki/Page", "https://x")
    assert one(text.lowercase(F.lit("")), text.lowercase(F.lit("AbC")))[:] == (None, "abc")


@pytest.mark.parametrize("a, b, free, restricted", [("acess", "access", 1, 1), ("recieve", "receive", 1, 1), ("ca", "abc", 2, 3), ("", "ab", 2, 2), ("same", "same", 0, 0)])
def test_distances(a, b, free, restricted):
    assert (distance.damerau_levenshtein(a, b), distance.optimal_alignment(a, b)) == (free, restricted)


def test_spelling(spark):
    words = spark.createDataFrame([("access", 9), ("excess", 5), ("receive", 3), ("abc", 1)], "term string, cf long")
    asked = spark.createDataFrame([("acess",), ("recieve",), ("ca",), ("zzzzzz",), ("abc",)], "wrong string")
    near = spell.within(asked, words)
    assert {(r["wrong"], r["term"], r["distance"]) for r in near.collect()} == {("acess", "access", 1), ("acess", "excess", 2), ("recieve", "receive", 1), ("ca", "abc", 2), ("abc", "abc", 0)}
    known = spark.createDataFrame([("recieve", "receive")], "wrong string, right string")
    scored = {r["wrong"]: round(r["score"], 6) for r in spell.scored(spell.nearest_tier(near), words, known).collect()}
    assert scored == {"acess": 1.0, "recieve": 1.25, "ca": 0.0, "abc": 0.0}
    best = spell.suggestions(spell.scored(spell.nearest_tier(near), words), 1)
    tokens = spark.createDataFrame([(1, 0, "acess"), (1, 1, "abc"), (2, 0, "zzzzzz"), (2, 1, "abc"), (3, 0, "abc")], "query_id long, pos int, token string")
    got = {r["query_id"]: (r["corrected"], r["is_correct"]) for r in spell.corrected_query(tokens, best, words).collect()}
    assert got == {1: ("access abc", False), 2: ("abc", False), 3: ("abc", True)}
    grams = spell.gram_suggestions(asked, spell.gram_index(words), words, threshold=2).where("rank = 1").collect()
    assert {(r["wrong"], r["term"]) for r in grams} >= {("acess", "access"), ("recieve", "receive")}


def test_metrics(spark):
    gains = {10: "Perfect", 7: "Excellent", 5: "Good", 1: "Fair", 0: "Bad"}
    ranked_gains = [10, 0, 5, 1, 0, 7, 0, 0, 0, 0]
    ranked = spark.createDataFrame([("q", i, i + 1) for i in range(10)], "query string, doc_id long, rank long")
    qrels = spark.createDataFrame([("q", i, gains[g]) for i, g in enumerate(ranked_gains) if g] + [("q", 99, "Good")], "query string, doc_id long, grade string")
    rows = {r["k"]: (r["precision"], r["recall"], round(r["f"], 6)) for r in evaluate.precision_recall_f(ranked, qrels).collect()}
    assert rows == {1: (1.0, 0.25, 0.4), 5: (0.4, 0.5, 0.444444), 10: (0.3, 0.75, 0.428571)}
    assert {r["k"]: round(r["ndcg"], 6) for r in evaluate.ndcg(ranked, qrels).collect()} == {1: 1.0, 5: 0.664586, 10: 0.792739}
    assert {r["k"]: round(r["ndcg"], 6) for r in evaluate.ndcg(ranked, qrels, cumulative=True).collect()} == {1: 1.0, 5: 0.778453, 10: 0.784136}
    ap = evaluate.average_precision(ranked, qrels).first()
    assert (round(ap["ap"], 6), ap["rr"]) == (0.722222, 1.0)
    points = [round(r["precision"], 6) for r in evaluate.interpolated(ranked, qrels).orderBy("recall_level").collect()]
    assert points == [1, 1, 1, 0.666667, 0.666667, 0.666667, 0.5, 0.5, 0, 0, 0]
    report = evaluate.report(ranked, qrels).first()
    assert len(report) == 1 + 3 * 4 + 11 + 2 and report["precision_5"] == 0.4


def test_trend(spark):
    slots = [0, 1, 0, 2, 1, 0, 0, 3, 1, 0, 1, 2, 9, 4]
    rows = [(1, d) for d, n in enumerate(slots) for _ in range(n)] + [(2, 0)] * 4 + [(3, 0)] * 44
    got = {r["topic_id"]: r for r in topics.trend(spark.createDataFrame(rows, "topic_id long, bucket long")).collect()}
    assert (got[1]["n"], got[1]["peak"], got[1]["age"]) == (24, 9, 2)
    mean, sd = 24 / 14, math.sqrt(sum((x - 24 / 14) ** 2 for x in slots) / 14)
    assert round(got[1]["z"], 6) == round((9 - mean) / sd / math.log2(2.05), 6) and round(got[1]["score"] / got[1]["z"], 6) == 0.5


def test_dates_and_topics(spark):
    texts = ["2014-12-01", "Mon, 01 Dec 2014", "01 Dec 2014 10:20:30 GMT", "Mon, 01 Dec 2014 10:20:30 +0100", "nothing", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, d string").select("i", topics.parse_date(F.col("d")).alias("ts"))
    assert [str(r["ts"]) for r in rows.orderBy("i").collect()] == ["2014-12-01 00:00:00", "2014-12-01 00:00:00", "2014-12-01 10:20:30", "2014-12-01 09:20:30", "None", "None"]
    filled = topics.fill_forward(rows, "ts", "i").orderBy("i").collect()
    assert str(filled[5]["ts"]) == "2014-12-01 09:20:30"
    day = lambda s: spark.range(1).select(topics.day_bucket(F.lit(s).cast("timestamp"), date(2014, 11, 30))).first()[0]
    assert [day("2014-11-01"), day("2014-12-01 05:00:00"), day("2015-01-01")] == [0, 1, 13]
    keys = spark.createDataFrame([(1, "cats cat dogs eric")], "topic_id int, terms string")
    assert [r["term"] for r in topics.topic_terms(keys).orderBy("rank").collect()] == ["cat", "dog", "eric"]
    late = topics.with_default_date(spark.createDataFrame([("Xinhua", "2020-01-01"), ("x", None), ("x", "2020-01-01")], "source string, ts string"), F.lit("now")).collect()
    assert [r["ts"] for r in late] == ["now", "now", "2020-01-01"]
