"""The distributed topic model against one round of the method in plain numpy, and what its driver holds."""

import numpy as np
from pyspark.sql import functions as F

from wordloom.operators import index, lda, topics
from wordloom.operators.graph import written

TEXTS = ["red green red", "green blue blue blue", "sun moon", "moon moon star sun", "", "red star"]


def test_round(spark, monkeypatch):
    monkeypatch.setattr(lda, "FRACTION", 1.0)
    monkeypatch.setattr(lda, "GROUP_PAIRS", 4)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    corpus = written(index.doc_counts(docs), "corpus")
    k, seed = 3, 5
    model = lda.Model(corpus, index.flat(corpus).select("term").distinct(), k, seed)
    rows = lambda: {r["term"]: np.frombuffer(r["vec"], np.float32).astype(float) for r in model.matrix.collect()}
    before, alpha, eta = rows(), model.alpha, 1 / k
    model.round(1)
    sums, stats, logphat, n = sum(before.values()), {t: np.zeros(k) for t in before}, np.zeros(k), 0
    for doc, text in enumerate(TEXTS):
        terms = sorted(set(text.split()))
        if not terms:
            continue
        beta = np.array([np.exp(lda.digamma(before[t]) - lda.digamma(sums)) for t in terms])
        counts, gamma, change = np.array([text.split().count(t) for t in terms]), lda._draw(str(doc), seed + 1, k), 1.0
        expectation = lambda g: np.exp(lda.digamma(g) - lda.digamma(g.sum()))
        while change > 1e-3:
            phi = beta * expectation(gamma)
            new = alpha + (phi / phi.sum(1, keepdims=True) * counts[:, None]).sum(0)
            change, gamma = np.abs(new - gamma).mean(), new
        phi = beta * expectation(gamma)
        for t, row in zip(terms, phi / phi.sum(1, keepdims=True) * counts[:, None]):
            stats[t] += row
        logphat, n = logphat + np.log(expectation(gamma)), n + 1
    rho = 1025**-0.51
    after = rows()
    assert set(after) == set(before)
    for t in before:
        assert np.allclose(after[t], (1 - rho) * before[t] + rho * (eta + stats[t]), rtol=1e-4)
    assert np.allclose(model.sums, sum(after.values()), rtol=1e-4)
    assert np.allclose(model.alpha, lda._update_alpha(alpha, logphat / n, n, rho))


def test_driver_holds_no_matrix(spark, monkeypatch):
    """Spark's LDA, whose matrix is the driver's, is not used; a text without a known term has shares of 0."""
    from pyspark.ml.clustering import LDA

    monkeypatch.setattr(LDA, "fit", lambda *a: 1 / 0)
    docs = spark.createDataFrame([(1, "red green"), (2, "red green"), (3, "once"), (4, None)], "doc_id long, text string")
    shares, _ = topics.topic_model(docs, topics=3, words=2, most=2, rounds=1)
    got = {r["doc_id"]: r["s"] for r in shares.groupBy("doc_id").agg(F.sum("proportion").alias("s")).collect()}
    assert set(got) == {1, 2, 3, 4} and got[3] == got[4] == 0 and got[1] > 0.6
