"""Language identification and quality by compression: held-out accuracy, and edges."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F

from wordloom.llm import language_id, quality_classifier, queries, zdict


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label.sum()
    return (rank[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(label) - pos))




def size(data, dictionary, level, **more):
    """zstandard alone: the frame's length with this raw-content dictionary."""
    params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(dictionary), write_content_size=0, write_checksum=0, write_dict_id=0, **more)
    return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(data))


def test_languages_by_hand(spark):
    """Every prediction and score from plain zstandard and Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dicts = language_id.learn(docs.where(~zdict.held_out(F.col("doc_id"))))
    learnt = {r.doc_id: r for r in docs.collect()}
    assert set(dicts) == {r.lang for r in learnt.values() if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    for r in language_id.identify(docs, dicts).collect():
        data = re.sub(r"[\W\d_]+", " ", r.text.lower()).strip().encode()
        ranked = sorted((size(data, d, 6, min_match=3), lang) for lang, d in dicts.items())
        least = ranked[0][0]
        assert r.lang_best == ranked[0][1] and r.rejected == (ranked[1][0] - least < 0.01 * ranked[1][0])
        assert abs(r.score - 1 / sum(math.exp((least - n) / (4 + 0.02 * least)) for n, _ in ranked)) < 1e-12


def test_language_sample(spark):
    """Whole texts up to the dictionary's size; equal rows once; null ids like others."""
    rows = [(None, f"satz {w} noch mehr", "de") for w in "abcdefgh"] + [(7, "same words again", "en")] * 500 + [(8, "x" * 3000, "en"), (9, "more text", "en")]
    got = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dict_bytes=1000, rows=1000)
    assert len(got["de"].split()) == 8 * 4 and got["en"].count(b"same words again") == 1 and b"more text" in got["en"] and b"xxx" not in got["en"]


def test_language_ties(spark):
    df = spark.createDataFrame([(1, "zz"), (2, "qq")], "doc_id long, text string")
    same = b"alpha beta gamma " * 20
    assert [r.lang_best for r in language_id.identify(df, {"nl": same, "da": same}).collect()] == ["da", "da"]


def test_languages(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op9_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang is not None]
    assert len(got) == 1000 and len(held) > 150
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    dicts = {"en": b"the and of that with " * 50, "de": "der und die von ß ".encode() * 50}
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !!", 1), (4, "the and of that", 1), (4, "the and of that", 1), (None, "der und die von " * 20000, None)], "doc_id long, text string, score int")
    out = language_id.identify(df, dicts).collect()
    assert [r.lang_best for r in out] == ["und", "und", "und", "en", "en", "de"]
    assert [r.lang_best for r in language_id.identify(df, {}).collect()] == ["und"] * 6
    assert language_id.identify(df.limit(0), dicts).count() == 0
    assert language_id.learn(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_quality_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    scored = queries.op4_quality_classifier(spark, sf_dir)
    got = scored.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert scored.count() == 1000
    assert auc(np.array([r.score for r in got]), np.array([r.quality for r in got])) > 0.9
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_quality_by_hand(spark):
    """Every score from plain zstandard and Python, very long and clashing rows too."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, "lang und breit " * 40000), (-2, None), (-3, "")], "doc_id long, text string")).withColumn("score", F.lit("x"))
    held = zdict.held_out(F.col("doc_id"))
    model = quality_classifier.learn(docs.where(~held), spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where(~held))
    assert model["slope"] > 0
    for r in quality_classifier.score(docs, model).collect():
        data = (r.text or "").encode()
        diff = (size(data, model["dictionaries"][0], 6) - size(data, model["dictionaries"][1], 6)) / math.sqrt(len(data) + 50)
        assert abs(r.difference - diff) < 1e-12 and abs(r.score - 1 / (1 + math.exp(-(diff * model["slope"] + model["intercept"])))) < 1e-9


def test_rare_class_is_bounded(spark):
    labels = spark.range(200_000).selectExpr("id AS doc_id", "CAST(id % 1000 = 0 AS INT) AS quality")
    picked, counts = quality_classifier.draw(labels, 300, 700)
    seen = Counter((q, use) for _, q, use in picked)
    assert counts == {0: 199_800, 1: 200} and seen == {(0, True): 300, (0, False): 700, (1, True): 100, (1, False): 100}


def test_quality_edges(spark):
    df = spark.createDataFrame([(i, f"good words number {i} of many" if i % 2 else "junk!! " * (i % 9 + 1), 5) for i in range(60)] + [(None, None, 5), (None, "", 5)], "doc_id long, text string, difference int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality_classifier.learn(df, labels)
    out = {r.doc_id: r.score for r in quality_classifier.score(df, model).collect()}
    assert len(out) == 61 and out[11] > 0.5 > out[12]
    assert quality_classifier.learn(df, labels.where("quality = 1")) is None
    assert {r.score for r in quality_classifier.score(df, None).collect()} == {0.5}
    assert quality_classifier.score(df.limit(0), model).count() == 0


def test_held_out_is_crc32(spark):
    rows = spark.range(200).select("id", zdict.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
