"""Quality classification by compression.

One zstandard raw-content dictionary is made of good labelled text, one of bad.
The difference of a text's compressed sizes under the two, over the square
root of its length (as the noise of a sum of byte costs grows), is turned into
a probability by a logistic curve fitted to further labelled rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import zdict
from .shared import append_columns


def difference(sizer: zdict.Sizer, text: str | None) -> float:
    data = (text or "").encode()
    sizes = sizer.sizes(data)
    return (sizes[0] - sizes[1]) / math.sqrt(len(data) + 50)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of the likeliest logistic curve of weighted points, by Newton's method."""
    scale = float(x.std()) or 1.0
    design, beta = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def draw(labels: DataFrame, dict_rows: int, fit_rows: int) -> tuple[list[tuple[int, int, bool]], dict[int, int]]:
    """(doc_id, quality, for a dictionary?) of a bounded sample, and the classes' sizes.

    Of each class at most dict_rows for its dictionary (half of a small class)
    and at most fit_rows others for the curve, by the order of a hash of doc_id.
    A doc_id with contradicting labels is left out.
    """
    labels = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").select("doc_id", "quality")
    counts = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    out = []
    for quality, n in sorted(counts.items()):
        first = min(dict_rows, max(1, n // 2))
        for at, r in enumerate(labels.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(first + fit_rows).collect()):
            out.append((r["doc_id"], quality, at < first))
    return out, counts


def learn(docs: DataFrame, labels: DataFrame, dict_rows: int = 800, dict_bytes: int = 1 << 20, fit_rows: int = 5000, level: int = 6) -> dict | None:
    """The model, of docs(doc_id, text) and labels(doc_id, quality 0 or 1); None where a class is missing.

    A bounded sample of labelled rows is learnt from, by draw(): whole texts. A
    dictionary takes them as far as dict_bytes go; a text longer than what is
    left of these is passed over, not cut. The others' differences fit the
    curve, weighted so that both classes count as they do among all labels. Only
    the sample's ids, at most 2 * (dict_rows + fit_rows), are broadcast; of ids
    that many rows share, as many rows are used.
    """
    picked, counts = draw(labels, dict_rows, fit_rows)
    if len(counts) < 2:
        return None
    sample = docs.sparkSession.createDataFrame(picked, "doc_id long, quality int, use boolean")
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))
    parts = chosen.where(F.col("use") & (F.octet_length("text") < dict_bytes)).select("quality", "text", "h").distinct()
    dictionaries = {0: b"", 1: b""}
    for quality in dictionaries:
        for r in parts.where(F.col("quality") == quality).orderBy("h", "text").limit(dict_rows).collect():
            if len(have := dictionaries[quality]) + len(more := r["text"].encode()) < dict_bytes:
                dictionaries[quality] = have + b"\n" + more
    if not all(dictionaries.values()):
        return None
    model = {"dictionaries": dictionaries, "level": level, "slope": 1.0, "intercept": 0.0}
    fit = _differences(chosen.where("not use").orderBy("h", "text").limit(2 * fit_rows), model).select("quality", "difference").collect()
    x, y = (np.array([r[k] for r in fit], float) for k in ("difference", "quality"))
    if len(set(y.tolist())) == 2:
        weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))
        model["slope"], model["intercept"] = logistic(x, y, weight * len(y) / weight.sum())
    return model


def _differences(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    def make(chunks):
        sizer = zdict.sizer(model["dictionaries"], model["level"])
        for (texts,) in chunks:
            yield [[difference(sizer, t) for t in texts]]

    return append_columns(docs, [text], make, [("difference", T.DoubleType())], rows=256)


def score(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """docs with difference and score: how likely label 1 is, 0 to 1.

    A null text counts as empty; both get the curve's value like any other. With
    no model every score is 0.5. Rows are independent, columns of those names
    are replaced, and texts are compressed whole.
    """
    if model is None:
        return docs.drop("difference", "score").withColumns({"difference": F.lit(0.0), "score": F.lit(0.5)})
    raw = _differences(docs.drop("score"), model, text)
    return raw.withColumn("score", 1 / (1 + F.exp(-(F.col("difference") * model["slope"] + model["intercept"]))))
