"""Nearest neighbours: recall against brute force, exact scores, ties, edges and hot lists."""

import numpy as np
from pyspark.sql import functions as F

from wordloom.llm import ann, queries


def brute(rows, every, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            d[ids == i] = np.inf
            best = [j for j in np.lexsort((ids, d)) if np.isfinite(d[j])][:k]
            out[int(i)] = [(int(ids[j]), d[j]) for j in best]
    return out


def gathered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def share_scanned(df, every, k=10):
    """Of all pairs of a query and a row, those that a scan of the lists compares; and the copies of a row, and how many have all of theirs."""
    n = df.count()
    index = ann.fit(ann.thinned(ann.valid(df), k), n, every, k, 0.94, int(np.ceil(4 * np.sqrt(n))), 3, 128)
    queries = df.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    rows = ann.posted(ann.valid(df), index).select("list", "vec_id").cache()
    met = ann.routed(queries, index).select("list", "query_id").join(rows, "list").select("query_id", "vec_id").distinct().count()
    copies = [r["count"] for r in rows.groupBy("vec_id").count().collect()]
    sizes = [r["count"] for r in rows.groupBy("list").count().collect()]
    return met / (n * queries.count()), np.mean(copies), np.mean(np.array(copies) == 3), max(sizes) / np.mean(sizes)


def test_recall(spark):
    """Queries are never among the audited vectors, so this recall is out of sample. Random vectors on a sphere can't be pruned far."""
    sf_dir = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 100, 10)
    got = gathered(queries.op8_ann(spark, sf_dir))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, found in got.items():
        exact = dict(want[q])
        assert all(abs(exact[i] - d) < 1e-12 for i, d in found if i in exact) and found == sorted(found, key=lambda x: (x[1], x[0]))
    share, copies, capped, longest = share_scanned(df, 100)
    print("random", share, copies, capped, longest)
    assert share < 0.7 and copies < 2.5 and capped < 0.4 and longest < 8


def test_clusters(spark):
    """Vectors in clusters: high recall out of sample from under a tenth of the rows."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16)) * 4
    x = (centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).cache()
    assert recall(gathered(ann.search(df, every=50)), brute(rows, 50, 10)) >= 0.9
    share, copies, capped, longest = share_scanned(df, 50)
    print("clusters", share, copies, capped, longest)
    assert share < 0.1 and copies < 2.5 and capped < 0.4


def test_ties_and_hot_list(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(400)] + [(i, rng.normal(size=3).tolist()) for i in range(400, 900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(i, np.float32(v)) for i, v in rows]
    got, want = gathered(ann.search(df, every=50, block=64)), brute(rows, 50, 10)
    assert [i for i, _ in got[50]] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9] and [i for i, _ in got[0]] == list(range(1, 11))
    assert recall(got, want) >= 0.9


def test_hot_vector(spark):
    """A third of all rows hold one vector: only the ids that can win are scanned, and they do win."""
    rng = np.random.default_rng(4)
    rows = [(3 * i, [0.5, 0.5, 0.5]) for i in range(1000)] + [(3 * i + 1, rng.normal(size=3).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows + rows[:700], "vec_id long, embedding array<float>")
    assert ann.thinned(ann.valid(df), 10).count() == 11 + 2000
    got, want = gathered(ann.search(df, every=30)), brute([(i, np.float32(v)) for i, v in rows], 30, 10)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    assert [i for i, _ in got[0]] == list(range(3, 33, 3)) and [i for i, _ in got[90]] == list(range(0, 30, 3))


def test_vectors_of_one_id(spark):
    """An id with several vectors is found by the nearest of them, and listed once."""
    rows = [(100, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.0, 2.0]), (3, [1.0, 0.2]), (3, [1.0, 0.2])]
    got = gathered(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2))
    assert [(i, round(d, 6)) for i, d in got[100]] == [(1, 0.1), (3, 0.2)]


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, rank int"
    bad = [(0, None, 1), (1, [0.0, 0.0], 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [], 1), (None, [1.0, 1.0], 1)]
    some = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [1.0, 0.5], 1), (9, [1.0, 0.5], 1)]
    got = gathered(ann.search(spark.createDataFrame(bad + some, schema)))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {100: [8, 9, 7]}
    assert ann.search(spark.createDataFrame(bad, schema)).count() == 0
    assert ann.search(spark.createDataFrame([], schema)).count() == 0
