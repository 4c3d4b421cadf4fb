"""Near duplicates: classes against all pairs' exact similarity; shards, components and edges."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import queries, simhash_dedup
from wordloom.llm.shared import Scratch
from wordloom.llm.smallworld import SmallWorld


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Class by doc_id, from an inverted index of shingles."""
    own = {d: sets(t) for d, t in rows if d is not None}
    root = {d: d for d in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for d, s in sorted(own.items()):
        common = Counter(e for g in s for e in index[g])
        for e, n in common.items():
            if n / (len(s) + len(own[e]) - n) >= 0.8:
                a, b = sorted((find(d), find(e)))
                root[b] = a
        for g in s:
            index[g].append(d)
    return {d: find(d) for d in own}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, size):
    sf_dir = f"/root/testdata/{size}"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    got = {r.doc_id: r.class_id for r in queries.op5_simhash_dedup(spark, sf_dir).collect()}
    assert got == want and len(set(got.values())) < len(got)


def family(rng, base, n, change):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(change):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_hot_group_in_blocks(spark):
    """A family far larger than a shard, chained by edits, and strangers that share a passage."""
    rng = random.Random(2)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(150))
    texts = family(rng, base, 150, 3) + [base[:200] + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in simhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), shard=40).collect()}
    assert got == brute(rows)


def test_graph_recall():
    """The graph alone, against exact distances: families among strangers, in shards from two documents to two thousand."""
    rng = np.random.default_rng(1)
    for n, share in ((2, 1.0), (5, 0.8), (40, 0.5), (1024, 0.3), (2048, 0.3), (1024, 1.0)):
        twins = int(n * share / 2)
        base = rng.integers(0, 2, (n - twins, 128), dtype=np.uint8)
        near = base[:twins] ^ (rng.random((twins, 128)) < rng.uniform(0.02, 0.2, (twins, 1)))
        bits = np.packbits(np.concatenate([base, near])[rng.permutation(n)], 1).view(np.uint64)
        exact = simhash_dedup.hamming(bits[:, None], bits[None])
        world = SmallWorld(bits, simhash_dedup.hamming)
        ids, dist = world.search(bits, simhash_dedup.BEAMS[0], np.arange(n))
        found = {(r, i) for r, row in enumerate(ids.tolist()) for i in row if i >= 0}
        assert len(found) == (ids >= 0).sum() and all(dist[r][ids[r] == i] == exact[r, i] for r, i in list(found)[:500])
        true = {(a, b) for a, b in zip(*np.nonzero(exact <= 36)) if a != b}
        assert len(true & found) >= 0.95 * len(true) and true


def test_crowded_shard():
    """Families larger than a beam, in one shard: they hang together as brute force says, by the graph and its wider beams."""
    rng = random.Random(4)
    texts = [t for k in range(5) for t in family(rng, " ".join(f"f{k}w{rng.randrange(900)}" for _ in range(120)), 150, 2)]
    own = [simhash_dedup.shingles(t) for t in texts]
    bits = np.frombuffer(b"".join(map(simhash_dedup.simhash, own)), np.uint64).reshape(-1, 2)
    shard = simhash_dedup.Shard(bits, own)
    edges, (want, got) = shard.link()
    assert want and got >= 0.95 * want and len(edges) < len(texts)
    assert len(set(shard.root.tolist())) == len(set(brute(list(enumerate(texts))).values()))


def test_graph_ran(spark):
    """On the tables of the query every shard has a graph and an audit; its recall is that of the README."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found, audit = simhash_dedup.labelled(docs)
    seen = audit.first()
    assert seen.shards >= 4 and seen.wanted >= 20 and seen.got >= 0.95 * seen.wanted
    got = {r.doc_id: r.class_id for r in found.collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_large_family_is_bounded(monkeypatch):
    """Members of a family that are near to all others and similar to few are told apart by their maps, not each compared with each; classes stay those of brute force."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [t for k in (2, 4, 8, 10, 12) for t in family(rng, " ".join(base), 80, k)]
    own = [simhash_dedup.shingles(t) for t in texts]
    bits = np.frombuffer(b"".join(map(simhash_dedup.simhash, own)), np.uint64).reshape(-1, 2)
    real, tried = simhash_dedup.similarity, []
    monkeypatch.setattr(simhash_dedup, "similarity", lambda a, b: tried.append(real(a, b)) or tried[-1])
    want = brute(list(enumerate(texts)))
    shard = simhash_dedup.Shard(bits, own)
    shard.link()
    assert len(set(want.values())) == len(set(shard.root.tolist())) == len(set(zip(want.values(), shard.root[list(want)].tolist())))
    assert len(tried) < 3 * len(texts)
    tried.clear()
    simhash_dedup.Shard(bits, own, 200).link()
    assert len(tried) < 3 * len(texts)


def test_maps_lose_no_pair():
    """No pair of similarity 0.8 or more is ruled out, at any size of sets."""
    rng = np.random.default_rng(9)
    for size in (1, 3, 9, 45, 400, 9000):
        base = rng.integers(0, 1 << 32, size, dtype=np.uint32)
        sets = []
        for change in np.linspace(0, 0.3, 25):
            new = rng.integers(0, 1 << 32, size, dtype=np.uint32)
            sets.append(np.unique(np.where(rng.random(size) < change, new, base)))
        shard = simhash_dedup.Shard(np.zeros((len(sets), 2), np.uint64), sets)
        rows, others = np.triu_indices(len(sets), 1)
        able = shard.possible(rows, others)
        similar = np.array([simhash_dedup.similarity(sets[a], sets[b]) >= 0.8 for a, b in zip(rows, others)])
        assert similar.any() and able[similar].all() and (size < 45 or not able.all())


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    want = brute([])
    root = {x: x for p in pairs for x in p}
    for a, b in pairs * 60:
        low = min(root[a], root[b])
        root[a] = root[b] = low
    scratch = Scratch(spark, "test")
    got = {r.id: r["class"] for r in simhash_dedup.components(spark.createDataFrame(pairs, "a long, b long"), scratch).collect()}
    assert want == {} and got == {k: v for k, v in root.items() if k in got} and all(a in got or a == b for a, b in pairs)


def test_edges(spark):
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(5, text, 1), (5, text, 1), (3, text.upper(), 1), (7, None, 1), (8, "", 1), (9, "  \n", 1), (10, "same two", 1), (11, "Same  two", 1), (None, text, 1), (None, None, 1), (12, "z " * 60000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    df = df.withColumn("__id", F.lit(0)).withColumn("tag", F.lit("x"))
    got = sorted((str(r.doc_id), str(r.class_id)) for r in simhash_dedup.classes(df).collect())
    assert got == sorted([("5", "3"), ("5", "3"), ("3", "3"), ("7", "7"), ("8", "8"), ("9", "9"), ("10", "10"), ("11", "10"), ("None", "None"), ("None", "None"), ("12", "12")])
    kept = simhash_dedup.keep_one(df)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "7", "8", "9", "10", "None", "None", "12"]) and kept.columns == df.columns
    assert simhash_dedup.classes(df.limit(0)).count() == 0


def test_rows_of_one_id(spark):
    """Different texts under one doc_id are judged each by itself."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(4, one), (4, two), (6, two + " end"), (6, "apart from all the others"), (2, one + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash_dedup.classes(df).collect()) == [(2, 2), (4, 2), (4, 4), (6, 4), (6, 6)]
    assert sorted(tuple(r) for r in simhash_dedup.keep_one(df).collect()) == [(2, one + " end"), (4, two), (6, "apart from all the others")]
