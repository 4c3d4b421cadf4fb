"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample, halved again and again at the median, so
that lists are balanced; those that turn out too long are halved again, and
those too short go. Vectors near a boundary are posted to several lists: those
within a margin of the nearest one's distance, under which a tenth of all
vectors fill all their copies. Queries search an in-memory graph of the
centroids and take the lists within a ratio of the nearest one's distance, up to
a number of probes. Ratio and probes are set by an audit: for some vectors that
are no queries the true neighbours are found by brute force, and both are as
wide as it takes for the walk of the graph to come by the share of them that is
asked for. Long lists are scanned in blocks, long queues of queries in slices,
so no task's share is unbounded.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, small_batches
from .smallworld import SmallWorld

FOUND = "query_id long, vec_id long, score double"


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(2)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part: finite components, one of them not zero, of the commonest length. Floats stay floats."""
    finite = F.expr("vec_id IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (length["d"] if length else 0))


def thinned(rows: DataFrame, k: int) -> DataFrame:
    """rows without those that can't be among any query's k nearest: of equal vectors only the k + 1 smallest ids matter, as ties go to them.

    A vector that a third of all rows share is no load after that. Only hashes
    and ids travel; a limit per hash is applied before they do.
    """
    same = F.struct(F.xxhash64("embedding").alias("a"), F.hash("embedding").alias("b"))
    keyed = rows.withColumn("same", same)
    hot = keyed.groupBy("same").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("same")
    ids = keyed.select("same", "vec_id").join(hot, "same", "left_semi").distinct()
    last = ids.withColumn("nth", F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))).where(F.col("nth") <= k + 1).groupBy("same").agg(F.max("vec_id").alias("last"))
    marked = keyed.join(last, "same", "left").where("last IS NULL OR vec_id <= last")
    return marked.where("last IS NULL").select("vec_id", "embedding").union(marked.where("last IS NOT NULL").dropDuplicates(["vec_id", "same"]).select("vec_id", "embedding"))


def nearest(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of vectors and exact distances: each query's k nearest ids but its own, ties to the smaller id, of an id's vectors the nearest."""
    out: list[tuple] = []
    more = len(ids) - len(np.unique(ids))
    for at in range(0, len(queries), 64):
        rough = squared(queries[at : at + 64], vectors)
        rough[own[at : at + 64, None] == ids[None]] = np.inf
        take = min(k + more, rough.shape[1]) - 1
        kth = np.partition(rough, take, axis=1)[:, take]
        scale = (queries[at : at + 64] ** 2).sum(1) + (vectors**2).sum(1).max()
        for row in range(len(rough)):
            near = np.flatnonzero((rough[row] <= kth[row] + 1e-9 * scale[row]) & np.isfinite(rough[row]))
            exact = np.sqrt(((vectors[near] - queries[at + row]) ** 2).sum(1))
            best = np.lexsort((ids[near], exact))
            if more:
                best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])]
            best = best[:k]
            out.append((np.full(len(best), at + row), near[best], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def halved(own: np.ndarray, rng: np.random.Generator, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two halves of equal size, cut across the line between two means."""
    ends = own[rng.choice(len(own), 2, replace=False)]
    for _ in range(rounds):
        near = squared(own, ends).argmin(1) == 0
        if near.all() or not near.any():
            break
        ends = np.stack([own[near].mean(0), own[~near].mean(0)])
    order = np.argsort(own @ (ends[1] - ends[0]), kind="stable")
    return order[: len(order) // 2], order[len(order) // 2 :]


def balanced(sample: np.ndarray, lists: int, rounds: int = 3) -> SmallWorld:
    """The graph of the centroids: the largest group is halved until there are enough; then those that more than twice the mean of all rows
    are nearest to are halved again, and those with less than a quarter of it dropped."""
    rng = np.random.default_rng(0)
    lists = max(1, min(lists, len(sample) // 2))
    heap, made = [(-len(sample), 0, np.arange(len(sample)))], 0
    while len(heap) < lists:
        rows = heapq.heappop(heap)[2]
        for part in halved(sample[rows], rng):
            heapq.heappush(heap, (-len(part), made := made + 1, rows[part]))
    points = np.stack([sample[rows].mean(0) for _, _, rows in heap])
    for _ in range(rounds):
        graph = SmallWorld(points, euclid)
        near = np.concatenate([graph.search(sample[a : a + 512], 8)[0][:, 0] for a in range(0, len(sample), 512)])
        counts = np.bincount(near, minlength=len(points))
        mean = len(sample) / len(points)
        if counts.max() <= 2 * mean:
            break
        order, first = np.argsort(near, kind="stable"), np.concatenate([[0], np.cumsum(counts)])
        new = []
        for at in range(len(points)):
            rows = order[first[at] : first[at + 1]]
            if len(rows) > max(2 * mean, 3):
                new += [sample[rows[part]].mean(0) for part in halved(sample[rows], rng)]
            elif len(rows) >= mean / 4:
                new.append(sample[rows].mean(0))
        points = np.stack(new)
    return SmallWorld(points, euclid)


@dataclass
class Lists:
    """The fitted index: the graph of the centroids, and how rows are posted and queries routed."""

    graph: SmallWorld
    copies: int
    margin: float
    probes: int = 1
    ratio: float = 1.0

    def homes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of vectors and their lists: the nearest, and others within the margin, up to `copies`."""
        ids, dist = self.walk(vectors, self.copies)
        row, col = np.nonzero((dist <= (1 + self.margin) * dist[:, :1]) & (ids >= 0))
        return row, ids[row, col]

    def walk(self, vectors: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """The lists of each vector, nearest first, as the graph finds them with a beam of this width (16 at least), and their distances."""
        found = [self.graph.search(vectors[a : a + 512], max(wide, 16)) for a in range(0, len(vectors), 512)]
        return np.concatenate([x[:, :wide] for x, _ in found]), np.sqrt(np.concatenate([x[:, :wide] for _, x in found]))

    def routes(self, queries: np.ndarray, widen: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Rows of queries and their lists. widen takes so many times the probes, and no heed of the ratio."""
        ids, dist = self.walk(queries, min(self.probes * widen, len(self.graph.points)))
        row, col = np.nonzero(((dist <= self.ratio * dist[:, :1]) | (widen > 1)) & (ids >= 0))
        return row, ids[row, col]


def exhaustive(queries: np.ndarray, own: np.ndarray, rows: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, embedding: the k nearest of a bounded set of queries against all rows, of which each task keeps as many."""

    def run(batches):
        kept = None
        for batch in batches:
            part = pa.table({"vec_id": batch.column("vec_id"), "embedding": batch.column("embedding")})
            if not len(part):
                continue
            q, v, d = nearest(queries, own, matrix(part["embedding"]), part["vec_id"].to_numpy(), k)
            new = part.take(pa.array(v)).append_column("query", pa.array(q)).append_column("score", pa.array(d))
            kept = pa.concat_tables([kept, new]) if kept else new
            order = np.lexsort((kept["vec_id"].to_numpy(), kept["score"].to_numpy(), kept["query"].to_numpy()))
            q = kept["query"].to_numpy()[order]
            kept = kept.take(pa.array(order[np.arange(len(q)) - np.searchsorted(q, q) < (k + 1) ** 2]))
        if kept:
            yield from kept.set_column(kept.column_names.index("query"), "query_id", pa.array(own[kept["query"].to_numpy()], pa.int64())).select(["query_id", "vec_id", "score", "embedding"]).combine_chunks().to_batches()

    kind = rows.schema["embedding"].dataType.simpleString()
    return top(rows.mapInArrow(run, f"{FOUND}, embedding {kind}"), k)


def top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k nearest ids: of several scores of one id the least."""
    best = found.repartition("query_id").withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "vec_id").orderBy("score"))).where("nth = 1").drop("nth")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)


def fit(rows: DataFrame, n: int, every: int, k: int, recall: float, lists: int, copies: int, audited: int) -> Lists:
    """The index of about n rows(vec_id, embedding), fitted to about 8 rows a list and audited."""
    hashed = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    size = max(64, 8 * lists)
    sample = rows.where(hashed < min(1.0, size / n) * (1 << 30)).orderBy("vec_id", "embedding").limit(2 * size).toArrow()
    if sample.num_rows < 2:
        sample = rows.orderBy(hashed, "vec_id").limit(size).toArrow()
    points = matrix(sample["embedding"])
    out = Lists(balanced(points, lists), copies, 0.0)
    count = len(out.graph.points)
    far = out.walk(points[:4096], min(copies, count))[1]
    out.margin = float(np.clip(np.quantile(far[:, -1] / np.maximum(far[:, 0], 1e-300), 0.1) - 1, 0, 1))

    # The audit: at which place of a walk from each vector the lists of its true neighbours come.
    others = rows.where(F.col("vec_id") % every != 0).orderBy(hashed, "vec_id").limit(audited).toArrow()
    picked = others if others.num_rows else rows.orderBy(hashed, "vec_id").limit(audited).toArrow()
    own, asked = picked["vec_id"].to_numpy(), matrix(picked["embedding"])
    truth = exhaustive(asked, own, rows, k).toArrow()
    if not truth.num_rows:
        return out
    row, home = out.homes(matrix(truth["embedding"]))
    at = {v: i for i, v in enumerate(own.tolist())}
    query = np.array([at[q] for q in truth["query_id"].to_pylist()])
    sure, beam = 1 - (1 - recall) / 2, min(64, count)
    while True:
        ids, dist = out.walk(asked, beam)
        place = np.full((len(asked), count + 1), beam)
        np.put_along_axis(place, np.where(ids < 0, count, ids), np.broadcast_to(np.arange(beam), ids.shape), 1)
        need = np.full(truth.num_rows, beam)
        np.minimum.at(need, row, place[query[row], home])
        if (need < beam).mean() >= sure or beam == count:
            break
        beam = min(2 * beam, count)
    need = np.minimum(need, beam - 1)
    out.probes = int(np.quantile(need, sure, method="higher")) + 1
    ratio = dist[query, need] / np.maximum(dist[query, 0], 1e-300)
    out.ratio = float(np.quantile(np.where(np.isfinite(ratio), ratio, 1e300), sure, method="higher")) * (1 + 1e-9)
    return out


def posted(rows: DataFrame, index: Lists) -> DataFrame:
    """list, vec_id, embedding: every row in each of its lists."""

    def post(batches):
        for batch in batches:
            if batch.num_rows:
                r, h = index.homes(matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int32()), *[batch.column(c).take(pa.array(r)) for c in ("vec_id", "embedding")]], names=["list", "vec_id", "embedding"])

    return rows.mapInArrow(post, f"list int, vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}")


def routed(queries: DataFrame, index: Lists, widen: int = 1) -> DataFrame:
    """list, query_id, query: every query in each list that it takes."""

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                r, h = index.routes(matrix(batch.column("query")), widen)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int32()), *[batch.column(c).take(pa.array(r)) for c in ("query_id", "query")]], names=["list", "query_id", "query"])

    return queries.mapInArrow(route, f"list int, query_id long, query {queries.schema['query'].dataType.simpleString()}")


def scanned(rows: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest in every block of every list, of posted rows and routed queries."""
    size = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    # A row a list, so no more than there are centroids in every worker's memory.
    parts = F.broadcast(size(rows, "row_blocks").join(size(queries, "query_blocks"), "list"))

    def cut(df: DataFrame, mine: str, key: str, other: str) -> DataFrame:
        """Rows of a list spread over its blocks, and repeated for each slice of the other side."""
        number = F.pmod(F.xxhash64(key), F.col(f"{mine}_blocks")).cast("int").alias(mine)
        return df.join(parts, "list").select(*df.columns, number, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other))

    def scan(key, left, right):
        q, v, d = (np.zeros(0, int),) * 2 + (np.zeros(0),)
        ids, own = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        if len(ids) and len(own):
            q, v, d = nearest(matrix(right["query"]), own, matrix(left["embedding"]), ids, k)
        return pa.table({"query_id": pa.array(own[q], pa.int64()), "vec_id": pa.array(ids[v], pa.int64()), "score": pa.array(d, pa.float64())})

    keys = ["list", "row", "query_part"]
    left = cut(rows, "row", "vec_id", "query").withColumnRenamed("query", "query_part")
    right = cut(queries.withColumnRenamed("query", "vector"), "query", "query_id", "row").withColumnsRenamed({"query": "query_part", "vector": "query"})
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, FOUND)


def search(vectors: DataFrame, every: int = 100, k: int = 10, lists_per_root: float = 4.0, most_lists: int = 1 << 18, copies: int = 3, recall: float = 0.94, audited: int = 128, block: int = 8192) -> DataFrame:
    """Each query's k nearest rows found: query_id, rank, vec_id, score (Euclidean, double, of the vectors as they are).

    Queries are the rows whose vec_id is divisible by `every`; vectors has
    vec_id and embedding, other columns are left out. Rows that are null, zero,
    not finite or of another length take no part, repeated rows count once, and
    rows of a query's own vec_id are never its neighbours; where a vec_id has
    several vectors, each may be a query's neighbour, by the nearest of them, and
    of several queries of one id each neighbour's least distance counts.

    Every row is indexed, in lists_per_root * sqrt(rows) lists up to most_lists
    (of 4e9 rows; lists grow with the data beyond that), which are fitted to
    about 8 rows each, drawn by a hash. Queries that find fewer than k in their
    lists take four times as many, again and again, until they have all.
    """
    small_batches(vectors.sparkSession)
    scratch = Scratch(vectors.sparkSession, "ann")
    every_row = valid(vectors)
    wanted = every_row.where(F.col("vec_id") % every == 0)
    n = every_row.count()
    if n < 2 or wanted.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = thinned(every_row, k)
    index = fit(rows, n, every, k, recall, min(most_lists, int(np.ceil(lists_per_root * np.sqrt(n)))), copies, audited)
    queries = wanted.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).distinct()
    lists = scratch.keep(posted(rows, index), "lists")
    best = scratch.keep(top(scanned(lists, scratch.keep(routed(queries, index), "routes"), k, block), k), "best")
    widen = 1
    while widen == 1 or index.probes * widen < 4 * len(index.graph.points):
        widen *= 4
        full = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n - 1))
        short = queries.join(full, "query_id", "left_anti")
        if short.isEmpty():
            break
        again = scratch.keep(routed(short, index, widen), f"routes{widen}")
        best = scratch.keep(top(best.drop("rank").unionByName(scanned(lists, again, k, block)), k), f"best{widen}")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
