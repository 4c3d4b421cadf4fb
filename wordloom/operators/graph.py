"""The link graph and the view log: links, redirects, PageRank, views, rank correlation."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Targets without space, quote or fragment; one leading slash is left out.
LINK = r'(?i)<a\s[^>]*?href="/?([^" #]*)"'
REDIRECT = r'(?i)<meta\s+http-equiv="refresh"\s+content="0;\s*url=([^"]*)"'


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(LINK), F.lit(1))


def redirect(html: Column) -> Column:
    """Where the head of the page redirects to; null if nowhere."""
    head = F.substring_index(F.lower(html), "</head>", 1)
    return F.nullif(F.regexp_extract(F.substring(html, F.lit(1), F.length(head)), REDIRECT, 1), F.lit(""))


def internal(target: Column) -> Column:
    return (target != "") & ~target.startswith("..") & ~target.rlike("^(?i)https?:")


def resolve_redirects(pages: DataFrame, most: int = 10) -> DataFrame:
    """pages(name, redirect_to): name and the page that its redirects end at.

    Followed at most `most` times; cycles, longer chains and dead ends are left
    out. Every step doubles the distance followed.
    """
    ends = pages.where("redirect_to IS NULL").select("name", F.col("name").alias("target"))
    hops = pages.where("redirect_to IS NOT NULL").select("name", F.col("redirect_to").alias("target"))
    for _ in range(max(1, (most - 1).bit_length())):
        further = hops.select(F.col("name").alias("target"), F.col("target").alias("next"))
        hops = hops.join(further, "target", "left").select("name", F.coalesce("next", "target").alias("target"))
    return ends.union(hops.join(ends.select(F.col("name").alias("target")), "target", "left_semi").select("name", "target"))


def link_graph(pages: DataFrame) -> DataFrame:
    """pages(name, html): distinct edges src, dst between pages that redirect nowhere, targets resolved, without loops to themselves."""
    named = pages.select("name", redirect(F.col("html")).alias("redirect_to"), links(F.col("html")).alias("links"))
    found = named.where("redirect_to IS NULL").select(F.col("name").alias("src"), F.explode(F.array_distinct("links")).alias("link")).where(internal(F.col("link")))
    resolved = resolve_redirects(named).select(F.col("name").alias("link"), F.col("target").alias("dst"))
    return found.join(resolved, "link").select("src", "dst").where("src <> dst").distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("out_degree"))


def checkpoint_dir(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wordloom-")
        import atexit

        atexit.register(shutil.rmtree, base, True)
        spark.sparkContext._conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the cluster's shared folder: lineage is cut, and a lost executor costs no recomputation."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unwritten(df: DataFrame) -> None:
    """Delete the files of a table from written(), once nothing needs it."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def page_rank(vertices: DataFrame, edges: DataFrame, damping: float = 0.9, iterations: int = 2, pages: int | None = None, cut_every: int = 5) -> DataFrame:
    """vertices(id), edges(src, dst) to id and page_rank: start 1.0, all vertices updated together, nothing given back by dead ends.

    pages is the N of the formula where it is not the number of vertices. Each
    round shuffles the sums by target once; lineage is cut every few rounds.
    """
    n = pages if pages is not None else vertices.count()
    out = edges.join(out_degree(edges), "src").select("src", "dst", (1 / F.col("out_degree")).alias("share"))
    ranks = vertices.select("id", F.lit(1.0).alias("page_rank"))
    for i in range(1, iterations + 1):
        sums = out.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("page_rank") * F.col("share")).alias("s"))
        ranks = vertices.select("id").join(sums, F.col("id") == F.col("dst"), "left").select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("s", F.lit(0.0))).alias("page_rank"))
        if i % cut_every == 0 and i < iterations:
            ranks = written(ranks, "ranks")
    return ranks


def page_rank_sequential(vertices: DataFrame, edges: DataFrame, damping: float = 0.9, iterations: int = 2, pages: int | None = None) -> DataFrame:
    """The same, each vertex updated in id order with what is already new. Inherently serial: one task holds the whole graph, so only for small ones."""
    n = pages if pages is not None else vertices.count()
    all_rows = vertices.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst")).union(edges.select("src", "dst"))

    def run(pdf):
        import pandas as pd

        own = pdf[pdf.dst.isna()].src.sort_values().tolist()
        links = pdf[pdf.dst.notna()]
        degree = links.groupby("src").size().to_dict()
        into = links.groupby("dst").src.apply(list).to_dict()
        rank = dict.fromkeys(own, 1.0)
        for _ in range(iterations):
            for v in own:
                rank[v] = (1 - damping) / n + damping * sum(rank[u] / degree[u] for u in into.get(v, ()))
        return pd.DataFrame({"id": own, "page_rank": [rank[v] for v in own]})

    return all_rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "id long, page_rank double")


def num_views(docs: DataFrame, log: DataFrame, how: str = "last") -> DataFrame:
    """docs(doc_id, name) and log(article, views, line): num_views by the last line of an article, or the sum of all; 0 without any."""
    agg = F.max_by("views", "line") if how == "last" else F.sum("views")
    views = log.groupBy("article").agg(agg.alias("num_views"))
    return docs.join(views, docs["name"] == views["article"], "left").select("doc_id", F.coalesce("num_views", F.lit(0).cast("long")).alias("num_views"))


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """a(id, value), b(id, value): one row, the correlation of their ranks; equal values rank the larger id first.

    Ranks over all rows need a total order. Values are sorted in range
    partitions, and a row's rank is its place there plus the sizes of the
    partitions before, so no task sees all rows.
    """
    ranked = lambda df, name: global_rank(df, [F.desc("value"), F.desc("id")]).select("id", F.col("rank").alias(name))
    return ranked(a, "ra").join(ranked(b, "rb"), "id").agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n"))


def global_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with rank, from 1, in this order."""
    placed = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    placed = placed.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))
    # As many rows as there are partitions.
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn("rank", F.col("__row") + F.col("__before")).drop("__part", "__row", "__before")
