"""The full-text index as DataFrames: tokens, postings, statistics, and how they are saved.

Nothing is assigned a dense number on the way: terms join as strings, which
Parquet's dictionaries store as cheaply, and documents keep their ids. Counts
are partial before every shuffle, and a document's tokens are counted and placed
in the row where the document is read, without a shuffle, so a frequent term is
no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import codec, text
from wordloom.operators.graph import written

#: Postings in a part of a saved index.
PART_ROWS = 2_000_000
ROW_GROUP = 4 << 20


def _tokens_of(docs: DataFrame, rich: bool) -> Column:
    return text.tokens(F.concat_ws("\n", "title", "body") if "title" in docs.columns else F.col("text"), rich)


def token_rows(docs: DataFrame, stem: bool = False, rich: bool = False) -> DataFrame:
    """doc_id, term, pos: the tokens of title and body, positions running on from 0."""
    rows = docs.select("doc_id", F.posexplode(_tokens_of(docs, rich)).alias("pos", "term"))
    return rows.select("doc_id", (text.stem(F.col("term")) if stem else F.col("term")).alias("term"), F.col("pos").cast("long").alias("pos"))


def _ids_repeat(docs: DataFrame) -> bool:
    """Whether rows share a doc_id, so that they have to be brought together. Reads and shuffles ids only."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def doc_counts(docs: DataFrame, stem: bool = False, rich: bool = False, repeat: bool | None = None) -> DataFrame:
    """A row per document: doc_id, doc_len and counts, an array of term and tf. Nothing is shuffled unless rows share a doc_id (repeat: whether they do, where that is known)."""
    if _ids_repeat(docs) if repeat is None else repeat:
        tf = doc_tf(token_rows(docs, stem, rich))
        return tf.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"), F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("counts"))
    rows = _words(docs, stem, rich)
    return rows.select("doc_id", F.size("words").cast("long").alias("doc_len"), text.counted(F.col("words")).alias("counts"))


def _words(docs: DataFrame, stem: bool, rich: bool) -> DataFrame:
    """doc_id and words. Filters on what is made of the words, even those that Spark infers, would make them again."""
    words = _tokens_of(docs, rich)
    return docs.select("doc_id", (F.transform(words, lambda t: text.stem(t)) if stem else words).alias("words"))


def doc_terms(docs: DataFrame, stem: bool = False, rich: bool = False, repeat: bool | None = None) -> DataFrame:
    """doc_tf(token_rows(docs)), made row by row; see doc_counts."""
    if _ids_repeat(docs) if repeat is None else repeat:
        return doc_tf(token_rows(docs, stem, rich))
    return _words(docs, stem, rich).select("doc_id", F.inline(text.counted(F.col("words"))))


def doc_postings(docs: DataFrame, stem: bool = False, rich: bool = False, repeat: bool | None = None) -> DataFrame:
    """The postings of documents, like postings(token_rows(docs)), made row by row; see doc_counts."""
    if _ids_repeat(docs) if repeat is None else repeat:
        return postings(token_rows(docs, stem, rich))
    return _words(docs, stem, rich).select("doc_id", F.inline(text.placed(F.col("words"))))


def flat(counts: DataFrame) -> DataFrame:
    """doc_counts as rows of doc_id, term and tf."""
    return counts.select("doc_id", F.inline("counts"))


def postings(tokens: DataFrame) -> DataFrame:
    """doc_id, term, tf and sorted positions."""
    return tokens.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def doc_tf(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_stats(tf: DataFrame) -> DataFrame:
    """term, cf (in the corpus) and df (documents)."""
    return tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def term_stats_approx(tokens: DataFrame, error: float = 0.05) -> DataFrame:
    return tokens.groupBy("term").agg(F.count("*").alias("cf"), F.approx_count_distinct("doc_id", error).alias("df"))


def doc_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id").agg((F.max("pos") + 1).alias("doc_len"))


def dictionary(tokens: DataFrame) -> DataFrame:
    """term and term_id: dense, from 0, in order of first appearance by document and place.

    Dense numbers need a total order; terms take theirs from range partitions and
    these partitions' sizes, after the minimum is found in parallel.
    """
    from wordloom.operators.graph import global_rank

    first = tokens.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    return global_rank(first, [F.asc("first"), F.asc("term")]).select("term", (F.col("rank") - 1).cast("long").alias("term_id"))


def extents(docs: DataFrame) -> DataFrame:
    """Per document the positions [start, end) of TITLE and CONTENT."""
    sized = docs.select("doc_id", F.coalesce(F.size(text.tokens(F.col("title"))), F.lit(0)).cast("long").alias("t"), F.coalesce(F.size(text.tokens(F.col("body"))), F.lit(0)).cast("long").alias("b"))
    part = lambda name, start, end: F.struct(F.lit(name).alias("field"), start.alias("start_pos"), end.alias("end_pos"))
    zero = F.lit(0).cast("long")
    return sized.select("doc_id", F.inline(F.array(part("TITLE", zero, F.col("t")), part("CONTENT", F.col("t"), F.col("t") + F.col("b")))))


def position_deltas(post: DataFrame) -> DataFrame:
    """postings with the positions' differences, the first from 0."""
    return post.withColumn("deltas", F.transform("positions", lambda p, i: F.when(i == 0, p).otherwise(p - F.get(F.col("positions"), i - 1))))


def docid_deltas(tf: DataFrame) -> DataFrame:
    """doc_id less the term's one before it (the first: doc_id itself)."""
    before = F.lag("doc_id").over(Window.partitionBy("term").orderBy("doc_id"))
    return tf.withColumn("delta", F.col("doc_id") - F.coalesce(before, F.lit(0)))


def coded(post: DataFrame) -> DataFrame:
    """postings with the bytes of tf and position deltas in variable-byte code."""
    return position_deltas(post).withColumn("code", codec.encoded(F.concat(F.array("tf"), F.col("deltas"))))


def coded_sizes(tf: DataFrame) -> DataFrame:
    """Per term the bytes that its document ids take as coded differences, without coding them."""
    return docid_deltas(tf).groupBy("term").agg(F.sum(codec.size_of(F.col("delta"))).cast("long").alias("bytes"), F.count("*").alias("entries"))


def enriched(docs: DataFrame, page_rank: DataFrame | None = None, views: DataFrame | None = None) -> DataFrame:
    """docs with page_rank and num_views, 0 where unknown."""
    out = docs.join(page_rank.select("doc_id", "page_rank"), "doc_id", "left") if page_rank is not None else docs.withColumn("page_rank", F.lit(0.0))
    out = out.join(views.select("doc_id", "num_views"), "doc_id", "left") if views is not None else out.withColumn("num_views", F.lit(0).cast("long"))
    return out.withColumns({"page_rank": F.coalesce("page_rank", F.lit(0.0)), "num_views": F.coalesce("num_views", F.lit(0).cast("long"))})


def vocabulary(stats: DataFrame) -> DataFrame:
    """The terms and their corpus frequencies without stop words."""
    return stats.where(~text.is_stop_word(F.col("term"))).select("term", "cf")


@dataclass
class Index:
    """docs(doc_id, title, body and more), their tokens, and what follows from them."""

    docs: DataFrame
    tokens: DataFrame
    doc_tf: DataFrame
    term_stats: DataFrame
    doc_stats: DataFrame
    counts: DataFrame
    postings: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, stem: bool = False, rich: bool = False, page_rank: DataFrame | None = None, views: DataFrame | None = None, keep: bool = False) -> Index:
        """keep writes the counts to the shared folder first, so that rankers that read them several times tokenise once."""
        repeat = _ids_repeat(docs)
        counts = doc_counts(docs, stem, rich, repeat)
        counts = written(counts, "doc-counts") if keep else counts
        tf = flat(counts) if keep else doc_terms(docs, stem, rich, repeat)
        stats = term_stats(tf)
        stats = written(stats, "term-stats") if keep else stats
        title_len = F.coalesce(F.size(text.tokens(F.col("title"), rich)), F.lit(0)).cast("long") if "title" in docs.columns else F.lit(0).cast("long")
        # Titles are measured before the joins, which then move no text.
        sized = enriched(docs.select("doc_id", title_len.alias("title_len")), page_rank, views)
        return cls(enriched(docs, page_rank, views), token_rows(docs, stem, rich), tf, stats, sized, counts, doc_postings(docs, stem, rich, repeat))

    def totals(self) -> DataFrame:
        """One row: documents, tokens and views of the corpus."""
        return self.docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("num_views"), F.lit(0)).alias("total_views")).join(self.term_stats.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("total_tf")))

    def weighted(self, counts: DataFrame) -> DataFrame:
        """doc_id, term, idf and weight, tf over length times idf, of rows of counts. Each pair goes to its term's statistics once, which are the side that is held, so that the many are not sorted."""
        n = self.docs.agg(F.count("*").alias("n_docs"))
        rows = counts.select("doc_id", "doc_len", F.inline("counts"))
        joined = rows.join(self.term_stats.select("term", "df").hint("shuffle_hash"), "term").join(F.broadcast(n))
        idf = F.ln(F.col("n_docs") / F.col("df"))
        return joined.select("doc_id", "term", idf.alias("idf"), (F.col("tf") / F.col("doc_len") * idf).alias("weight"))

    def norms(self, counts: DataFrame | None = None) -> DataFrame:
        """Per document (of those rows of counts only) the norm of its tf-idf weights."""
        rows = self.weighted(self.counts if counts is None else counts)
        return rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))

    def save(self, path: str, parts: int = 64) -> None:
        """Parquet tables; postings are dealt by term and sorted by it in each part, so that a query's few terms prune row groups and pages by their statistics.

        Ranges of terms would take a pass of their own to be found, which makes all
        postings twice. Of large indexes there are more than `parts` parts, each small
        enough to be sorted in memory; a term of very many documents is in several.
        """
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        stats = term_stats(flat(self.docs.sparkSession.read.parquet(f"{path}/counts")))
        stats.repartitionByRange(parts, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_stats")
        rows, most = (x or 0 for x in self.docs.sparkSession.read.parquet(f"{path}/term_stats").agg(F.sum("df"), F.max("df")).first())
        dealt = self.postings.repartition(max(parts, rows // PART_ROWS + 1), "term", F.pmod(F.xxhash64("doc_id"), F.lit(most // PART_ROWS + 1)))
        dealt.sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        post = read("postings")
        rows = post.select("doc_id", "term", F.explode("positions").alias("pos"))
        return cls(read("docs"), rows, post.select("doc_id", "term", "tf"), read("term_stats"), read("doc_stats"), read("counts"), post)

    def lookup(self, terms: list[str]) -> DataFrame:
        """term, cf and df of the terms, 0 where unknown."""
        asked = self.docs.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
        zero = F.lit(0).cast("long")
        return asked.join(self.term_stats.where(F.col("term").isin(terms)), "term", "left").select("term", F.coalesce("cf", zero).alias("cf"), F.coalesce("df", zero).alias("df"))
