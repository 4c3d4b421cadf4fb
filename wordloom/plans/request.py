"""Requests: parsing, query analysis, search with spelling correction, expansion, trending topics."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import text
from wordloom.operators import feedback, rank, spell, topics
from wordloom.operators.index import Index
from wordloom.sources import sinks

QUOTED = re.compile(r'"(.+?)"')


@dataclass(frozen=True)
class SearchRequest:
    query: str
    num: int = 10
    ranker: str = "none"
    numdocs: int = 10
    numterms: int = 5
    format: str = "text"
    checker: str = "none"

    @classmethod
    def parse(cls, arguments: str) -> SearchRequest:
        """CGI arguments; keys in any case, values that are not valid leave the default."""
        found: dict = {"query": ""}
        allowed = {"ranker": {*rank.RANKERS, "none"}, "format": {"text", "html", "json"}, "checker": {"none", "bk", "ngram"}}
        for key, value in parse_qsl(arguments, keep_blank_values=True):
            key = key.lower()
            if key == "query":
                found["query"] = value
            elif key in ("num", "numdocs", "numterms") and re.fullmatch(r"[0-9]+", value):
                found[key] = int(value)
            elif value.lower() in allowed.get(key, ()):
                found[key] = value.lower()
        return cls(**found)


@dataclass
class ParsedQuery:
    """Distinct terms in order, the quoted phrases, and the terms outside of them."""

    terms: list[str]
    phrases: list[list[str]] = field(default_factory=list)
    solo: list[str] = field(default_factory=list)


def analyse(spark: SparkSession, query: str, stem: bool = False) -> ParsedQuery:
    """Stop words go, but not from phrases; every term is stemmed once, as in the index."""
    quoted = [p.strip() for p in QUOTED.findall(query) if p.strip()]
    lines = spark.createDataFrame([(0, query), *[(i + 1, p) for i, p in enumerate(quoted)]], "id int, q string")
    words = F.transform(text.tokens(F.col("q")), lambda t: text.stem(t)) if stem else text.tokens(F.col("q"))
    plain = F.filter(text.tokens(F.col("q")), lambda t: ~text.is_stop_word(t))
    rows = {r["id"]: r for r in lines.select("id", words.alias("all"), (F.transform(plain, lambda t: text.stem(t)) if stem else plain).alias("kept")).collect()}
    phrases = [list(rows[i + 1]["all"]) for i in range(len(quoted)) if rows[i + 1]["all"]]
    inside = [t for p in phrases for t in p]
    solo = [t for t in dict.fromkeys(rows[0]["kept"]) if t not in inside]
    return ParsedQuery(list(dict.fromkeys([*solo, *inside])), phrases, solo)


def score(index: Index, ranker: str, query: ParsedQuery, buckets: DataFrame | None = None) -> DataFrame:
    if ranker == "none" or not query.terms:
        raise ValueError("there is no such ranker" if query.terms else "the query has no terms")
    if ranker in ("conjunctive", "phrase"):
        return rank.conjunctive(index, query.terms, query.phrases, query.solo) if ranker == "conjunctive" else rank.phrase(index, query.terms, query.phrases)
    if ranker in ("news", "news_comprehensive"):
        if buckets is None:
            raise ValueError("this ranker needs day buckets")
        return rank.RANKERS[ranker](index, query.terms, buckets)
    return rank.RANKERS[ranker](index, query.terms)


def corrections(index: Index, terms: list[str], checker: str, vocabulary: DataFrame | None = None, misspellings: DataFrame | None = None) -> DataFrame:
    """wrong, term: the best correction of every term that the vocabulary lacks."""
    spark = index.docs.sparkSession
    vocabulary = vocabulary if vocabulary is not None else index.term_stats.where(F.col("term").rlike("^[a-z]+$")).select("term")
    asked = spark.createDataFrame([(t,) for t in terms], "wrong string")
    unknown = asked.join(vocabulary.select(F.col("term").alias("wrong")), "wrong", "left_anti")
    if checker == "ngram":
        return spell.gram_suggestions(unknown, spell.gram_index(vocabulary), index.term_stats).where("rank = 1").select("wrong", "term")
    tiers = spell.nearest_tier(spell.within(unknown, vocabulary))
    return spell.suggestions(spell.scored(tiers, index.term_stats, misspellings), 1).select("wrong", "term")


def search(index: Index, request: SearchRequest, buckets: DataFrame | None = None, template: str = "<ul>\n{{results}}\n</ul>") -> DataFrame:
    """The response in the request's format; a misspelt query without a hit runs again, corrected."""
    if not request.query.strip():
        raise ValueError("the query is empty")
    spark = index.docs.sparkSession
    query, corrected = analyse(spark, request.query), None
    # At most `num` rows, made once: the documents are then picked by their ids, in front of the joins that enrich them.
    ranked = lambda q: rank.top(index, score(index, request.ranker, q, buckets), request.num)
    held = (best := ranked(query)).collect()
    if request.checker != "none" and not held:
        fixes = {r["wrong"]: r["term"] for r in corrections(index, query.terms, request.checker).collect()}
        if fixes:
            swap = lambda ts: [fixes.get(t, t) for t in ts]
            query = ParsedQuery(list(dict.fromkeys(swap(query.terms))), [swap(p) for p in query.phrases], swap(query.solo))
            corrected = " ".join(query.terms)
            held = (best := ranked(query)).collect()
    found = index.docs.where(F.col("doc_id").isin([r["doc_id"] for r in held])).drop("page_rank", "num_views")
    named = F.broadcast(spark.createDataFrame(held, best.schema)).join(found, "doc_id")
    named = named.withColumn("rank", F.row_number().over(Window.orderBy(*rank.ordering())))
    if "url" not in named.columns:
        named = named.withColumn("url", F.lit(None).cast("string"))
    if request.format == "json":
        return sinks.as_json(named, request.query, corrected)
    if request.format == "html":
        return sinks.as_html(named, template)
    return sinks.as_text(named.orderBy("rank"))


def search_news(index: Index, request: SearchRequest, buckets: DataFrame) -> DataFrame:
    if request.ranker != "news":
        raise ValueError("news are ranked by the ranker news")
    return search(index, request, buckets)


def expand(index: Index, request: SearchRequest, buckets: DataFrame | None = None) -> DataFrame:
    """term, prf: expansion of the query, or, where its last term is unknown, completions of it with prf null."""
    spark = index.docs.sparkSession
    query = analyse(spark, request.query)
    last = query.terms[-1:] if query.terms else []
    if last and index.term_stats.where(F.col("term") == last[0]).isEmpty():
        return complete(index, query.terms, request.numterms)
    ranker = "cosine" if request.ranker == "none" else request.ranker
    top = rank.top(index, score(index, ranker, query, buckets), request.numdocs)
    return feedback.expand(index.doc_tf, top, query.terms, request.numterms).select("term", "prf")


def complete(index: Index, terms: list[str], n: int) -> DataFrame:
    """The earlier terms followed by suggestions for the last."""
    vocabulary = index.term_stats.where(F.col("term").rlike("^[a-z]+$")).select("term")
    asked = index.docs.sparkSession.createDataFrame([(terms[-1],)], "wrong string")
    rows = spell.suggestions(spell.scored(spell.nearest_tier(spell.within(asked, vocabulary)), index.term_stats), n)
    return rows.orderBy("rank").select(F.concat_ws(" ", *map(F.lit, terms[:-1]), "term").alias("term"), F.lit(None).cast("double").alias("prf"))


def trending_topics(index: Index, doc_topics: DataFrame, keys: DataFrame, buckets: DataFrame, k: int = 5, words: int = 3, num: int = 10) -> DataFrame:
    """One JSON row: the k topics of the highest trend, each with its first words and the news found for them.

    keys: topic_id, rank, term. The words of all topics run as one batch.
    """
    best = topics.ranked_topics(topics.trend(doc_topics), k).select("topic_id", F.col("score").alias("trend"), F.col("rank").alias("place"))
    asked = keys.where(F.col("rank") <= words).join(F.broadcast(best), "topic_id").select(F.col("topic_id").alias("query_id"), "term").distinct()
    hits = rank.batch_cosine(index, asked, 1 << 30).join(buckets, "doc_id", "left")
    hits = hits.withColumn("score", F.col("score") / rank.age_divisor(F.col("bucket")))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= num)
    listed = hits.join(index.docs.select("doc_id", "title"), "doc_id").groupBy(F.col("query_id").alias("topic_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "title", "score"))).alias("articles"))
    labels = keys.where(F.col("rank") <= words).groupBy("topic_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("label"))
    rows = best.join(labels, "topic_id", "left").join(listed, "topic_id", "left")
    return rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct("place", "topic_id", "label", "trend", "articles")))).alias("json"))
