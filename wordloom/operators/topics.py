"""News and topics: dates, day buckets, first-seen filtering, trend scores, a topic model."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 14
FORMATS = ["yyyy-MM-dd", "dd MMM yyyy", "dd MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm:ss Z"]


def parse_date(value: Column) -> Column:
    """A timestamp by the first format that fits, a leading weekday left out; null if none does."""
    plain = F.trim(F.regexp_replace(value, r"^\s*[A-Za-z]{3,9},\s*", ""))
    shaped = lambda pattern: F.when(plain.rlike(pattern), plain)
    shapes = [r"^\d{4}-\d{2}-\d{2}$", r"^\d{2} [A-Za-z]{3} \d{4}$", r"^\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [A-Za-z]+$", r"^\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"]
    return F.coalesce(*[F.try_to_timestamp(shaped(s), F.lit(f)) for s, f in zip(shapes, FORMATS)])


def fill_forward(df: DataFrame, column: str, order: str, group: str | None = None) -> DataFrame:
    """Nulls of a column take the last value before them; group keeps runs apart and in parallel."""
    window = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(window))


def day_bucket(ts: Column, first: date, days: int = DAYS) -> Column:
    """The day's number from `first` on, held between 0 and days - 1."""
    return F.least(F.greatest(F.datediff(ts, F.lit(first)), F.lit(0)), F.lit(days - 1)).cast("long")


def first_seen(items: DataFrame, key: list[str], order: list[str], since: date | None = None, known: DataFrame | None = None) -> DataFrame:
    """The first item of each key, not before `since`, whose key is not among the known ones."""
    rows = items.where(F.col("ts") >= F.lit(since)) if since else items
    if known is not None:
        rows = rows.join(known.select(*key), key, "left_anti")
    # A min over the row as a struct is partial before the shuffle, unlike a window.
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*key, "__row.*").select(*items.columns)


def feed_counts(items: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row about a pass over feed items: the latest date, how many were accepted, and how many were not (duplicates, or too old)."""
    seen = items.agg(F.max("ts").alias("latest"), F.count("*").alias("seen"))
    return seen.join(F.broadcast(accepted.agg(F.count("*").alias("accepted")))).select("latest", "accepted", (F.col("seen") - F.col("accepted")).alias("duplicates"))


def with_default_date(items: DataFrame, now: Column, source: str = "Xinhua") -> DataFrame:
    """ts is the crawl's time where it is missing or the source's dates are not to be trusted."""
    return items.withColumn("ts", F.when(F.col("ts").isNull() | (F.col("source") == source), now).otherwise(F.col("ts")))


def topic_days(doc_topics: DataFrame, days: int = DAYS) -> DataFrame:
    """doc_topics(topic_id, bucket) to a column per day, slot_0 on."""
    return doc_topics.groupBy("topic_id").agg(*[F.count_if(F.col("bucket") == d).alias(f"slot_{d}") for d in range(days)])


def topic_terms(keys: DataFrame) -> DataFrame:
    """keys(topic_id, terms: space-separated) to topic_id, term, rank: stems, each at its first place."""
    from wordloom.functions import text

    rows = keys.select("topic_id", F.posexplode(F.split("terms", " ")).alias("pos", "raw")).where("raw <> ''")
    stem = F.when(F.col("raw") == "eric", F.col("raw")).otherwise(text.stem(F.lower("raw")))
    first = rows.groupBy("topic_id", stem.alias("term")).agg(F.min("pos").alias("pos"))
    return first.select("topic_id", "term", F.row_number().over(Window.partitionBy("topic_id").orderBy("pos")).cast("long").alias("rank"))


def topic_sizes(topics: DataFrame, doc_topics: DataFrame) -> DataFrame:
    """Smallest, largest and mean number of documents, over all topics."""
    counts = topics.select("topic_id").join(doc_topics.groupBy("topic_id").agg(F.count("*").alias("n")), "topic_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return counts.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean"))


def trend(doc_topics: DataFrame, days: int = DAYS) -> DataFrame:
    """topic_id, n, peak, age (1: the newest day), z and score from doc_topics(topic_id, bucket).

    z: how far the peak is above the mean in deviations, over log2(1.95 + 0.05
    age); score: z times the topic's size on a scale from the smallest to the
    largest. A flat topic has z 0.
    """
    slots = topic_days(doc_topics, days)
    values = F.array(*[f"slot_{d}" for d in reversed(range(days))])
    rows = slots.select("topic_id", values.alias("v"))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.select("topic_id", "v", total.alias("n"), F.array_max("v").alias("peak")).withColumns({"age": F.array_position("v", F.col("peak")).cast("long"), "mean": F.col("n") / days})
    spread = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / days)
    z = F.coalesce(F.try_divide(F.col("peak") - F.col("mean"), spread), F.lit(0.0)) / F.log2(1.95 + 0.05 * F.col("age"))
    rows = rows.withColumn("z", z)
    # One row of extremes for all topics.
    ends = rows.agg(F.min("n").alias("least"), F.max("n").alias("most"))
    scale = F.coalesce(F.try_divide(F.col("n") - F.col("least"), F.col("most") - F.col("least")), F.lit(0.0))
    return rows.join(F.broadcast(ends)).select("topic_id", "n", "peak", "age", "z", (F.col("z") * scale).alias("score"))


def slot_changes(slots: DataFrame) -> DataFrame:
    """slots(topic_id, bucket, n): the sum of changes from day to day."""
    change = F.col("n") - F.lag("n").over(Window.partitionBy("topic_id").orderBy("bucket"))
    return slots.withColumn("change", change).groupBy("topic_id").agg(F.coalesce(F.sum("change"), F.lit(0).cast("long")).alias("changes"))


def ranked_topics(scores: DataFrame, k: int) -> DataFrame:
    """The k topics with the highest scores; ties to the smaller id."""
    return scores.orderBy(F.desc("score"), "topic_id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "topic_id")).cast("long"))


def topic_docs(doc_topics: DataFrame, k: int) -> DataFrame:
    """The k documents with the highest proportion of each topic."""
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("proportion"), "doc_id"))
    return doc_topics.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def grade(proportion: Column) -> Column:
    return F.when(proportion > 0.8, "Perfect").when(proportion > 0.6, "Excellent").when(proportion > 0.4, "Good").when(proportion > 0.2, "Fair").otherwise("Bad")


def topic_model(docs: DataFrame, topics: int = 200, words: int = 10, most: int = 5, vocabulary: int | None = None, rounds: int = 20, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """LDA over docs(doc_id, text): doc_topics(doc_id, topic_id, proportion), the `most` largest each, and topic_terms(topic_id, rank, term).

    All terms of two or more documents count, unless `vocabulary` caps them to the most frequent.
    """
    from wordloom.functions import text
    from wordloom.operators import index, lda
    from wordloom.operators.graph import written

    words_of = F.filter(text.tokens(F.col("text")), lambda t: ~text.is_stop_word(t))
    corpus = written(docs.select("doc_id", words_of.alias("words")).select("doc_id", text.counted(F.col("words")).alias("counts")), "corpus")
    stats = index.term_stats(index.flat(corpus)).where("df > 1")
    names = written((stats.orderBy(F.desc("cf"), "term").limit(vocabulary) if vocabulary else stats).select("term"), "vocabulary")
    model = lda.Model(corpus, names, topics, seed)
    for i in range(1, rounds + 1):
        model.round(i)
    # Rows that share a doc_id share its places.
    place = lambda key, by: F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), "topic_id" if key == "doc_id" else "term"))
    doc_topics = model.shares(most).withColumn("r", place("doc_id", "proportion")).where(F.col("r") <= most).drop("r")
    terms = model.described(words).withColumn("rank", place("topic_id", "weight")).where(F.col("rank") <= words).select("topic_id", "rank", "term")
    return doc_topics, terms
