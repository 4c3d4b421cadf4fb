"""Readers for the inputs: pages, news, feeds, logs, word lists, judgements, settings."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

NEWS = "source string, pubDate string, title string, description string, fullDoc string, content string, link string"
MESSAGE = "title string, description string, link string, author string, guid string, pubDate string, publisher string"
FEED = f"title string, link string, description string, language string, copyright string, pubDate string, url string, publisher string, entries array<struct<{MESSAGE.replace(' string', ':string')}>>"


def documents(df: DataFrame) -> DataFrame:
    """documents(doc_id, text) as doc_id, title (the first line) and body (the rest)."""
    line = F.instr("text", "\n")
    title = F.when(line > 0, F.substring(F.col("text"), F.lit(1), line - 1)).otherwise(F.col("text"))
    return df.select("doc_id", title.alias("title"), F.when(line > 0, F.substring(F.col("text"), line + 1, F.length("text"))).otherwise("").alias("body"))


def directory(spark: SparkSession, path: str) -> DataFrame:
    """name and text of every file that is not hidden; doc_id by name, so it is the same on every machine."""
    files = spark.read.option("wholetext", "true").text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
    return files.select((F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("doc_id"), "name", "text")


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_text(html: Column) -> Column:
    """The page without head matter, scripts, styles, navigation, footers, comments and tags; white space is single."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|title|noscript)[^>]*>.*?</(script|style|nav|footer|title|noscript)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


class _Blocks(HTMLParser):
    """Blocks of text with how much of each is links."""

    SKIP, BREAK = {"script", "style", "nav", "footer", "noscript", "title"}, {"p", "div", "article", "section", "li", "ul", "td", "tr", "table", "h1", "h2", "h3", "br", "body"}

    def __init__(self) -> None:
        super().__init__()
        self.skipped, self.link, self.blocks = 0, 0, [["", 0]]

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in self.SKIP
        self.link += tag == "a"
        if tag in self.BREAK:
            self.blocks.append(["", 0])

    def handle_endtag(self, tag):
        self.skipped -= tag in self.SKIP and self.skipped > 0
        self.link -= tag == "a" and self.link > 0
        if tag in self.BREAK:
            self.blocks.append(["", 0])

    def handle_data(self, data):
        if not self.skipped:
            self.blocks[-1][0] += data
            self.blocks[-1][1] += len(data.split()) if self.link else 0


def main_text_of(html: str, words: int = 5, links: float = 0.4) -> str:
    parser = _Blocks()
    parser.feed(html)
    return "\n".join(" ".join(t.split()) for t, n in parser.blocks if len(t.split()) >= words and n <= links * len(t.split()))


@pandas_udf(T.StringType())
def main_text(html: pd.Series) -> pd.Series:
    """The blocks with enough words and few links."""
    return html.map(lambda h: None if h is None else main_text_of(h))


def news(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.schema(NEWS).json(path)
    return lines.select("source", "pubDate", F.coalesce("title", F.lit("")).alias("title"), F.concat_ws(" ", "description", "content").alias("body"), "link")


def view_log(lines: DataFrame) -> DataFrame:
    """value(language article views), other lines skipped: article, views, line (its place in the files)."""
    parts = F.split("value", " ")
    rows = lines.select("value", parts.alias("p"), (F.col("line") if "line" in lines.columns else F.monotonically_increasing_id()).alias("line"))
    return rows.where((F.size("p") == 3) & F.get("p", F.lit(2)).rlike("^[0-9]+$")).select(F.get("p", F.lit(1)).alias("article"), F.get("p", F.lit(2)).cast("long").alias("views"), "line")


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of RSS files; inner mark-up of descriptions is flattened."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "description", "link", "author", "guid", "pubDate")])
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return items.withColumn("description", page_text(F.col("description")))


def rss_sources(lines: DataFrame) -> DataFrame:
    """value and line: url and publisher, which the last line that starts with # names; blank and // lines are skipped."""
    name = F.when(F.col("value").startswith("#"), F.trim(F.regexp_replace("value", "^#+", "")))
    # A list of sources is a short file, read as one run.
    filled = lines.withColumn("publisher", F.last(name, ignorenulls=True).over(Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    return filled.where(~F.col("value").rlike(r"^\s*(#|//|$)")).select(F.trim("value").alias("url"), "publisher", "line")


def feed_messages(spark: SparkSession, path: str) -> DataFrame:
    feeds = spark.read.schema(FEED).json(path)
    return feeds.select(F.col("publisher").alias("feed_publisher"), F.explode("entries").alias("m")).select("feed_publisher", "m.*").withColumn("publisher", F.coalesce("publisher", "feed_publisher")).drop("feed_publisher")


def doc_topics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema="n string, doc_id string, topic_id int, proportion double").drop("n")


def topic_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="topic_id int, weight double, terms string").select("topic_id", "terms")


def misspellings(lines: DataFrame) -> DataFrame:
    """value and line: wrong, right; a line $word is right for the lines after it."""
    right = F.when(F.col("value").startswith("$"), F.expr("substr(value, 2)"))
    filled = lines.withColumn("right", F.last(right, ignorenulls=True).over(Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    return filled.where(~F.col("value").startswith("$") & (F.trim("value") != "")).select(F.trim("value").alias("wrong"), "right")


def words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").rlike("^[a-zA-Z]+$")).select(F.col("value").alias("term"))


def spelling_tests(spark: SparkSession, path: str) -> DataFrame:
    """'right': 'wrong wrong' pairs of whole files: wrong, right."""
    whole = spark.read.option("wholetext", "true").text(path)
    pair = r"'([^']+)':\s*'([^']*)'"
    both = F.arrays_zip(F.regexp_extract_all("value", F.lit(pair), F.lit(1)).alias("right"), F.regexp_extract_all("value", F.lit(pair), F.lit(2)).alias("wrongs"))
    return whole.select(F.explode(both).alias("x")).select("x.right", F.explode(F.split("x.wrongs", r"\s+")).alias("wrong")).where("wrong <> ''").select("wrong", "right")


def judgements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="query string, doc_id long, grade string")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """value and line of one text file, in order."""
    whole = spark.read.option("wholetext", "true").text(path)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def settings(text: str, required: tuple[str, ...] = ()) -> dict[str, str]:
    """key: value lines; # starts a comment, and every required key must be there."""
    out = {}
    for line in text.splitlines():
        if (line := line.strip()) and not line.startswith("#"):
            if not (m := re.match(r"([^:]+?)\s*:\s*(.*)$", line)):
                raise ValueError(f"no setting: {line!r}")
            out[m[1]] = m[2]
    if missing := [k for k in required if k not in out]:
        raise ValueError(f"settings are missing: {', '.join(missing)}")
    return out
