"""Where results go: Parquet, text, JSON lines, TSV, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import server_url

HTML_ROW = '<li><a href="{url}">{title}</a> <small>{score}</small></li>'


def tables(frames: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    for name, df in frames.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def text_lines(lines: DataFrame, path: str, append: bool = False) -> None:
    lines.write.mode("append" if append else "overwrite").text(path)


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=sep)


def model_lines(docs: DataFrame) -> DataFrame:
    """doc_id, title and description as the topic model's input lines: number, label X, text."""
    return docs.select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.lit("X"), F.regexp_replace(F.concat_ws(" ", "title", "description"), r"\s+", " ")).alias("value"))


def result_line() -> Column:
    """docid, title, score, link rank and views, tab-separated."""
    return F.concat_ws("\t", F.col("doc_id").cast("string"), "title", F.col("score").cast("string"), F.col("page_rank").cast("string"), F.col("num_views").cast("string"))


def as_text(results: DataFrame) -> DataFrame:
    return results.select(result_line().alias("line"))


def as_json(results: DataFrame, query: str, corrected: str | None = None) -> DataFrame:
    """One row: the response with its results in order, a status and the corrected query."""
    row = F.struct(F.col("rank"), F.struct("doc_id", "title", server_url(F.coalesce("url", F.lit(""))).alias("url"), "score", "page_rank", "num_views").alias("r"))
    listed = results.agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"]).alias("results"))
    status = F.struct(F.lit(0).alias("StatusCode"), F.lit("OK").alias("Message"))
    right = F.struct(F.lit(corrected is None).alias("isCorrect"), F.lit(corrected or query).alias("query"))
    return listed.select(F.to_json(F.struct(F.lit(query).alias("queryText"), "results", status.alias("status"), right.alias("correctedQuery"))).alias("json"))


def as_html(results: DataFrame, template: str, mark: str = "{{results}}") -> DataFrame:
    """One row: the template with the rows in place of the mark; texts are escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    line = F.lit(HTML_ROW)
    for name, value in (("{url}", safe(F.coalesce("url", F.lit("")))), ("{title}", safe(F.coalesce("title", F.lit("")))), ("{score}", F.format_number("score", 4))):
        line = F.replace(line, F.lit(name), value)
    listed = results.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("html")))), lambda x: x["html"]), "\n").alias("rows"))
    return listed.select(F.replace(F.lit(template), F.lit(mark), F.col("rows")).alias("html"))
