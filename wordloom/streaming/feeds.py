"""Feeds as streams: new items once, counts by day, and sources by table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PERIOD = "2 hours"


def files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_batch: int = 100) -> DataFrame:
    """New files of a folder (or one file) as a stream, at most per_batch of them at once."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.load(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).load(folder)


def new_items(items: DataFrame, key: list[str], time: str = "ts", late: str = "30 days") -> DataFrame:
    """Each key once within the watermark; its state is dropped after that, so it stays bounded."""
    return items.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def daily_counts(items: DataFrame, by: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Items per day and value of `by`."""
    counted = items.withWatermark(time, late).groupBy(F.window(time, "1 day"), by).count()
    return counted.select(F.col("window.start").alias("day"), by, F.col("count").alias("n"))


def ingest(items: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, period: str | None = PERIOD) -> StreamingQuery:
    """Run a stream into write(batch, number), every period, or with None once through all there is."""
    out = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=period) if period else out.trigger(availableNow=True)).start()


def to_table(items: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream once through all there is, into Parquet files (append) or one file set that each batch replaces (complete)."""
    if mode == "append":
        return items.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    replace = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    return items.writeStream.outputMode(mode).foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
