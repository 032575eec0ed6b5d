"""The batch steps over a stream of files: each micro-batch of new books is checked or rewritten like a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import checks
from ..sources import files as fl


def books(spark: SparkSession, folder: str, pattern: str = "*.[sS][fF][mM]", per_trigger: int = 200) -> DataFrame:
    """A stream of (path, name, is_utf8, content) of the files that come to a folder; those there already come first."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)
    return fl.decoded(files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("content").alias("raw")))


def each_batch(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append step(batch) as Parquet, a folder for each batch, which a batch that is run again replaces."""

    def handle(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def verify(stream: DataFrame, dims_books: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Issues of each batch of books."""
    return each_batch(stream, lambda b: checks.verify(b.select("path", "content", "is_utf8"), dims_books), out, checkpoint, once)


def word_counts(stream: DataFrame) -> DataFrame:
    """A running (word, n) over all files so far, for a complete-mode sink."""
    words = stream.select(F.explode(F.split("content", r"[ \t\n\r\f\x0B]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def events_by_window(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n) of a stream of events with a watermark: rows later than that are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
