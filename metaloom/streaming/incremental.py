"""Incremental runs on Structured Streaming: new records are processed once, late ones within a watermark, results appended or updated."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, folder: str, schema, files_a_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def once(events: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Events without repeats of a key that come within ``late`` of each other; state older than that is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed(events: DataFrame, time: str, late: str, length: str, slide: str | None, by: list[str]) -> DataFrame:
    """(start, end, by..., n, total) over tumbling or sliding windows of event time."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    g = events.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time: str, late: str, gap: str, by: list[str]) -> DataFrame:
    """(start, end, by..., n) of sessions that end after ``gap`` without an event."""
    g = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def append_unseen(stream: DataFrame, target: str, key: list[str], checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Starts a query that appends ``work`` of each batch's records whose key the target lacks, as a resumed run skips what is there."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        new = df.dropDuplicates(key)
        try:
            have = spark.read.parquet(target).select(*key)
            new = new.join(have, key, "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch finds no target
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        work(new).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(result: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream gives for all that is there now: ``complete`` results are the last batch's, ``append`` ones those of all batches.

    Results and the stream's state go to the folder that driver and executors share (spark.checkpoint.dir, or a temporary
    one on a local master), so a run that is lost resumes from its checkpoint.
    """
    spark = result.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='metaloom-stream-')}"
    path = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def batch(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    result.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/out")
