"""Requests to a model on a stream: each answered once, degenerate answers asked for again hotter, all kept as state by request."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from metaloom.session import shared_folder

OUT = "key string, request string, asked long, attempt int, temperature double, answer string, sound boolean, cached boolean"
STATE = "attempt int, temperature double, answer string, sound boolean, asked long"


def key_of(*parts: Column) -> Column:
    """The name of a request: a hash of the prompt's fingerprint, the paper, the text, whatever else its answer hangs on."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def answered(requests: DataFrame, ask: Callable[[str, int, float], str], sound: Callable[[str], bool], most: int = 3, first: float = 0.0, rise: float = 0.1, top: float = 0.5) -> DataFrame:
    """OUT: the answer to each request of a stream (key, request) that has come so far, for every batch in which it comes.

    ``ask`` (request, attempt, temperature) is called until ``sound`` of its answer holds, ``most`` times at most, each time
    hotter by ``rise`` up to ``top``; the last answer stays. Attempt, temperature and answer are state by key: a
    key that comes again, in the same batch or later, is given the kept answer (``cached``) and not asked for again. A request whose
    last answer wasn't sound is asked for again where it comes anew, from where its temperature stood. ``asked`` counts the
    calls made for the key. The state is Spark's, committed with the batch: one that is run again starts from the state before it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        request = next(iter(frames))["request"].iloc[0]
        for _ in frames:
            pass
        attempt, heat, answer, good, asked = state.get if state.exists else (0, first, None, False, 0)
        cached, heat = bool(good), float(heat)
        if not good:
            if attempt:
                heat = min(round(heat + rise, 10), top)
            for attempt in range(1, most + 1):  # noqa: B007
                answer, asked = ask(request, asked + 1, heat), asked + 1
                good = bool(sound(answer))
                if good or attempt == most:
                    break
                heat = min(round(heat + rise, 10), top)
        state.update((int(attempt), heat, answer, good, int(asked)))
        yield pd.DataFrame({"key": [key[0]], "request": [request], "asked": [asked], "attempt": [attempt], "temperature": [heat], "answer": [answer], "sound": [good], "cached": [cached]})

    return requests.groupBy("key").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def written(answers: DataFrame, target: str, checkpoint: str):
    """Starts a query that writes each batch of ``answers`` to its own folder of ``target``, which a batch that is run again overwrites: each answer stands there once, whatever was lost in between."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={number:09d}")

    return answers.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The last answer to each key among the batches of ``target``."""
    found = spark.read.option("basePath", target).parquet(target)
    return found.groupBy("key").agg(F.max_by(F.struct("request", "asked", "attempt", "temperature", "answer", "sound"), "batch").alias("x"), F.sum(F.col("cached").cast("int")).alias("hits")).select("key", "x.*", "hits")


def drained(answers: DataFrame) -> DataFrame:
    """What the stream gives for all that is there now, by ``written`` and ``latest``, in the folder that driver and executors share."""
    spark = answers.sparkSession
    path = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    written(answers, f"{path}/out", f"{path}/state").awaitTermination()
    return latest(spark, f"{path}/out")
