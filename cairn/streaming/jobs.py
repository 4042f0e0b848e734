"""Structured Streaming forms of the incremental operators, run to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import fresh_path


#: Of a work queue: attempts until work is dead, seconds that claimed work is held, and seconds of waiting after the first failure and at most.
ATTEMPTS, HOLD, BACKOFF, BACKOFF_MOST = 5, 60, 2, 300


def queue_states(tries: DataFrame, key: str, at: str, failed: str) -> DataFrame:
    """(key, attempts, state, next_at, held_until) from attempts (key, at, failed), each once: done after a success, dead after ATTEMPTS failures, else waiting.

    Waiting work may be tried again after a time that doubles with each failure, and whoever claims it holds it HOLD seconds.
    """
    q = tries.groupBy(key).agg(F.count(F.when(F.col(failed), 1)).alias("attempts"), F.count(F.when(~F.col(failed), 1)).alias("_done"), F.max(F.when(F.col(failed), F.col(at))).alias("_last"))
    state = F.when(F.col("_done") > 0, "done").when(F.col("attempts") >= ATTEMPTS, "dead").otherwise("waiting")
    wait = F.least(F.lit(BACKOFF_MOST), BACKOFF * F.pow(F.lit(2.0), F.col("attempts") - 1)).cast("bigint")
    waiting = state == "waiting"
    return q.select(key, "attempts", state.alias("state"), F.when(waiting, F.col("_last") + wait).alias("next_at"), F.when(waiting, F.col("_last") + HOLD).alias("held_until"))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def run(spark: SparkSession, streamed: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Writes an appending stream until its sources are read, and returns what it wrote."""
    out, state = fresh_path(spark, label), fresh_path(spark, f"{label}-state")
    streamed.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.schema(streamed.schema).parquet(out)


def run_batches(spark: SparkSession, streamed: DataFrame, label: str, each: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Applies ``each`` to every micro-batch; a batch is written under its number, so a repeat replaces it."""
    out, state = fresh_path(spark, label), fresh_path(spark, f"{label}-state")
    shape: list = []

    def write(batch: DataFrame, number: int) -> None:
        done = each(batch, number)
        shape[:] = [done.schema]
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")

    streamed.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def tumbling(events: DataFrame, minutes: int = 60, late: str = "1 day") -> DataFrame:
    """Counts and sums by type and window; the watermark bounds the state."""
    w = F.window("ts", f"{minutes} minutes")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """The first of repeated events within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
