"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans.registry import Catalog
from cairn.streaming import jobs

C = Catalog()


@C.query("SELECT time_bucket(INTERVAL 60 MINUTES, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_r5_tumbling(spark, d):
    """Events by hour and type, counted batch by batch and summed over the batches."""
    parts = jobs.run_batches(spark, jobs.stream(spark, d, "events"), "hours", lambda b, _: b.groupBy(F.window("ts", "60 minutes").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n")))
    return parts.groupBy("start", "event_type").agg(F.sum("n").alias("n"))


@C.query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_r2_once(spark, d):
    """Events delivered once, by key within the watermark."""
    return jobs.run(spark, jobs.once(jobs.stream(spark, d, "events"), ["event_id"]), "once").select("event_id", "user_id", "event_type")


@C.query(f"""WITH d AS (SELECT DISTINCT memory_id, chunk_id, updated, vector IS NULL AS failed FROM stored_vector WHERE memory_id IS NOT NULL AND updated IS NOT NULL), q AS (SELECT memory_id, count(*) FILTER (failed) AS attempts, count(*) FILTER (NOT failed) AS done, max(updated) FILTER (failed) AS last FROM d GROUP BY 1),
 s AS (SELECT memory_id, attempts, last, CASE WHEN done > 0 THEN 'done' WHEN attempts >= {jobs.ATTEMPTS} THEN 'dead' ELSE 'waiting' END AS state FROM q)
 SELECT memory_id, attempts, state, CASE WHEN state = 'waiting' THEN last + least({jobs.BACKOFF_MOST}, {jobs.BACKOFF} * pow(2, attempts - 1))::BIGINT END AS next_at, CASE WHEN state = 'waiting' THEN last + {jobs.HOLD} END AS held_until FROM s""")
def stream_r1_outbox(spark, d):
    """The work of embedding as a queue: a row without a vector is a failed attempt, one with a vector ends the work; what failed waits ever longer and dies after some attempts."""
    rows = jobs.stream(spark, d, "stored_vector").where("memory_id IS NOT NULL AND updated IS NOT NULL")
    tries = jobs.run_batches(spark, rows, "outbox", lambda b, _: b.select("memory_id", "chunk_id", "updated", F.col("vector").isNull().alias("failed")).distinct())
    return jobs.queue_states(tries.distinct(), "memory_id", "updated", "failed")


QUERIES, ORACLES = C.queries, C.oracles
