"""Attributes as known at event time: as-known snapshots by period, plus replay of the changes since.

A change is known from an instant on and carries an order; of the changes known at an event's time the
greatest counts. The change log is cut into periods. The state after each period is a running maximum
over per-period maxima (a few rows a key, whatever the number of changes), and an event meets only the
snapshot before its period and the changes within it. A key that holds a third of all rows is spread
over its periods, and nothing grows with the product of events and changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def change_log(changes: DataFrame, keys: list[str], known_us: Column, state: Column, period_us: int = DAY_US) -> DataFrame:
    """(keys, period, known_us, state): one row for each usable change. Rows whose time or state is null are never known."""
    log = changes.select(*keys, F.floor(known_us / F.lit(period_us)).cast("bigint").alias("period"), known_us.alias("known_us"), state.alias("state"))
    return log.where(F.col("known_us").isNotNull() & F.col("state").isNotNull())


def snapshots(log: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, period, state): for each distinct wanted (keys, period) the state known before that period; null if none."""
    sums = log.groupBy(*keys, "period").agg(F.max("state").alias("state"), F.lit(False).alias("asked"))
    asks = wanted.select(*keys, "period").distinct().withColumn("state", F.lit(None).cast(log.schema["state"].dataType)).withColumn("asked", F.lit(True))
    before = W.partitionBy(*keys).orderBy("period").rangeBetween(W.unboundedPreceding, -1)
    both = sums.select(*keys, "period", "state", "asked").unionByName(asks.select(*keys, "period", "state", "asked"))
    return both.withColumn("state", F.max("state").over(before)).where("asked").drop("asked")


def as_known(events: DataFrame, log: DataFrame, keys: list[str], at_us: str, period_us: int = DAY_US) -> DataFrame:
    """The events with ``state``: the greatest state of their keys known at ``at_us`` (equality counts), or null.

    Null keys equal null keys. Repeated events are kept as often as they come; ties between changes of
    one state are one state. An event without a time has no state. Empty inputs give empty or null
    results. Event columns keep their names; one named ``state`` is replaced.
    """
    whole = F.struct(*events.columns).alias("_event")
    period = F.floor(F.col(at_us) / F.lit(period_us)).cast("bigint").alias("period")
    asked = events.select(*keys, period, F.col(at_us).alias("_t"), whole)
    no_event = F.lit(None).cast(asked.schema["_event"].dataType).alias("_event")
    no_state = F.lit(None).cast(log.schema["state"].dataType).alias("state")
    base = snapshots(log, keys, asked.where(F.col("_t").isNotNull())).where(F.col("state").isNotNull())
    rows = log.select(*keys, "period", F.col("known_us").alias("_t"), F.lit(0).alias("_seq"), "state", no_event)
    rows = rows.unionByName(base.select(*keys, "period", (F.col("period") * period_us).alias("_t"), F.lit(0).alias("_seq"), "state", no_event))
    rows = rows.unionByName(asked.select(*keys, "period", "_t", F.lit(1).alias("_seq"), no_state, "_event"))
    replay = W.partitionBy(*keys, "period").orderBy("_t", "_seq").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("state", F.when(F.col("_t").isNotNull(), F.max("state").over(replay))).where("_seq = 1")
    return found.select(*[F.col(f"_event.{c}").alias(c) for c in events.columns if c != "state"], "state")
