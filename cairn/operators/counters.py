"""Counters that never fall below zero, replayed from their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def replayed(deltas: DataFrame, keys: list[str], order: list[str], delta: str, bucket: str) -> DataFrame:
    """(keys, count): each counter after all its changes in order, held at zero whenever it would fall below.

    The held sum is the plain sum less the lowest prefix sum, if that is below zero. Prefix sums run
    within buckets of the order (``bucket`` must not fall as the order rises), then over the buckets of a key.
    """
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    part = deltas.withColumn("_p", F.sum(delta).over(inside)).groupBy(*keys, bucket).agg(F.sum(delta).alias("_s"), F.min("_p").alias("_low"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    part = part.withColumn("_low", F.col("_low") + F.coalesce(F.sum("_s").over(before), F.lit(0)))
    return part.groupBy(*keys).agg((F.sum("_s") - F.least(F.min("_low"), F.lit(0))).cast("bigint").alias("count"))
