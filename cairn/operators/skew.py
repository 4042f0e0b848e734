"""Joins that keep whole results when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys are treated as hot, which bounds what is broadcast.
MAX_HOT_KEYS = 1000
#: A key is hot from this share of all rows on; with the bound above it follows that 1 / 1000 is the least useful share.
HOT_SHARE = 1.0 / MAX_HOT_KEYS
#: Below so many rows of one key a task is not worth splitting.
HOT_ROWS = 20_000
#: Parts into which a salted join splits a hot key.
SALTS = 64


def hot_keys(left: DataFrame, key: str, share: float = HOT_SHARE, least: int = HOT_ROWS) -> list:
    """The keys that hold at least ``share`` of the rows and ``least`` rows: at most 1 / share of them, null not counted.

    Counting pre-aggregates before its shuffle. The list is bounded by arithmetic, not by the data.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.where(F.col("_n") >= least).orderBy(F.desc("_n"), key).limit(max(1, round(1 / share)))
    return [r[0] for r in counts.collect()]


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """Joins left to right, which has at most one row for each key, without one task per hot key.

    Rows of hot keys meet a broadcast of the few right rows that these keys can have (at most
    ``MAX_HOT_KEYS``), all others a shuffled join. Null keys match nothing and are kept by a left join.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.where(F.col(key).isin(hot)))
    return left.where(is_hot).join(few, key, how).unionByName(left.where(~is_hot).join(right, key, how))


def salted_lookup(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Joins left to right, which has at most one row for each key, in one pass over left.

    The right rows of the hot keys, at most ``MAX_HOT_KEYS``, are repeated ``salts`` times, and each left
    row of such a key meets one of them by its own hash. For a left side that is dear to compute twice.
    Null keys match nothing. A column named ``_salt`` clashes.
    """
    is_hot = lambda: F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    spread = left.withColumn("_salt", F.when(is_hot(), F.pmod(F.xxhash64(*[c for c, t in left.dtypes if not t.startswith("map")]), F.lit(salts)).cast("int")).otherwise(0))
    repeated = right.withColumn("_salt", F.explode(F.when(is_hot(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return spread.join(repeated, [key, "_salt"], how).drop("_salt")
