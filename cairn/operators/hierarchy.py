"""Parent-child links to full hierarchies by pointer doubling.

Each node points at its parent. In each round a node whose pointer has not ended takes over its pointer's
own pointer and adds the steps, so distances double. Nodes leave the rounds as soon as their pointer
ends. A round in which nothing ends proves that only loops are left: of an open chain some node ends in
every round, since the nodes above it lie at all smaller distances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.skew import hot_keys, lookup
from cairn.session import materialise

LOOP = "cycle"


def resolve(spark: SparkSession, links: DataFrame, with_path: bool = False) -> DataFrame:
    """(id, root_id, depth[, path]) of each id in links (id, parent_id): the last id reached upwards and the steps to it.

    ``path`` holds the ids from the root down to the id. Ids whose way up runs into a loop, on it or
    before it, get root_id 'cycle', depth -1 and no path. Rows without an id or a parent are left out;
    repeated rows count once; of several parents of one id the least counts. A parent without a row is
    a root. Empty links give an empty result.
    """
    links = links.where(F.col("id").isNotNull() & F.col("parent_id").isNotNull()).groupBy("id").agg(F.min("parent_id").alias("up"))
    carried = ["path"] if with_path else []
    active = links.withColumn("depth", F.lit(1).cast("bigint"))
    if with_path:
        active = active.withColumn("path", F.array("up"))  # from the pointer down to above the id
    active = materialise(spark, active, "links")
    ended, left = [], active.count()
    while left:
        table = active.withColumn("open", F.lit(True))
        for part in ended:
            table = table.unionByName(part.withColumn("open", F.lit(False)))
        above = table.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), "open", *[F.col(c).alias("above") for c in carried])
        moved = lookup(active, above, "up", hot=hot_keys(active, "up"))
        path = [F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("above", "path")).alias("path")] if with_path else []
        moved = moved.select("id", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), *path, F.coalesce("open", F.lit(False)).alias("open"))
        moved = materialise(spark, moved, "links", ["open"])
        ended.append(moved.where("not open").drop("open"))
        active, before = moved.where("open").drop("open"), left
        left = active.count()
        if left == before:
            break
    looped = active.select("id", F.lit(LOOP).alias("root_id"), F.lit(-1).cast("bigint").alias("depth"), *[F.lit(None).cast("array<string>").alias(c) for c in carried])
    for part in ended:
        own = [F.concat("path", F.array("id")).alias("path")] if with_path else []
        looped = looped.unionByName(part.select("id", F.col("up").alias("root_id"), "depth", *own))
    return looped


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance): each id below each of its ancestors, from the paths of ``resolve``. Ids in or below loops have none."""
    each = paths.where(F.col("path").isNotNull()).select("id", "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return each.where(F.col("at") < F.col("depth")).select("ancestor_id", "id", (F.col("depth") - F.col("at")).alias("distance"))
