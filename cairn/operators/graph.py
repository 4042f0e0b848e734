"""Walks over derivations and mentions of listed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def walked(edges: DataFrame, fan_out: int) -> DataFrame:
    """(id, other, step, path): what lies one or two steps of derivation from each record, in either direction, with the way to it.

    edges: memory_id, parent_id. Of a node's neighbours only the first ``fan_out`` by id are walked to, the
    bound that the walk is defined with; it is applied before anything is joined, so a node with very many
    neighbours costs no more. The shortest way counts, of equal ones the least; nobody is reached from itself.
    """
    pairs = edges.where("memory_id IS NOT NULL AND parent_id IS NOT NULL AND memory_id <> parent_id").select("memory_id", "parent_id")
    both = pairs.select(F.col("memory_id").alias("id"), F.col("parent_id").alias("other")).unionByName(pairs.select(F.col("parent_id").alias("id"), F.col("memory_id").alias("other"))).distinct()
    near = both.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("other"))).where(F.col("_n") <= fan_out).drop("_n")
    one = near.withColumns({"step": F.lit(1), "path": F.concat_ws("/", "id", "other")})
    two = near.select("id", F.col("other").alias("mid")).join(near.select(F.col("id").alias("mid"), "other"), "mid").where("id <> other")
    two = two.select("id", "other", F.lit(2).alias("step"), F.concat_ws("/", "id", "mid", "other").alias("path"))
    return one.unionByName(two).groupBy("id", "other").agg(F.min(F.struct("step", "path")).alias("way")).select("id", "other", "way.step", "way.path")


def spans(text: Column, names: list[str]) -> Column:
    """ARRAY<STRUCT<name, position>> of whole listed names in a text in order, the longest at each place, in lower case; positions count from 1.

    A name is whole if no letter, digit or mark touches it. names: a fixed list; without any the array is empty.
    """
    if not names:
        return F.array().cast("array<struct<name: string, position: int>>")
    listed = "|".join(r"\Q" + n + r"\E" for n in sorted({n.lower() for n in names}, key=lambda n: (-len(n), n)))
    whole = rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{listed})(?![\p{{L}}\p{{M}}\p{{N}}])"
    low = F.lower(text)
    found = F.regexp_extract_all(low, F.lit(whole), F.lit(0))
    parts = F.slice(F.split(low, whole), 1, F.size(found))  # what stands before each of them
    empty = F.array().cast("array<struct<name: string, position: int>>")
    last = lambda done: F.when(F.size(done) == 0, 1).otherwise(F.element_at(done, -1)["position"] + F.length(F.element_at(done, -1)["name"]))
    return F.aggregate(F.zip_with(parts, found, lambda before, name: F.struct(before.alias("before"), name.alias("name"))), empty, lambda done, p: F.array_append(done, F.struct(p["name"].alias("name"), (last(done) + F.length(p["before"])).alias("position"))))


def entities(found: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, name, mentions, position) from (doc_id, found): the first ``most`` entities of each text by first place, mentions descending and name; the bound is the feature."""
    each = found.select("doc_id", F.explode("found").alias("f")).groupBy("doc_id", F.col("f.name").alias("name")).agg(F.count(F.lit(1)).alias("mentions"), F.min("f.position").alias("position"))
    order = W.partitionBy("doc_id").orderBy("position", F.desc("mentions"), "name")
    return each.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
