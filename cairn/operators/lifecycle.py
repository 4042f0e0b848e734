"""Lifecycle of records as rewrites: replacements, corrections, expiry in batches, use, new fingerprints, erasure with what derives from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import hierarchy


def numbered(rows: DataFrame, keys: list[str], coarse: Column, order: list[str]) -> DataFrame:
    """Adds ``number``: the place of each row among those of its keys, from 1.

    ``coarse`` parts the rows of a key and must rise with the order; places are counted within a part, after
    the rows of the parts before, so a key that holds a third of all rows is no single task.
    """
    parted = rows.withColumn("_part", coarse)
    sizes = parted.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))
    return parted.withColumn("_place", inside).join(sizes, [*keys, "_part"]).withColumn("number", F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


def superseded(spark: SparkSession, records: DataFrame) -> DataFrame:
    """(id, successor, problem, new_status) of each record that is to be replaced.

    records: id, scope_id, status, superseded_by. A record may not replace itself, be replaced by an unknown
    record or one of another scope, by an erased one, or so that a loop closes; then its status stays.
    """
    asked = records.where(F.col("superseded_by").isNotNull())
    target = records.select(F.col("id").alias("superseded_by"), F.col("scope_id").alias("_scope"), F.col("status").alias("_state"))
    looped = hierarchy.resolve(spark, asked.select("id", F.col("superseded_by").alias("parent_id"))).where("depth < 0").select("id", F.lit(True).alias("_loop"))
    out = asked.join(target, "superseded_by", "left").join(looped, "id", "left")
    problem = F.when(F.col("id") == F.col("superseded_by"), "self").when(F.col("_scope").isNull(), "unknown_target").when(F.col("_scope") != F.col("scope_id"), "other_scope").when(F.col("_state") == "erased", "erased_target").when(F.col("_loop"), "cycle")
    return out.select("id", F.col("superseded_by").alias("successor"), problem.alias("problem"), F.when(problem.isNull(), "superseded").otherwise(F.col("status")).alias("new_status"))


def corrected(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(correction_id, id, problem, wins) of each correction and record that it derives from; corrections from nothing have a null id.

    records: id, scope_id, kind, actor, trust, created; edges: memory_id, parent_id. A correction must derive
    from a record of its scope, and an agent's may not be an instruction. Of a record's valid corrections the
    last by (created, id) wins.
    """
    own = records.where("kind = 'correction'").select(F.col("id").alias("correction_id"), "scope_id", "actor", "trust", "created")
    pairs = own.join(edges.select(F.col("memory_id").alias("correction_id"), F.col("parent_id").alias("id")).distinct(), "correction_id", "left")
    pairs = pairs.join(records.select("id", F.col("scope_id").alias("_scope")), "id", "left")
    problem = F.when(F.col("id").isNull(), "unfounded").when((F.col("actor") == "agent") & (F.col("trust") == "instruction"), "agent_instruction").when(F.col("_scope").isNull(), "unknown_target").when(F.col("_scope") != F.col("scope_id"), "other_scope")
    pairs = pairs.withColumn("problem", problem)
    last = pairs.where(F.col("problem").isNull()).groupBy("id").agg(F.max(F.struct("created", "correction_id"))["correction_id"].alias("_last"))
    return pairs.join(last, "id", "left").select("correction_id", "id", "problem", F.coalesce((F.col("correction_id") == F.col("_last")) & F.col("problem").isNull(), F.lit(False)).alias("wins"))


def due(records: DataFrame, valid_until: Column, now: Column, most: int) -> DataFrame:
    """(scope_id, id, valid_until, number, more): of each scope the first ``most`` active records whose time is over, by (valid_until, id), and whether others wait.

    ``most`` is the size of a batch, from 1 to 500. One row more is ranked than is taken, and the rank is
    limited before the shuffle.
    """
    if not 1 <= most <= 500:
        raise ValueError("a batch holds 1 to 500 records")
    over = records.withColumn("valid_until", valid_until).where((F.col("status") == "active") & (F.col("valid_until") <= now))
    ranked = over.select("scope_id", "id", "valid_until").withColumn("number", F.row_number().over(W.partitionBy("scope_id").orderBy("valid_until", "id"))).where(F.col("number") <= most + 1)
    more = F.max(F.col("number")).over(W.partitionBy("scope_id")) > most
    return ranked.withColumn("more", more).where(F.col("number") <= most)


def used(records: DataFrame, uses: DataFrame) -> DataFrame:
    """records with ``uses`` raised by the number of their uses (id, at) and ``last_used`` set to the last of them."""
    per = uses.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    return records.join(per, "id", "left").withColumns({"uses": F.col("uses") + F.coalesce("_n", F.lit(0)), "last_used": F.coalesce("_at", "last_used")}).drop("_n", "_at")


def swept(erased: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(id, one count for each part): how many rows of each part, tables with an ``id`` of the record that they derive from, go or are marked with each erased record."""
    out = erased.select("id").distinct()
    for name, part in parts.items():
        held = part.join(out.select("id"), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias(name))
        out = out.join(held, "id", "left")
    return out.fillna(0, list(parts))


def receipts(records: DataFrame, size: int) -> DataFrame:
    """(scope_id, batch, records, bytes, first_id, last_id): what an erasure of each whole scope does, batch by batch of ``size`` records in order of id; a batch can be resumed after its last id."""
    placed = numbered(records.select("scope_id", "id", "bytes"), ["scope_id"], F.substring("id", 1, 6), ["id"])
    return placed.withColumn("batch", F.floor((F.col("number") - 1) / size)).groupBy("scope_id", "batch").agg(F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
