"""Readers and sinks: captures of adapters, archives, conversation exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def captures(df: DataFrame, source: str, external_id: str, text: str, order: str) -> DataFrame:
    """Candidates of an adapter, one for each (source, external id): the first in order. Rows without an id are kept."""
    named = df.where(F.col(external_id).isNotNull())
    rest = [c for c in df.columns if c not in (source, external_id)]
    first = named.groupBy(source, external_id).agg(F.min_by(F.struct(*rest), F.struct(order, text)).alias("_r")).select(source, external_id, "_r.*")
    return first.select(df.columns).unionByName(df.where(F.col(external_id).isNull()))


def write_archive(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table as lines of JSON below path, and a manifest of their rows, which is returned."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        rows.append((name, spark.read.text(f"{path}/{name}").count(), df.schema.json()))
    manifest = spark.createDataFrame(rows, "entity STRING, rows BIGINT, layout STRING")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def read_archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an archive with the types that its manifest states."""
    import json

    from pyspark.sql.types import StructType

    manifest = spark.read.schema("entity STRING, rows BIGINT, layout STRING").json(f"{path}/manifest").collect()
    return {r["entity"]: spark.read.schema(StructType.fromJson(json.loads(r["layout"]))).json(f"{path}/{r['entity']}") for r in manifest}


def conversation_turns(turns: DataFrame, conversation: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The turns of a conversation in order, from first to last inclusive; gaps stay gaps."""
    return turns_between(turns.where(F.col("conv_id") == conversation), first, last).orderBy("turn")


def turns_between(turns: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """The turns of all conversations from first to last inclusive, all of them without a bound; gaps stay gaps."""
    if first is not None and last is not None and first > last:
        raise ValueError("the first turn comes after the last")
    found = turns if first is None else turns.where(F.col("turn") >= first)
    return found if last is None else found.where(F.col("turn") <= last)
