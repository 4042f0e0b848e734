"""Sources mixed to target shares of tokens, by weighted sampling without replacement.

Each document gets an exponential key, scaled by its quality weight (Efraimidis and Spirakis): sorted by
key, the documents of a source are a weighted sample of every size. A source first gives as many complete
epochs as its budget holds, then the documents in key order whose prefix sum of tokens stays in the rest.
Prefix sums run over buckets of keys, so a source that holds most rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of keys for each doubling of the key. Exponential keys of any weight spread over several doublings, so no bucket
#: holds more than about 1 in 500 of the rows of one weight; keys of 53 random bits and weights from 0.05 span 62 doublings.
BUCKETS = 128
SEED = 42


def quality_weight(text: Column) -> Column:
    """The share of letters among a text's characters, from 0.05 to 1; null and empty texts have the least."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", ""))
    return F.coalesce(F.greatest(F.lit(0.05), letters / F.nullif(F.length(text), F.lit(0))), F.lit(0.05))


def sampling_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of the id: the same for every run and partitioning."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def plan(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, budget, epochs, rest) of each target source.

    The budget is the share of the tokens of all docs, those without a target included. A source without
    documents has no epochs and no rest.
    """
    total = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    have = docs.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("available"))
    each = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("bigint").alias("max_repeats"))
    each = each.join(have, "source", "left").fillna(0, ["available"])
    each = each.withColumn("budget", F.col("target_share") * F.lit(total))
    whole = F.when(F.col("available") > 0, F.least("max_repeats", F.floor(F.col("budget") / F.col("available")))).otherwise(0)
    each = each.withColumn("epochs", whole.cast("bigint"))
    rest = F.when((F.col("epochs") < F.col("max_repeats")) & (F.col("available") > 0), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0.0)
    return each.withColumn("rest", rest)


def mix(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document is used; unused ones are left out.

    docs has doc_id, source, tokens and sample_key; targets source, target_share and max_repeats.
    Documents without a source or a target are not used, nor are those without tokens. In the fractional
    part a document counts if the middle of its tokens lies in the rest. Ties of keys go by doc_id.
    Rows must be unique by doc_id. No docs or no targets give an empty result.
    """
    sources = F.broadcast(plan(docs, targets))
    used = docs.where(F.col("tokens") > 0).select("doc_id", "source", "tokens", "sample_key").join(sources, "source")
    used = used.withColumn("bucket", F.floor(F.log2("sample_key") * BUCKETS).cast("int"))
    sums = used.groupBy("source", "bucket").agg(F.sum("tokens").alias("held"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("source", "bucket").orderBy("sample_key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    used = used.join(F.broadcast(sums), ["source", "bucket"])  # at most 62 * BUCKETS rows for each target source
    middle = F.col("before") + F.sum("tokens").over(inside) - F.col("tokens") / 2
    used = used.withColumn("copies", F.col("epochs") + F.when(middle <= F.col("rest"), 1).otherwise(0))
    return used.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def shares(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, budget, used, reached_share): what each source contributes.

    ``reached_share`` is of the tokens of all docs, like the target; 0 tokens at all give null.
    """
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"))
    total = docs.agg(F.sum("tokens")).first()[0]
    each = plan(docs, targets).join(used, "source", "left").fillna(0, ["used"])
    share = F.col("used") / F.lit(total) if total else F.lit(None).cast("double")
    return each.select("source", "target_share", "max_repeats", "available", F.round("budget", 3).alias("budget"), "used", F.round(share, 6).alias("reached_share"))
