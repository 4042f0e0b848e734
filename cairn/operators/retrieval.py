"""Retrieval: exact cosine top-k, BM25, fusion of ranks, token budgets, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import vectors as V

#: Our defaults, where no source fixes a value.
K1, B, RANK_CONSTANT = 1.2, 0.75, 60
#: The deepest rank that a measure of evaluation looks at.
DEEPEST = 20


def top_k(rows: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, score): the k rows most like the query, by cosine, then key; the score is rounded. Rows without a direction are left out.

    The query is a literal and every partition keeps its k best, so nothing else is moved.
    """
    scored = rows.where(F.size(vector) == len(query)).select(key, V.cosine_to(F.col(vector), query).alias("_raw")).where(F.col("_raw").isNotNull())
    best = scored.orderBy(F.desc("_raw"), key).limit(k)
    return best.select(key, F.round("_raw", 6).alias("score"))


def bm25(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, score) for a query. postings: (doc_id, word, n), one row a word of a document.

    Counts are over all documents that have words; each term of the query counts once.
    """
    lengths = postings.groupBy("doc_id").agg(F.sum("n").alias("len"))
    size = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean")).first()
    hit = postings.where(F.col("word").isin(terms))
    found = {r[0]: r[1] for r in hit.groupBy("word").count().collect()}  # one row a term of the query
    weight = F.lit(0.0)
    for term, df in found.items():
        weight = F.when(F.col("word") == term, float(_idf(size["docs"], df))).otherwise(weight)
    grown = F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("len") / float(size["mean"] or 1)))
    return hit.join(lengths, "doc_id").groupBy("doc_id").agg(F.round(F.sum(weight * grown), 6).alias("score"))


def bm25_each(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(query, doc_id, score) for each term as a query of its own. Counts are over all documents that have words."""
    lengths = postings.groupBy("doc_id").agg(F.sum("n").alias("len"))
    size = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean")).first()
    hit = postings.where(F.col("word").isin(terms))
    df = F.broadcast(hit.groupBy("word").agg(F.count(F.lit(1)).alias("df")))  # one row a term
    idf = F.log(1 + (F.lit(size["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    grown = F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("len") / float(size["mean"] or 1)))
    return hit.join(lengths, "doc_id").join(df, "word").select(F.col("word").alias("query"), "doc_id", F.round(idf * grown, 6).alias("score"))


def answered(scores: DataFrame, queries: int, most: int = DEEPEST) -> DataFrame:
    """One row (no_answer, truncated): the share of all queries that find nothing, and of those that find more than ``most``."""
    per = scores.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    share = lambda c: F.round(c / F.lit(float(queries)), 6)
    return per.agg(share(F.lit(queries) - F.count(F.lit(1))).alias("no_answer"), share(F.count(F.when(F.col("n") > most, 1))).alias("truncated"))


def _idf(docs: int, df: int) -> float:
    import math

    return math.log(1 + (docs - df + 0.5) / (df + 0.5))


def fused(channels: dict[str, DataFrame], weights: dict[str, float] | None = None, most: int = 100, digits: int | None = 8) -> DataFrame:
    """(doc_id, rank_<channel>.., score): reciprocal rank fusion of channels (doc_id, score), each cut to its ``most`` best.

    Ranks follow score descending, then doc_id. A document missing in a channel gets nothing from it.
    """
    out = None
    for name, channel in channels.items():
        best = channel.orderBy(F.desc("score"), "doc_id").limit(most)
        ranked = best.select("doc_id", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).alias(f"rank_{name}"))
        out = ranked if out is None else out.join(ranked, "doc_id", "full")
    parts = [F.coalesce((weights or {}).get(n, 1.0) / (RANK_CONSTANT + F.col(f"rank_{n}")), F.lit(0.0)) for n in channels]
    total: Column = parts[0]
    for p in parts[1:]:
        total = total + p
    return out.withColumn("score", total if digits is None else F.round(total, digits))


def packed(ranked: DataFrame, keys: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """The rows of each key in order as long as their sizes fit the budget; the first always stays."""
    w = W.partitionBy(*keys).orderBy(order)
    sums = ranked.withColumn("size", size).withColumn("total", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w))
    return sums.where((F.col("total") <= budget) | (F.col("rank") == 1))


def evaluated(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: recall at 5, 10, 20, precision at 5, mean reciprocal rank and nDCG at 10.

    ranked: (query, doc_id, rank from 1); relevant: (query, doc_id). Queries without a relevant document don't count.
    """
    truth = relevant.distinct()
    hits = ranked.join(truth, ["query", "doc_id"], "left_semi")
    per = truth.groupBy("query").agg(F.count(F.lit(1)).alias("n")).join(
        hits.groupBy("query").agg(*[F.sum((F.col("rank") <= k).cast("int")).alias(f"h{k}") for k in (5, 10, 20)], F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg")), "query", "left").fillna(0)
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return per.agg(*[mean(F.col(f"h{k}") / F.col("n"), f"recall_{k}") for k in (5, 10, 20)], mean(F.col("h5") / 5, "precision_5"), mean(F.when(F.col("first") > 0, 1 / F.col("first")).otherwise(0.0), "mrr"), mean(F.col("dcg") / best, "ndcg_10"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Percentiles by nearest rank of each key, over counts of distinct values instead of a list of all."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*keys)
    upto = counts.withColumn("upto", F.sum("n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    return upto.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * p / 100), F.col(value))).alias(f"p{p}") for p in percents])


def freshest(groups: DataFrame, newest: str, name: str, most: int) -> DataFrame:
    """The ``most`` groups with the latest ``newest``, ties by name, and ``truncated``: whether there are more. One group more is looked at."""
    best = groups.orderBy(F.desc(newest), name).limit(most + 1)
    place = F.row_number().over(W.orderBy(F.desc(newest), name))  # most + 1 rows
    return best.withColumns({"_n": place, "truncated": F.count(F.lit(1)).over(W.partitionBy()) > most}).where(F.col("_n") <= most).drop("_n")
