"""The pN_ queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.llm import mixing, pieces, privacy, sentences, tokens, vectors
from cairn.session import materialise, table


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "memory_record").select(F.col("id").alias("memory_id"), F.col("body.text").alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memory_id of each text that comes out in more than one piece."""
    cut = pieces.split_oversized(_bodies(spark, sf_dir), "text", ["memory_id"])
    return cut.where("pieces_total > 1").select("memory_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text, each repeated row once."""
    return pieces.split_oversized(_bodies(spark, sf_dir), "text", ["memory_id"]).distinct()


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The usable rows, each chunk once, and the rows before repeats are left out."""
    given, models = table(spark, sf_dir, "stored_vector"), table(spark, sf_dir, "model_revision")
    return vectors.usable(given, models), vectors.of_width(given, models)


def _near_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, given = _vectors(spark, sf_dir)
    return vectors.near_classes(spark, rows, 0.95, given)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of one revision whose cosine is at least 0.95: pairs of classes of equal vectors, and the members of each class."""
    pairs, members = _near_classes(spark, sf_dir)
    copies = members.where("chunk_id <> class_id")
    copied = copies.unionByName(copies.select(F.col("class_id").alias("chunk_id"), "class_id").distinct())
    side = lambda name: copied.select(F.col("class_id").alias(f"class_{name}"), F.col("chunk_id").alias(f"chunk_{name}"))
    across = pairs.join(side("a"), "class_a", "left").join(side("b"), "class_b", "left").select(F.coalesce("chunk_a", "class_a").alias("a"), F.coalesce("chunk_b", "class_b").alias("b"))
    within = copied.select("class_id", F.col("chunk_id").alias("a")).join(copied.select("class_id", F.col("chunk_id").alias("b")), "class_id").where("a < b").select("a", "b")
    return across.unionByName(within).select(F.least("a", "b").alias("chunk_id_a"), F.greatest("a", "b").alias("chunk_id_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable chunk with its class of equal vectors and the number of other classes with a cosine of at least 0.95."""
    pairs, members = _near_classes(spark, sf_dir)
    links = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return members.join(links, "class_id", "left").select("chunk_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def p3_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar chunks of each chunk whose id (its hexadecimal end) is divisible by 20, against all rows."""
    rows, given = _vectors(spark, sf_dir)
    number = F.conv(F.regexp_extract("chunk_id", "([0-9a-f]{1,15})$", 1), 16, 10).try_cast("bigint")
    return vectors.neighbours(spark, rows, given=given, queries=F.coalesce(number % 20 == 0, F.lit(False)))


#: Words of a shingle, and the share of shingles in common from which texts confirm that records are near duplicates.
SHINGLE, ALIKE = 5, 0.8


def _shingles(words: Column) -> Column:
    """The distinct runs of SHINGLE words; of fewer words all of them as one run, of none none."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, SHINGLE)))
    return F.when(F.size(words) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def confirmed(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(memory_a, memory_b, alike) of the pairs whose records have one scope and kind and whose texts have at least ALIKE of their shingles in common.

    pairs: (memory_a, memory_b), once each; records: id, scope_id, kind, text. Null and empty texts confirm nothing.
    """
    held = records.select("id", "scope_id", "kind", "text")
    asked = pairs.select(F.explode(F.array("memory_a", "memory_b")).alias("id")).distinct()
    worded = held.join(asked, "id", "left_semi").select("id", F.struct("scope_id", "kind").alias("place"), X.words(F.coalesce("text", F.lit(""))).alias("words"))
    cut = worded.select("id", "place", _shingles(F.col("words")).alias("runs"))
    both = pairs.join(cut.select(F.col("id").alias("memory_a"), F.col("place").alias("pa"), F.col("runs").alias("ra")), "memory_a").join(cut.select(F.col("id").alias("memory_b"), F.col("place").alias("pb"), F.col("runs").alias("rb")), "memory_b")
    alike = F.size(F.array_intersect("ra", "rb")) / F.nullif(F.size(F.array_union("ra", "rb")), F.lit(0))
    return both.where(F.col("pa") == F.col("pb")).select("memory_a", "memory_b", F.round(alike, 6).alias("alike")).where(F.col("alike") >= ALIKE)


def join_j10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active records of one scope and kind that are near duplicates by a chunk's vectors, confirmed by their texts."""
    chunks = p3_found(spark, sf_dir)
    of = table(spark, sf_dir, "stored_vector").where("memory_id IS NOT NULL").groupBy("chunk_id").agg(F.max_by("memory_id", F.struct("updated", "memory_id")).alias("memory_id"))
    side = lambda name: of.select(F.col("chunk_id").alias(f"chunk_id_{name}"), F.col("memory_id").alias(f"m{name}"))
    pairs = chunks.join(side("a"), "chunk_id_a").join(side("b"), "chunk_id_b").where("ma <> mb").select(F.least("ma", "mb").alias("memory_a"), F.greatest("ma", "mb").alias("memory_b")).distinct()
    m = table(spark, sf_dir, "memory_record").where("status.state = 'active'").select("id", "scope_id", "kind", F.col("body.text").alias("text")).dropDuplicates(["id"])
    return confirmed(materialise(spark, pairs, "pairs"), m)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memory_id, kind and start of each piece of personal data, once per id."""
    found = privacy.spans(spark, _bodies(spark, sf_dir), table(spark, sf_dir, "name_list"))
    each = found.select("memory_id", F.explode("spans").alias("s"))
    return each.select("memory_id", F.col("s.kind").alias("kind"), F.col("s.start").cast("bigint").alias("char_start")).distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with placeholders in place of personal data, each repeated row once."""
    return privacy.redact(privacy.spans(spark, _bodies(spark, sf_dir), table(spark, sf_dir, "name_list"), with_text=True)).distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every document."""
    return tokens.encode_corpus(spark, table(spark, sf_dir, "documents"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = tokens.count_tokens(spark, docs)
    keyed = docs.select("doc_id", "source", mixing.sampling_key(F.col("doc_id"), mixing.quality_weight(F.col("text"))).alias("sample_key"))
    return materialise(spark, keyed.join(counted, "doc_id", "left").fillna(0, ["tokens"]), "sized")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used so that the sources near their target shares."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    docs, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_target")
    return mixing.shares(mixing.mix(docs, targets), docs, targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and start of every sentence unit."""
    return sentences.split(spark, table(spark, sf_dir, "documents"), with_text=False)


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence unit with its place and text."""
    return sentences.split(spark, table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p3_found, p3_classes, p3_top10, join_j10_near_duplicates, p5_found, p5_redacted, p8_ids, p9_mix, p9_shares, p10_found, p10_sentences)}

ORACLES = {
    "p2_found": "SELECT DISTINCT id AS memory_id FROM memory_record WHERE octet_length(encode(body.text)) > 2048",
}
