"""The pN_ queries of the general data-processing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import asof, feed, hierarchy, instants
from cairn.session import materialise, table

CLAIM_KEYS = ["scope_id", "subject_key", "predicate_name", "slot_key"]


def _as_known_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, systems, abbreviations = (table(spark, sf_dir, t) for t in ("claim_history", "source_system", "zone_abbrev"))
    named = [c for c in CLAIM_KEYS if c != "slot_key"]
    held = history.where(F.col("valid_time").isNotNull()).dropna(subset=named)
    held = held.select(*CLAIM_KEYS, "tx_seq", "recorded_at", "valid_time", F.col("provenance.source.system").alias("system"))
    held = instants.normalise(spark, held, "valid_time", "system", systems, abbreviations, "valid_us")
    known = F.when(F.col("valid_us").isNotNull() & F.col("recorded_at").isNotNull(), F.greatest("valid_us", F.unix_micros("recorded_at")))
    log = materialise(spark, asof.change_log(held, CLAIM_KEYS, known, F.struct("valid_us", "tx_seq")), "changes")
    requests = table(spark, sf_dir, "recall_request").dropna(subset=[*named, "asked_at"])
    requests = requests.select("recall_id", *CLAIM_KEYS, F.unix_micros("asked_at").alias("asked_us")).distinct()
    return asof.as_known(requests, log, CLAIM_KEYS, "asked_us")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recall_id and tx_seq of the claim row in force and known when each request was asked.

    A copy delivered later changes nothing: it has the same state, known from a later instant.
    """
    found = _as_known_requests(spark, sf_dir).where(F.col("state").isNotNull())
    return found.select("recall_id", F.col("state.tx_seq").alias("tx_seq")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope_id, tx_seq, field_name, utc_us of each written time that names exactly one instant."""
    return instants.normalise_fields(spark, *(table(spark, sf_dir, t) for t in ("claim_history", "source_system", "zone_abbrev")))


def _claim_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.current_claims(feed.claim_feed(spark, *(table(spark, sf_dir, t) for t in ("claim_history", "claim_relation", "claim_retraction"))))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id of each claim present at the end of the feed."""
    return _claim_table(spark, sf_dir).select("claim_id").distinct()


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "memory_derivation").where("position = 0")
    return first.select(F.col("memory_id").alias("id"), "parent_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memory_id, root_id and depth of each memory that was derived from another."""
    return hierarchy.resolve(spark, _links(spark, sf_dir)).select(F.col("id").alias("memory_id"), "root_id", "depth")


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path (root first, joined by slashes), depth and root of each derived memory, with a mark for loops."""
    found = hierarchy.resolve(spark, _links(spark, sf_dir), with_path=True)
    return found.select(F.col("id").alias("memory_id"), F.array_join("path", "/").alias("path"), "root_id", "depth", (F.col("depth") < 0).alias("in_loop"))


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ancestor with each of its descendants and their distance."""
    found = hierarchy.descendants(hierarchy.resolve(spark, _links(spark, sf_dir), with_path=True))
    return found.select("ancestor_id", F.col("id").alias("memory_id"), "distance")


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p6_found, p7_found, p7_paths, p7_descendants)}

_UP = """WITH RECURSIVE l AS (SELECT memory_id AS id, min(parent_id) AS up FROM memory_derivation WHERE position = 0 GROUP BY 1),
 w AS (SELECT id, up AS root, 1::BIGINT AS depth, [up] AS path FROM l
 UNION ALL SELECT w.id, l.up, w.depth + 1, list_prepend(l.up, w.path) FROM w JOIN l ON l.id = w.root WHERE NOT list_contains(w.path, l.up)),
 e AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = w.root))"""

ORACLES = {
    "p6_found": """WITH e AS (SELECT scope_id, claim_id, tx_seq, TRUE AS present, any_value(subject_key) AS subject_key, any_value(predicate_name) AS predicate_name, any_value(predicate_version) AS predicate_version, any_value(slot_key) AS slot_key, any_value(supersession) AS supersession, any_value(source_seq) AS source_seq FROM claim_history GROUP BY 1, 2, 3
 UNION ALL SELECT scope_id, to_id, tx_seq, FALSE, NULL, NULL, NULL, NULL, NULL, NULL FROM claim_relation WHERE relation_kind = 'supersedes'
 UNION ALL SELECT scope_id, target_claim_id, tx_seq, FALSE, NULL, NULL, NULL, NULL, NULL, NULL FROM claim_retraction),
 n AS (SELECT *, row_number() OVER (PARTITION BY scope_id, claim_id ORDER BY tx_seq DESC) AS rn FROM e),
 p AS (SELECT *, row_number() OVER (PARTITION BY scope_id, subject_key, predicate_name, predicate_version, slot_key, supersession ORDER BY source_seq DESC NULLS LAST, tx_seq DESC, claim_id DESC) AS k FROM n WHERE rn = 1 AND present)
 SELECT DISTINCT claim_id FROM p WHERE k = 1 OR supersession IS DISTINCT FROM 'by_source_order'""",
    "p7_found": _UP + " SELECT l.id AS memory_id, coalesce(e.root, 'cycle') AS root_id, coalesce(e.depth, -1) AS depth FROM l LEFT JOIN e USING (id)",
    "p7_paths": _UP + " SELECT l.id AS memory_id, CASE WHEN e.id IS NOT NULL THEN array_to_string(list_append(e.path, l.id), '/') END AS path, coalesce(e.root, 'cycle') AS root_id, coalesce(e.depth, -1) AS depth, e.id IS NULL AS in_loop FROM l LEFT JOIN e USING (id)",
    "p7_descendants": _UP + " SELECT a AS ancestor_id, id AS memory_id, depth - (i - 1) AS distance FROM (SELECT id, depth, unnest(path) AS a, generate_subscripts(path, 1) AS i FROM e)",
}
