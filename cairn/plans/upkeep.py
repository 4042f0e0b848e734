"""Queries of upkeep: counters, readiness, batches, edits, queues."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import counters
from cairn.plans.claims import H, history
from cairn.plans.records import M, NOW, memories
from cairn.plans.registry import Catalog
from cairn.session import table

C = Catalog()
_D = "d AS (SELECT scope_id, tx_seq, max(delta) AS delta FROM (SELECT scope_id, tx_seq, 1 AS delta FROM claim_history UNION ALL SELECT scope_id, tx_seq, -1 FROM claim_retraction) GROUP BY 1, 2)"


@C.query(f"WITH {_D}, p AS (SELECT scope_id, sum(delta) OVER (PARTITION BY scope_id ORDER BY tx_seq) AS s, sum(delta) OVER (PARTITION BY scope_id) AS total FROM d) SELECT scope_id, (max(total) - least(min(s), 0))::BIGINT AS count FROM p GROUP BY 1")
def agg_a2_counter(spark, d):
    """A counter of each scope, raised by writes and lowered by removals, never below zero."""
    h = table(spark, d, "claim_history").select("scope_id", "tx_seq", F.lit(1).alias("delta"))
    x = table(spark, d, "claim_retraction").select("scope_id", "tx_seq", F.lit(-1).alias("delta"))
    deltas = h.unionByName(x).groupBy("scope_id", "tx_seq").agg(F.max("delta").alias("delta")).withColumn("bucket", F.floor(F.col("tx_seq") / 1000))
    return counters.replayed(deltas, ["scope_id"], ["tx_seq"], "delta", "bucket")


@C.query(f"WITH {M} SELECT scope_id, count(*) FILTER (status = 'erased') AS erased, coalesce(sum(octet_length(encode(text))) FILTER (status = 'erased'), 0)::BIGINT AS bytes, max(updated) FILTER (status = 'erased') AS last FROM m GROUP BY 1")
def agg_a6_erasures(spark, d):
    """Totals of erasure by scope."""
    gone = F.col("status") == "erased"
    size = F.sum(F.when(gone, F.octet_length("text").cast("bigint")))
    return memories(spark, d).groupBy("scope_id").agg(F.count(F.when(gone, 1)).alias("erased"), F.coalesce(size, F.lit(0)).alias("bytes"), F.max(F.when(gone, F.col("updated"))).alias("last"))


@C.query(f"WITH {M} SELECT trust, kind, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT scope_id) AS scopes FROM m WHERE status = 'active' GROUP BY CUBE (trust, kind)")
def agg_a12_digest(spark, d):
    """Counts of active memories over trust and kind, with all totals."""
    m = memories(spark, d, "status = 'active'").select("trust", "kind", "source", "scope_id")
    return m.cube("trust", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("scope_id").alias("scopes"))


@C.query(f"WITH {M}, r AS (SELECT revision FROM model_revision WHERE active = 1), c AS (SELECT count(*) AS live, count(*) FILTER (id IN (SELECT memory_id FROM stored_vector WHERE model_revision IN (SELECT revision FROM r) AND vector IS NOT NULL)) AS done FROM m WHERE status = 'active'), q AS (SELECT count(DISTINCT memory_id) AS failed FROM stored_vector WHERE vector IS NULL) SELECT live, done, failed, CASE WHEN failed > 0 THEN 'dead_work' WHEN (SELECT count(*) FROM r) = 0 THEN 'no_active_model' WHEN done < live THEN 'incomplete' ELSE 'ready' END AS state FROM c, q")
def check_v1_readiness(spark, d):
    """Whether embeddings are ready: dead work before a missing model before incomplete coverage."""
    r = table(spark, d, "model_revision").where("active = 1").select(F.col("revision").alias("model_revision")).distinct()
    v = table(spark, d, "stored_vector")
    failed, models = v.where("vector IS NULL").select("memory_id").distinct().count(), r.count()
    done = v.where("vector IS NOT NULL").join(F.broadcast(r), "model_revision", "left_semi").select(F.col("memory_id").alias("id")).distinct().withColumn("_d", F.lit(1))
    live = memories(spark, d, "status = 'active'").select("id").join(done, "id", "left")
    state = F.when(F.lit(failed > 0), "dead_work").when(F.lit(models == 0), "no_active_model").when(F.col("done") < F.col("live"), "incomplete").otherwise("ready")
    return live.agg(F.count(F.lit(1)).alias("live"), F.count("_d").alias("done")).select("live", "done", F.lit(failed).cast("bigint").alias("failed"), state.alias("state"))


@C.query(f"WITH {M}, w AS (SELECT m.scope_id, m.id, row_number() OVER (PARTITION BY m.scope_id ORDER BY m.id) AS rank FROM m WHERE m.status = 'active' AND NOT EXISTS (SELECT 1 FROM stored_vector v JOIN model_revision r ON r.revision = v.model_revision AND r.active = 1 WHERE v.memory_id = m.id)) SELECT scope_id, count(*) FILTER (rank <= 3) AS batch, max(id) FILTER (rank <= 3) AS cursor, bool_or(rank > 3) AS more FROM w WHERE rank <= 4 GROUP BY 1")
def scan_v2_t3_batch(spark, d):
    """The next batch of 3 memories to embed in each scope, its cursor, and whether more follow (one row more is read)."""
    r = table(spark, d, "model_revision").where("active = 1").select(F.col("revision").alias("model_revision"))
    v = table(spark, d, "stored_vector").join(F.broadcast(r), "model_revision").select(F.col("memory_id").alias("id"))
    m = memories(spark, d, "status = 'active'").select("scope_id", "id").join(v, "id", "left_anti")
    ranked = m.withColumn("rank", F.row_number().over(W.partitionBy("scope_id").orderBy("id"))).where("rank <= 4")
    held = F.col("rank") <= 3
    return ranked.groupBy("scope_id").agg(F.count(F.when(held, 1)).alias("batch"), F.max(F.when(held, F.col("id"))).alias("cursor"), F.max(~held).alias("more"))


@C.query(f"WITH {M} SELECT id, CASE WHEN status = 'active' AND created + 31536000 <= {NOW} THEN 'expired' ELSE status END AS state, superseded_by FROM m")
def lifecycle_x13_edit(spark, d):
    """The status inside each nested record edited in place."""
    m = table(spark, d, "memory_record").dropDuplicates(["id"])
    due = (F.col("status.state") == "active") & (F.col("created") + 31536000 <= NOW)
    edited = m.withColumn("status", F.col("status").withField("state", F.when(due, "expired").otherwise(F.col("status.state"))))
    return edited.select("id", "status.state", "status.superseded_by")


@C.query(f"WITH {M}, s AS (SELECT id, list_filter(string_split(regexp_replace(text, '([.!?])[\\t\\n\\x0b\\f\\r ]|\\n', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s, ' ')) > 0) AS p FROM m WHERE octet_length(encode(text)) > 2048) SELECT id, unnest(p) AS piece, generate_subscripts(p, 1)::INT AS n FROM s")
def text_x19_atomize(spark, d):
    """Long memories as numbered plain sentences."""
    m = memories(spark, d).where(F.octet_length("text") > 2048)
    return m.select("id", F.posexplode(X.sentence_list(F.col("text"))).alias("p", "piece")).select("id", "piece", (F.col("p") + 1).alias("n"))


@C.query(f"WITH {M} SELECT id, status, created + 31536000 <= {NOW} AS overdue, last_used < {NOW} - 7776000 AS stale, uses = 0 AS unused FROM m WHERE status = 'active' AND (created + 31536000 <= {NOW} OR last_used < {NOW} - 7776000)")
def filter_x20_stale(spark, d):
    """Active memories that are overdue or have not been used for a quarter."""
    m = memories(spark, d, "status = 'active'").withColumns({"overdue": F.col("created") + 31536000 <= NOW, "stale": F.col("last_used") < NOW - 7776000, "unused": F.col("uses") == 0})
    return m.where("overdue OR stale").select("id", "status", "overdue", "stale", "unused")


@C.query(f"WITH {H} SELECT claim_id, tx_seq, CASE " + " ".join(f"WHEN regexp_matches(claim, '{p}') THEN '{n}'" for n, p in X.DETECTORS.items()) + f" ELSE coalesce(" + ", ".join("CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p in X.DETECTORS.items()) + " END" for c in ("slot_key", "subject_key")) + ") END AS detector FROM h WHERE claim IS NOT NULL")
def gate_c2_secrets(spark, d):
    """The first detector that finds a credential in each claim, its slot or its subject key."""
    found = F.coalesce(*[X.detected(F.col(c)) for c in ("claim", "slot_key", "subject_key")])
    return history(spark, d).where("claim IS NOT NULL").select("claim_id", "tx_seq", found.alias("detector"))


@C.query(f"WITH {H}, s AS (SELECT scope_id, subject_key, predicate_name, slot_key, count(DISTINCT sourcing) AS sides, bool_or(sourcing = 'user') AS has_user, bool_or(sourcing = 'seed') AS has_seed FROM h GROUP BY ALL) SELECT scope_id, subject_key, predicate_name, slot_key, CASE WHEN has_user THEN 'user' WHEN has_seed THEN 'seed' ELSE 'supplier' END AS sourcing, sides > 1 AS review FROM s")
def gate_c11_v14_review(spark, d):
    """The sourcing of each slot, and whether it goes to review because sides differ."""
    h = history(spark, d).groupBy("scope_id", "subject_key", "predicate_name", "slot_key").agg(F.count_distinct("sourcing").alias("sides"), F.max(F.col("sourcing") == "user").alias("u"), F.max(F.col("sourcing") == "seed").alias("s"))
    return h.select("scope_id", "subject_key", "predicate_name", "slot_key", F.when(F.col("u"), "user").when(F.col("s"), "seed").otherwise("supplier").alias("sourcing"), (F.col("sides") > 1).alias("review"))


QUERIES, ORACLES = C.queries, C.oracles
