"""Queries over claims: history, validation, authority, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import claims, instants
from cairn.plans.registry import Catalog
from cairn.session import materialise, table

C = Catalog()
#: The instant of knowledge, and the span of valid time that is asked for.
KNOWN = "2025-12-31 00:00:00"
ASKED = (1764547200, 1764547201)

H = """h AS (SELECT claim_id, scope_id, subject_namespace, subject_kind, subject_key, predicate_namespace, predicate_name, predicate_version, slot_key, tx_seq, min(recorded_at) AS recorded_at, any_value(source_seq) AS source_seq, any_value(authority) AS authority, any_value(sourcing) AS sourcing,
 any_value(admission) AS admission, any_value(supersession) AS supersession, any_value(erased) AS erased, any_value(origin_erased) AS origin_erased, any_value(claim) AS claim FROM claim_history GROUP BY ALL)"""


def history(spark: SparkSession, d: str, where: str | None = None) -> DataFrame:
    """claim_history without repeats: one row for each entry, known from its first delivery; of the deliveries that ``where`` admits."""
    h = table(spark, d, "claim_history")
    h = h if where is None else h.where(where)
    key = ["claim_id", "scope_id", "subject_namespace", "subject_kind", "subject_key", "predicate_namespace", "predicate_name", "predicate_version", "slot_key", "tx_seq"]
    rest = ["source_seq", "authority", "sourcing", "admission", "supersession", "erased", "origin_erased", "claim"]
    return h.groupBy(*key).agg(F.min("recorded_at").alias("recorded_at"), *[F.first(c, True).alias(c) for c in rest])


@C.query(f"WITH {H}, r AS (SELECT DISTINCT scope_id, from_claim_id AS claim_id FROM claim_relation), x AS (SELECT DISTINCT scope_id, target_claim_id AS claim_id FROM claim_retraction) SELECT h.scope_id, h.claim_id, h.tx_seq, r.claim_id IS NOT NULL AS relates, x.claim_id IS NOT NULL AS retracted FROM h LEFT JOIN r ON r.scope_id = h.scope_id AND r.claim_id = h.claim_id LEFT JOIN x ON x.scope_id = h.scope_id AND x.claim_id = h.claim_id WHERE h.recorded_at <= TIMESTAMP '{KNOWN}'")
def scan_s7_history(spark, d):
    """The claim history up to an instant of knowledge, with whether each claim relates to another or is retracted."""
    r = table(spark, d, "claim_relation").select("scope_id", F.col("from_claim_id").alias("claim_id")).distinct().withColumn("relates", F.lit(True))
    x = table(spark, d, "claim_retraction").select("scope_id", F.col("target_claim_id").alias("claim_id")).distinct().withColumn("retracted", F.lit(True))
    h = history(spark, d, f"recorded_at <= TIMESTAMP '{KNOWN}'").join(r, ["scope_id", "claim_id"], "left").join(x, ["scope_id", "claim_id"], "left")
    return h.select("scope_id", "claim_id", "tx_seq", F.coalesce("relates", F.lit(False)).alias("relates"), F.coalesce("retracted", F.lit(False)).alias("retracted"))


@C.query(f"WITH {H} SELECT claim_id, tx_seq, CASE WHEN erased = 1 THEN '' ELSE subject_key END AS subject_key, CASE WHEN erased = 1 THEN NULL ELSE claim END AS claim, origin_erased = 1 AS origin_erased FROM h")
def scan_s8_l12_tombstones(spark, d):
    """Claims with erased ones blanked."""
    gone = F.col("erased") == 1
    return history(spark, d).select("claim_id", "tx_seq", F.when(gone, "").otherwise(F.col("subject_key")).alias("subject_key"), F.when(~gone, F.col("claim")).alias("claim"), (F.col("origin_erased") == 1).alias("origin_erased"))


@C.query(f"WITH {H} SELECT predicate_namespace, predicate_name, max(predicate_version) AS version, min(subject_kind) AS kind, count(*) AS claims FROM h GROUP BY 1, 2")
def scan_s9_registry(spark, d):
    """The predicates in use."""
    return history(spark, d).groupBy("predicate_namespace", "predicate_name").agg(F.max("predicate_version").alias("version"), F.min("subject_kind").alias("kind"), F.count(F.lit(1)).alias("claims"))


@C.query("WITH a AS (SELECT scope_id, tx_seq FROM claim_history UNION ALL SELECT scope_id, tx_seq FROM claim_relation UNION ALL SELECT scope_id, tx_seq FROM claim_retraction) SELECT scope_id, max(tx_seq) AS high_water, max(tx_seq) + 1 AS next_seq, count(DISTINCT tx_seq) AS entries, max(tx_seq) - min(tx_seq) + 1 - count(DISTINCT tx_seq) AS gaps FROM a GROUP BY 1")
def agg_a7_a8_high_water(spark, d):
    """The high-water mark of each scope over all three feeds, the next sequence and the gaps."""
    a = None
    for t in ("claim_history", "claim_relation", "claim_retraction"):
        part = table(spark, d, t).select("scope_id", "tx_seq")
        a = part if a is None else a.unionByName(part)
    a = a.distinct()
    return a.groupBy("scope_id").agg(F.max("tx_seq").alias("high_water"), (F.max("tx_seq") + 1).alias("next_seq"), F.count(F.lit(1)).alias("entries"), (F.max("tx_seq") - F.min("tx_seq") + 1 - F.count(F.lit(1))).alias("gaps"))


def _valued(h: DataFrame) -> DataFrame:
    return h.withColumns({"value_type": F.get_json_object("claim", "$.value.type"), "stance": F.get_json_object("claim", "$.stance"), "value": F.get_json_object("claim", "$.value")})


_V = f"{H}, v AS (SELECT *, json_extract_string(claim, '$.value.type') AS value_type, json_extract_string(claim, '$.stance') AS stance FROM h)"


@C.query(f"WITH {_V}, r AS (SELECT predicate_namespace, predicate_name, max(predicate_version) AS pv, min(subject_kind) AS kind, mode(value_type) AS val, bool_or(slot_key IS NOT NULL) AS slotted FROM v GROUP BY 1, 2) SELECT claim_id, tx_seq, CASE WHEN predicate_version <> pv THEN 'wrong_version' WHEN subject_kind <> kind THEN 'wrong_subject' WHEN value_type IS NULL THEN 'no_value' WHEN value_type <> val THEN 'wrong_value' WHEN slot_key IS NOT NULL AND NOT slotted THEN 'slot_not_allowed' WHEN stance NOT IN ('asserted', 'denied', 'conditional', 'requested', 'confirmed', 'estimated', 'expected', 'observed') THEN 'unknown_stance' END AS problem FROM v JOIN r USING (predicate_namespace, predicate_name)")
def gate_c1_c20_validate(spark, d):
    """The first check that each claim fails against the registry in use."""
    v = _valued(history(spark, d))
    r = v.groupBy("predicate_namespace", "predicate_name").agg(F.max("predicate_version").alias("version"), F.min("subject_kind").alias("kind"), F.mode("value_type").alias("value"), F.max(F.col("slot_key").isNotNull()).alias("slotted"))
    return claims.validated(v, r).select("claim_id", "tx_seq", "problem")


@C.query(f"WITH {H} SELECT claim_id, tx_seq, CASE sourcing WHEN 'user' THEN least(4, lv) WHEN 'seed' THEN least(1, lv) ELSE least(1, lv) END AS earned FROM (SELECT *, CASE authority WHEN 'inferred' THEN 0 WHEN 'extracted' THEN 1 WHEN 'verified' THEN 2 WHEN 'user_asserted' THEN 3 WHEN 'user_corrected' THEN 4 END AS lv FROM h)")
def gate_c8_earned(spark, d):
    """The authority that each claim's evidence earns, by its sourcing."""
    kind = F.when(F.col("sourcing") == "user", "user_statement").when(F.col("sourcing") == "seed", "seed").otherwise("source_span")
    evidence = F.array(F.struct(kind.alias("kind"), F.col("authority").alias("level")))
    return history(spark, d).select("claim_id", "tx_seq", claims.earned(evidence).alias("earned"))


_L = "CASE {} WHEN 'inferred' THEN 0 WHEN 'extracted' THEN 1 WHEN 'verified' THEN 2 WHEN 'user_asserted' THEN 3 WHEN 'user_corrected' THEN 4 END"


@C.query(f"WITH {H}, k AS (SELECT DISTINCT ON (claim_id) * FROM h ORDER BY claim_id, tx_seq), r AS (SELECT DISTINCT from_claim_id, to_id, relation_kind, authority FROM claim_relation) SELECT r.from_claim_id, r.to_id, r.relation_kind, CASE WHEN t.claim_id IS NULL THEN 'unknown_target' WHEN t.scope_id <> f.scope_id THEN 'cross_scope' WHEN r.relation_kind = 'supersedes' AND f.sourcing = 'user' AND t.sourcing = 'supplier' THEN 'user_supersedes_supplier' WHEN {_L.format('t.authority')} > {_L.format('r.authority')} THEN 'outranked' END AS problem FROM r LEFT JOIN k f ON f.claim_id = r.from_claim_id LEFT JOIN k t ON t.claim_id = r.to_id")
def gate_c9_relations(spark, d):
    """Relations against their targets: unknown, of another scope, user over supplier, or outranked."""
    k = history(spark, d).groupBy("claim_id").agg(F.min_by(F.struct("scope_id", "sourcing", "authority"), "tx_seq").alias("k"))
    r = table(spark, d, "claim_relation").select("from_claim_id", "to_id", "relation_kind", "authority").distinct()
    r = r.join(k.select(F.col("claim_id").alias("from_claim_id"), F.col("k").alias("f")), "from_claim_id", "left").join(k.select(F.col("claim_id").alias("to_id"), F.col("k").alias("t")), "to_id", "left")
    problem = F.when(F.col("t").isNull(), "unknown_target").when(F.col("t.scope_id") != F.col("f.scope_id"), "cross_scope")
    problem = problem.when((F.col("relation_kind") == "supersedes") & (F.col("f.sourcing") == "user") & (F.col("t.sourcing") == "supplier"), "user_supersedes_supplier").when(claims.rank(F.col("t.authority")) > claims.rank(F.col("authority")), "outranked")
    return r.select("from_claim_id", "to_id", "relation_kind", problem.alias("problem"))


@C.query(f"WITH {H} SELECT admission, sourcing, count(*) AS claims, count(DISTINCT claim_id) AS ids, min(tx_seq) AS first_seq FROM h GROUP BY 1, 2")
def agg_v7_ledger(spark, d):
    """Admitted claims by policy and sourcing."""
    return history(spark, d).groupBy("admission", "sourcing").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("claim_id").alias("ids"), F.min("tx_seq").alias("first_seq"))


@C.query(f"WITH {H} SELECT claim_id, count(*) AS versions, count(DISTINCT (scope_id, subject_key, predicate_name, slot_key)) AS slots, min(tx_seq) AS first_seq, max(tx_seq) AS last_seq FROM h GROUP BY 1 HAVING count(*) > 1")
def check_history_rewrites(spark, d):
    """Claim ids written more than once, and in how many slots."""
    return history(spark, d).groupBy("claim_id").agg(F.count(F.lit(1)).alias("versions"), F.count_distinct(F.struct("scope_id", "subject_key", "predicate_name", "slot_key")).alias("slots"), F.min("tx_seq").alias("first_seq"), F.max("tx_seq").alias("last_seq")).where("versions > 1")


_SLOT = ", ".join(claims.SLOT)


@C.query(f"WITH {_V}, o AS (SELECT {_SLOT}, count(DISTINCT json_extract_string(claim, '$.value')) AS vals, count(*) AS claims, min(claim_id) AS first_claim, max(claim_id) AS last_claim FROM v WHERE claim IS NOT NULL GROUP BY ALL) SELECT * FROM o WHERE vals > 1")
def join_j7_w5_conflicts(spark, d):
    """Slots whose claims differ in value, by aggregation over the slot instead of pairs."""
    v = _valued(history(spark, d)).where("claim IS NOT NULL")
    return v.groupBy(*claims.SLOT).agg(F.count_distinct("value").alias("vals"), F.count(F.lit(1)).alias("claims"), F.min("claim_id").alias("first_claim"), F.max("claim_id").alias("last_claim")).where("vals > 1")


def _latest(spark: SparkSession, h: DataFrame) -> DataFrame:
    """The last entry of each claim within the bound of knowledge, with its windows as plain columns."""
    known = F.col("recorded_at") <= F.lit(KNOWN).cast("timestamp")
    kept = [*claims.SLOT, "value", "authority", "sourcing", "source_seq", "supersession", "valid", "source_low", "source_high"]
    last = _valued(h.where(known)).groupBy("claim_id").agg(F.max_by(F.struct(*kept), "tx_seq").alias("c")).select("claim_id", "c.*")
    return materialise(spark, last.select("*", "valid.*").drop("valid").withColumnRenamed("supersession", "rule"), "claims")


def _corrections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    known = f"recorded_at <= TIMESTAMP '{KNOWN}'"
    r = table(spark, d, "claim_relation").where(f"{known} AND relation_kind = 'supersedes'").select(F.col("from_claim_id").alias("from_id"), "to_id", "authority")
    return r, table(spark, d, "claim_retraction").where(known).select(F.col("target_claim_id").alias("claim_id"))


@C.query(f"""WITH {_V}, c AS (SELECT DISTINCT ON (claim_id) *, json_extract_string(claim, '$.value') AS val, {_L.format('authority')} AS rk, floor(epoch(recorded_at))::BIGINT AS low FROM v WHERE recorded_at <= TIMESTAMP '{KNOWN}' ORDER BY claim_id, tx_seq DESC),
 x AS (SELECT DISTINCT target_claim_id AS claim_id FROM claim_retraction WHERE recorded_at <= TIMESTAMP '{KNOWN}'),
 a AS (SELECT *, low <= {ASKED[0]} AS covers, claim_id IN (SELECT claim_id FROM x) AS gone FROM c),
 act AS (SELECT * FROM a WHERE covers AND NOT gone),
 rep AS (SELECT DISTINCT r.to_id FROM claim_relation r JOIN act f ON f.claim_id = r.from_claim_id JOIN act t ON t.claim_id = r.to_id WHERE r.relation_kind = 'supersedes' AND r.recorded_at <= TIMESTAMP '{KNOWN}' AND {_L.format('r.authority')} >= t.rk),
 l1 AS (SELECT *, bool_or(sourcing = 'user') OVER w AND bool_or(sourcing = 'supplier') OVER w AND (min(coalesce(val, '')) OVER w <> max(coalesce(val, '')) OVER w) AS open, max(rk) OVER w AS top FROM act WHERE claim_id NOT IN (SELECT to_id FROM rep) WINDOW w AS (PARTITION BY {_SLOT})),
 l2 AS (SELECT *, first_value(supersession) OVER (PARTITION BY {_SLOT} ORDER BY claim_id) AS rule0, max(source_seq) OVER (PARTITION BY {_SLOT}) AS seq FROM l1 WHERE open OR rk = top),
 f AS (SELECT {_SLOT}, count(DISTINCT val) AS vals, min(val) AS value, string_agg(claim_id, ',' ORDER BY claim_id) AS claims FROM l2 WHERE open OR rule0 <> 'by_source_order' OR source_seq IS NULL OR source_seq = seq GROUP BY ALL),
 s AS (SELECT {_SLOT}, bool_or(covers) AS cov, bool_or(covers AND NOT gone) AS live FROM a GROUP BY ALL)
 SELECT s.scope_id, s.subject_key, s.predicate_name, s.slot_key, CASE WHEN NOT cov THEN 'absent' WHEN NOT live THEN 'retracted' WHEN vals > 1 THEN 'conflicted' ELSE 'value' END AS state, coalesce(claims, '') AS claims FROM s LEFT JOIN f ON f.scope_id = s.scope_id AND f.subject_namespace = s.subject_namespace AND f.subject_kind = s.subject_kind AND f.subject_key = s.subject_key AND f.predicate_namespace = s.predicate_namespace AND f.predicate_name = s.predicate_name AND f.predicate_version = s.predicate_version AND f.slot_key IS NOT DISTINCT FROM s.slot_key""")
def projection_recorded(spark, d):
    """The current view of all slots, with claims valid from their recording on, ordered by source sequence alone."""
    low = F.unix_seconds("recorded_at")
    none = F.lit(None).cast("bigint")
    h = history(spark, d).withColumns({"valid": claims.from_then_on(F.struct(low.alias("definite_low"), low.alias("possible_low"))), "source_low": none, "source_high": none})
    view = claims.project(_latest(spark, h), *_corrections(spark, d), *ASKED)
    return view.select("scope_id", "subject_key", "predicate_name", "slot_key", "state", F.array_join("claims", ",").alias("claims"))


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """The latest entries with the windows of their written times: dated claims from their valid time on, undated ones always."""
    system = F.col("provenance.source.system")
    h = table(spark, d, "claim_history").where(f"recorded_at <= TIMESTAMP '{KNOWN}'").withColumn("system", system)
    for value, out in (("valid_time", "valid_at"), ("source_time", "source_at")):
        h = instants.windows(spark, h, value, "system", table(spark, d, "source_system"), table(spark, d, "zone_abbrev"), out)
    always = F.struct(*[F.lit(x).alias(n) for n, x in (("definite_low", claims.LEAST), ("definite_high", claims.MOST), ("possible_low", claims.LEAST), ("possible_high", claims.MOST))])
    h = h.withColumn("valid", F.when(F.col("valid_time").isNull(), always).otherwise(claims.from_then_on(F.col("valid_at"))))
    h = h.withColumns({"source_low": F.col("source_at.possible_low"), "source_high": F.col("source_at.possible_high")})
    key = ["claim_id", *claims.SLOT, "tx_seq"]
    once = h.groupBy(*key).agg(F.min("recorded_at").alias("recorded_at"), *[F.first(c, True).alias(c) for c in ("valid", "source_low", "source_high", "source_seq", "authority", "sourcing", "supersession", "claim")])
    return _latest(spark, once)


@C.query()
def projection_windows(spark, d):
    """The windows of all written valid times: definite and possible, in seconds."""
    h = table(spark, d, "claim_history").select("scope_id", "tx_seq", "valid_time", F.col("provenance.source.system").alias("system")).where("valid_time IS NOT NULL").distinct()
    found = instants.windows(spark, h, "valid_time", "system", table(spark, d, "source_system"), table(spark, d, "zone_abbrev"), "w")
    return found.where("w IS NOT NULL").select("scope_id", "tx_seq", "w.*").distinct()


@C.query()
def projection_valid_time(spark, d):
    """The current view by the windows of the written valid times: unusable ones cover nothing, floating ones are only possible."""
    view = claims.project(_dated(spark, d), *_corrections(spark, d), *ASKED)
    return view.select("scope_id", "subject_key", "predicate_name", "slot_key", "state", "certainty", F.array_join("claims", ",").alias("claims"))


@C.query()
def projection_conflicts(spark, d):
    """For each conflicted slot of that view the pairs of claims to be settled, one claim a value."""
    _, left = claims.remaining(_dated(spark, d), *_corrections(spark, d), *ASKED)
    return claims.conflicts(left).select("scope_id", "subject_key", "predicate_name", "slot_key", "left_claim", "right_claim")


@C.query()
def projection_digest(spark, d):
    """One row that tells the current view by valid times from any other."""
    return claims.digest(claims.project(_dated(spark, d), *_corrections(spark, d), *ASKED))


@C.query(f"WITH {H}, w AS (SELECT scope_id, subject_key, predicate_name, slot_key, tx_seq, claim_id, sourcing, lag(sourcing) OVER (PARTITION BY scope_id, subject_key, predicate_name, slot_key ORDER BY tx_seq) AS before FROM h), t AS (SELECT *, sum((before <> sourcing)::INT) OVER (PARTITION BY scope_id, subject_key, predicate_name, slot_key ORDER BY tx_seq)::BIGINT AS token FROM w) SELECT scope_id, subject_key, predicate_name, tx_seq, claim_id, sourcing, before, token FROM t WHERE before <> sourcing")
def window_x22_takeover(spark, d):
    """Claims at which the sourcing of a slot changes hands, with a token that rises at takeovers alone."""
    w = W.partitionBy("scope_id", "subject_key", "predicate_name", "slot_key").orderBy("tx_seq")
    h = history(spark, d).withColumn("before", F.lag("sourcing").over(w))
    h = h.withColumn("token", F.sum((F.col("before") != F.col("sourcing")).cast("int")).over(w)).where("before <> sourcing")
    return h.select("scope_id", "subject_key", "predicate_name", "tx_seq", "claim_id", "sourcing", "before", "token")


QUERIES, ORACLES = C.queries, C.oracles
