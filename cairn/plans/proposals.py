"""Queries of claim proposals and registry changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import claims, records
from cairn.plans.claims import H, history
from cairn.plans.records import DENIED, E, M, edges, memories
from cairn.plans.registry import Catalog
from cairn.session import table

C = Catalog()

_R = f"{H}, r AS (SELECT predicate_namespace AS namespace, (year(recorded_at) * 4 + quarter(recorded_at))::INT AS version, list_distinct(list(predicate_name || '/' || slot)) AS kinds, list_distinct(list(vt)) AS vals FROM (SELECT *, coalesce(slot_key, '') AS slot, json_extract_string(claim, '$.value.type') AS vt FROM h WHERE claim IS NOT NULL) GROUP BY 1, 2)"


@C.query(f"WITH {_R} SELECT a.namespace, a.version, len(list_filter(b.kinds, lambda x: NOT list_contains(a.kinds, x)))::BIGINT AS lost_kinds, len(list_filter(b.vals, lambda x: NOT list_contains(a.vals, x)))::BIGINT AS lost_values FROM r a JOIN r b ON b.namespace = a.namespace AND b.version + 1 = a.version")
def gate_c21_evolution(spark, d):
    """What each quarter's use of a namespace drops of the quarter before, as a registry successor would be checked."""
    h = history(spark, d).where("claim IS NOT NULL")
    version = (F.year("recorded_at") * 4 + F.quarter("recorded_at")).cast("int")
    r = h.groupBy(F.col("predicate_namespace").alias("namespace"), version.alias("version")).agg(F.collect_set(F.concat("predicate_name", F.lit("/"), F.coalesce("slot_key", F.lit("")))).alias("kinds"), F.collect_set(F.get_json_object("claim", "$.value.type")).alias("values"))
    return claims.evolution_problems(r).select("namespace", "version", F.size("lost_kinds").cast("bigint").alias("lost_kinds"), F.size("lost_values").cast("bigint").alias("lost_values"))


@C.query(f"WITH {M}, {E}, c AS (SELECT DISTINCT e.parent_id AS id FROM e JOIN m ON m.id = e.memory_id WHERE m.kind = 'correction') SELECT m.id, 'refuse' AS verdict, c.id IS NOT NULL AS overridden, CASE WHEN c.id IS NOT NULL THEN 'assertion' ELSE m.trust END AS trust FROM m LEFT JOIN c USING (id) WHERE m.source = 'orphan-drop' AND length(coalesce(m.text, '')) > 0 AND length(trim(m.text, ' ' || chr(9) || chr(10) || chr(13))) > 0 AND octet_length(encode(m.text)) <= 65536")
def gate_g8_override(spark, d):
    """Refusals of a denied source, overridden where a correction derives from the memory; its trust then is an assertion."""
    origin = F.lit("authenticated")
    refused = records.verdicts(memories(spark, d).withColumn("origin", origin), DENIED).where("code = 'policy_denied'")
    fixes = memories(spark, d, "kind = 'correction'").select(F.col("id").alias("memory_id"))
    named = edges(spark, d).join(fixes, "memory_id", "left_semi").select(F.col("parent_id").alias("id")).distinct().withColumn("_o", F.lit(True))
    out = refused.join(named, "id", "left")
    over = F.coalesce("_o", F.lit(False))
    return out.select("id", "verdict", over.alias("overridden"), F.when(over, "assertion").otherwise(F.col("trust")).alias("trust"))


@C.query(f"WITH {M}, {E}, c AS (SELECT DISTINCT e.parent_id AS id FROM e JOIN m ON m.id = e.memory_id WHERE m.kind = 'correction') SELECT m.id, c.id IS NOT NULL AS corrected, m.superseded_by IS NOT NULL AS superseded, (c.id IS NOT NULL) <> (m.superseded_by IS NOT NULL) AS valid FROM m LEFT JOIN c USING (id) WHERE c.id IS NOT NULL OR m.superseded_by IS NOT NULL")
def check_v5_patch(spark, d):
    """Memories changed by a correction or a replacement; exactly one of both is valid."""
    m = memories(spark, d).select("id", "kind", "superseded_by")
    fixes = m.where("kind = 'correction'").select(F.col("id").alias("memory_id"))
    c = edges(spark, d).join(fixes, "memory_id", "left_semi").select(F.col("parent_id").alias("id")).distinct().withColumn("_c", F.lit(True))
    out = m.join(c, "id", "left").withColumns({"corrected": F.coalesce("_c", F.lit(False)), "superseded": F.col("superseded_by").isNotNull()}).where("corrected OR superseded")
    return out.select("id", "corrected", "superseded", (F.col("corrected") != F.col("superseded")).alias("valid"))


@C.query("WITH w AS (SELECT predicate_namespace AS namespace, provenance.source.system AS system, min((recorded_at, provenance.source.system)) AS first, count(DISTINCT (scope_id, tx_seq)) AS claims FROM claim_history GROUP BY 1, 2), g AS (SELECT namespace, min(first)[2] AS holder FROM w GROUP BY 1) SELECT w.namespace, w.system, w.claims, w.system = g.holder AS granted FROM w JOIN g USING (namespace)")
def check_v8_grants(spark, d):
    """Systems that write to a namespace, and which holds it by having come first."""
    h = table(spark, d, "claim_history").select(F.col("predicate_namespace").alias("namespace"), F.col("provenance.source.system").alias("system"), "recorded_at", "scope_id", "tx_seq")
    w = h.groupBy("namespace", "system").agg(F.min(F.struct("recorded_at", "system")).alias("first"), F.count_distinct("scope_id", "tx_seq").alias("claims"))
    g = w.groupBy("namespace").agg(F.min("first")["system"].alias("holder"))
    return w.join(g, "namespace").select("namespace", "system", "claims", (F.col("system") == F.col("holder")).alias("granted"))


QUERIES, ORACLES = C.queries, C.oracles
