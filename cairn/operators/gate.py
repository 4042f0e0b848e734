"""Admission of claims: validation against a registry, evidence, authority, relations and the ground of admission.

A proposal passes ten checks in order. The first fault refuses it; without a fault a hold keeps it back;
else it is admitted with the authority that its evidence earns. All checks are columns; only the sources
and the targets of relations are joined, after they are exploded from the proposals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators.claims import CEILINGS, LEVELS, rank


def invalid(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``problem``: the first check of a claim against the registry that fails, or null.

    claims: predicate_namespace, predicate_name, predicate_version, subject_namespace, subject_kind, value_type,
    unit, variant, value_text, slot_key, stance, condition, span_sources, derived_from. registry, a small
    table with a row for each predicate of each version: namespace, name, version, subjects, value_type,
    units, variants, cardinality (one or many), stances, withdrawn.
    """
    known = registry.select(F.col("namespace").alias("predicate_namespace"), F.col("name").alias("predicate_name"), F.col("version").alias("predicate_version"), F.struct("subjects", "value_type", "units", "variants", "cardinality", "stances", "withdrawn").alias("_def"))
    named = known.select("predicate_namespace", "predicate_name", F.lit(True).alias("_named")).distinct()
    out = claims.join(F.broadcast(known), ["predicate_namespace", "predicate_name", "predicate_version"], "left").join(F.broadcast(named), ["predicate_namespace", "predicate_name"], "left")
    of, lacks = F.col("_def"), lambda array, item: ~F.coalesce(F.array_contains(array, item), F.lit(False))
    normal = lambda c: F.coalesce(X.composed(F.col(c)) == F.col(c), F.lit(True))
    checks = [
        (of.isNull() & F.col("_named").isNull(), "unknown_predicate"), (of.isNull(), "wrong_version"), (of["withdrawn"], "withdrawn"),
        ((F.col("subject_namespace") != F.col("predicate_namespace")) | lacks(of["subjects"], F.col("subject_kind")), "wrong_subject"), (~F.col("value_type").eqNullSafe(of["value_type"]), "wrong_value"),
        ((F.col("value_type") == "decimal") & F.when(F.col("unit").isNull(), F.size(of["units"]) > 0).otherwise(lacks(of["units"], F.col("unit"))), "undeclared_unit"), ((F.col("value_type") == "enum") & lacks(of["variants"], F.col("variant")), "undeclared_variant"),
        ((of["cardinality"] == "many") & F.col("slot_key").isNull(), "missing_slot"), ((of["cardinality"] == "one") & F.col("slot_key").isNotNull(), "unexpected_slot"), (lacks(of["stances"], F.col("stance")), "inadmissible_stance"),
        (~normal("value_text") | ~normal("condition"), "not_composed"), (F.size(F.array_except("span_sources", "derived_from")) > 0, "span_outside"),
    ]
    return out.withColumn("problem", F.coalesce(*[F.when(test, name) for test, name in checks])).drop("_def", "_named")


def policy_problem(policy: dict) -> str | None:
    """Why a policy is not valid, or None: it needs a name and version, its ceilings may only lower the fixed ones and name each kind once, and no predicate is qualified on inference.

    policy: id, version, ceilings [(kind, level)], qualified [(namespace, predicate, least level)].
    """
    if not (policy.get("id") or "").strip() or not policy.get("version"):
        return "unnamed"
    seen = set()
    for kind, level in policy.get("ceilings", []):
        if kind in seen:
            return "duplicate_ceiling"
        seen.add(kind)
        if kind not in CEILINGS or LEVELS.index(level) > LEVELS.index(CEILINGS[kind]):
            return "ceiling_raised"
    if any(LEVELS.index(level) < LEVELS.index("extracted") for _, _, level in policy.get("qualified", [])):
        return "qualified_on_inference"
    return None


def narrowed(own: dict, wider: dict) -> dict:
    """Limits that may only narrow: numbers not above, sets not beyond those of ``wider``. Raises ValueError at the first that widens."""
    for name, value in own.items():
        if name not in wider or (not set(value) <= set(wider[name]) if isinstance(value, (set, frozenset)) else value > wider[name]):
            raise ValueError(f"{name} is wider than allowed")
    return {**wider, **own}


def decided(proposals: DataFrame, registry: DataFrame, sources: DataFrame, targets: DataFrame, policy: dict) -> DataFrame:
    """(id, verdict, code, rule, authority, sourcing, conflicts) of each proposal.

    proposals: the columns of ``invalid`` and id, scope_id, subject_key, owner, proposer_kind, proposer_id, evidence
    ARRAY<STRUCT<kind, level, score, by, source>> and relations ARRAY<STRUCT<kind, to>>. A seed's ``source``
    names its set; that of a span is a memory. sources: (source, available) of memories; targets: (claim_id,
    scope_id, authority, sourcing). policy: floor or None, ceilings {kind: level}, qualified
    [(namespace, predicate, least level)], seeds [set]. Conflicts are the supplier's claims that a user contradicts.
    """
    said = lambda e: e["kind"] == "user_statement"
    p = invalid(proposals, registry)
    honoured = F.filter("evidence", lambda e: said(e) & (F.col("proposer_kind") == "human") & (e["by"] == F.col("proposer_id")))
    p = p.withColumns({"_said": honoured, "_seeds": F.transform(F.filter("evidence", lambda e: e["kind"] == "seed"), lambda e: e["source"])})
    correcting = (F.size("_said") > 0) & F.exists("relations", lambda r: r["kind"].isin("supersedes", "contradicts"))
    own = F.exists("_said", lambda e: e["by"] == F.col("owner"))
    p = p.withColumns({"_correcting": correcting, "_own": own, "sourcing": F.when(own, "user").when(F.size("_seeds") > 0, "seed").otherwise("supplier")})

    def earned(e: Column) -> Column:
        ceiling = F.lit(None).cast("int")
        for kind, most in CEILINGS.items():
            ceiling = F.when(e["kind"] == kind, min(LEVELS.index(most), LEVELS.index(policy.get("ceilings", {}).get(kind, most)))).otherwise(ceiling)
        user = F.when(F.size("_said") > 0, F.when(F.col("_correcting"), LEVELS.index("user_corrected")).otherwise(LEVELS.index("user_asserted")))
        return F.when(ceiling.isNotNull(), F.when(said(e), F.when(user.isNotNull(), F.least(ceiling, user))).otherwise(ceiling))

    p = p.withColumn("_level", F.array_max(F.transform("evidence", earned)))

    cited = F.concat("derived_from", "span_sources", F.transform(F.filter("evidence", lambda e: e["kind"].isin("source_span", "span_verified", "corroboration") & e["source"].isNotNull()), lambda e: e["source"]))
    asked = p.select("id", F.explode(F.array_distinct(cited)).alias("source")).join(sources.select("source", "available").distinct(), "source", "left")
    missing = asked.where(~F.coalesce("available", F.lit(False))).groupBy("id").agg(F.lit(True).alias("_missing"))

    each = p.select("id", "scope_id", "sourcing", "_level", "_correcting", F.posexplode("relations").alias("_at", "r")).withColumn("to", F.col("r.to"))
    each = each.join(targets.select(F.col("claim_id").alias("to"), F.struct(F.col("scope_id").alias("scope"), "authority", F.col("sourcing").alias("side")).alias("t")), "to", "left")
    over = F.col("r.kind") == "supersedes"
    wrong = F.when(F.col("t").isNull(), "unknown_target").when(F.col("t.scope") != F.col("scope_id"), "cross_scope_relation").when(over & (F.col("sourcing") == "user") & (F.col("t.side") == "supplier"), "user_supersedes_supplier")
    against = (F.col("r.kind") == "contradicts") & F.col("_correcting") & (F.col("t.side") == "supplier")
    related = each.groupBy("id").agg(F.min_by(wrong, F.when(wrong.isNotNull(), F.col("_at"))).alias("_wrong"), F.max(F.coalesce(over & (rank(F.col("t.authority")) > F.col("_level")), F.lit(False))).alias("_outranked"), F.array_sort(F.collect_set(F.when(against, F.col("to")))).alias("conflicts"))
    p = p.join(missing, "id", "left").join(related, "id", "left")

    reviewed = F.exists("evidence", lambda e: e["kind"] == "review_approval")
    seeded = (F.size("_seeds") > 0) & F.forall("_seeds", lambda s: s.isin(policy.get("seeds", [])) if policy.get("seeds") else F.lit(False))
    qualified = reduce(lambda a, q: a | ((F.col("predicate_namespace") == q[0]) & (F.col("predicate_name") == q[1]) & (F.col("_level") >= LEVELS.index(q[2]))), policy.get("qualified", []), F.lit(False))
    below = F.exists("evidence", lambda e: (e["kind"] == "model_score") & F.coalesce(e["score"] < policy["floor"], F.lit(False))) if policy.get("floor") is not None else F.lit(False)
    secret = F.coalesce(*[X.detected(F.col(c)) for c in ("value_text", "condition", "slot_key", "subject_key")])
    rule = lambda test, code, name=None: F.when(test, F.struct(F.lit(code).alias("code"), (F.lit(name) if isinstance(name, str) or name is None else name).cast("string").alias("rule")))
    faults = [
        rule(F.col("problem").isin("unknown_predicate", "wrong_version"), "unregistered_predicate"), rule(F.col("problem").isNotNull(), "invalid_value", F.col("problem")), rule(secret.isNotNull(), "secret_detected", secret), rule(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "no_provenance"),
        rule(F.col("_missing"), "source_unavailable"), rule((F.size("_seeds") > 0) & F.exists("evidence", said), "policy_denied", "seed_with_user_statement"), rule(below, "below_score_floor"),
        rule(F.exists("_said", lambda e: rank(e["level"]) < LEVELS.index("user_asserted")), "policy_denied", "user_statement_below_user_level"), rule(F.col("_level").isNull(), "authority_insufficient"), rule(F.col("_wrong").isNotNull(), "policy_denied", F.col("_wrong")),
    ]
    hold = rule((F.coalesce("_outranked", F.lit(False)) & ~reviewed) | ~(reviewed | F.col("_own") | seeded | qualified), "authority_insufficient")
    p = p.withColumn("_fault", F.coalesce(*faults)).withColumn("_hold", hold)
    verdict = F.when(F.col("_fault").isNotNull(), "refuse").when(F.col("_hold").isNotNull(), "hold").otherwise("admit")
    why, admitted = F.coalesce("_fault", "_hold"), verdict == "admit"
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("_level") + 1)
    return p.select("id", verdict.alias("verdict"), why["code"].alias("code"), why["rule"].alias("rule"), F.when(admitted, level).alias("authority"), F.when(admitted, F.col("sourcing")).alias("sourcing"), F.when(admitted, F.coalesce(F.array_join("conflicts", ","), F.lit(""))).alias("conflicts"))


#: The namespace that no registry may take.
RESERVED = frozenset({"cairn"})


def registered(current: list[dict], proposed: dict, reserved: frozenset[str] = RESERVED) -> str | None:
    """Why a version of a registry may not follow the current ones, or None; "unchanged" for one that is there already.

    A version: namespace, version, kinds, predicates {name: (cardinality, value type, units, variants)}. A namespace that is
    reserved, a version that differs from the one of its number, one before the latest, and a successor that
    drops a subject kind, a predicate, a unit or a variant or changes a cardinality or value type are refused.
    """
    if proposed["namespace"] in reserved:
        return "reserved_namespace"
    own = sorted((v for v in current if v["namespace"] == proposed["namespace"]), key=lambda v: v["version"])
    for held in own:
        if held["version"] == proposed["version"]:
            return "unchanged" if held == proposed else "conflicting_version"
    if not own:
        return None
    last = own[-1]
    if proposed["version"] < last["version"]:
        return "not_after_latest"
    if set(last["kinds"]) - set(proposed["kinds"]):
        return "subject_kind_removed"
    for name, (cardinality, value, units, variants) in last["predicates"].items():
        if name not in proposed["predicates"]:
            return "predicate_removed"
        new = proposed["predicates"][name]
        if new[0] != cardinality:
            return "cardinality"
        if new[1] != value or set(units) - set(new[2]) or set(variants) - set(new[3]):
            return "value_type"
    return None

