"""Claims: validation, earned authority, history checks, and the bitemporal projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels of authority from the least, what each kind of evidence can earn at most, and stances.
LEVELS = ("inferred", "extracted", "verified", "user_asserted", "user_corrected")
CEILINGS = {"model_score": "inferred", "source_span": "extracted", "rule": "extracted", "seed": "extracted", "span_verified": "verified", "user_statement": "user_corrected"}
STANCES = ("asserted", "denied", "conditional", "requested", "confirmed", "estimated", "expected", "observed")

SLOT = ["scope_id", "subject_namespace", "subject_kind", "subject_key", "predicate_namespace", "predicate_name", "predicate_version", "slot_key"]
#: The bounds of an open window, in seconds.
LEAST, MOST = -(1 << 61), 1 << 61


def rank(level: Column) -> Column:
    """0 for the least level of authority; unknown levels are null."""
    return reduce(lambda c, i: c.when(level == LEVELS[i], i), range(1, len(LEVELS)), F.when(level == LEVELS[0], 0))


def earned(evidence: Column) -> Column:
    """The greatest authority that an array of (kind, level) earns: each its level, capped by its kind's ceiling; null if none earns any."""

    def one(e: Column) -> Column:
        cap = F.lit(None).cast("int")
        for kind, level in CEILINGS.items():
            cap = F.when(e["kind"] == kind, LEVELS.index(level)).otherwise(cap)
        return F.when(cap.isNotNull(), F.least(cap, rank(e["level"])))

    return F.array_max(F.transform(evidence, one))


def validated(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``problem``: the first check that a claim fails, or null.

    claims: predicate (namespace, name, version), subject_kind, value_type, stance, slot_key; registry: one
    row for each predicate version, a small table, with its subject kind, value type and whether it is slotted.
    """
    known = registry.select("predicate_namespace", "predicate_name", F.col("version").alias("_v"), F.col("kind").alias("_kind"), F.col("value").alias("_value"), F.col("slotted").alias("_slotted"))
    out = claims.join(known, ["predicate_namespace", "predicate_name"], "left")
    problem = F.when(F.col("_v").isNull(), "unknown_predicate").when(F.col("predicate_version") != F.col("_v"), "wrong_version").when(F.col("subject_kind") != F.col("_kind"), "wrong_subject")
    problem = problem.when(F.col("value_type").isNull(), "no_value").when(F.col("value_type") != F.col("_value"), "wrong_value").when(F.col("slot_key").isNotNull() & ~F.col("_slotted"), "slot_not_allowed").when(~F.col("stance").isin(*STANCES), "unknown_stance")
    return out.withColumn("problem", problem).drop("_v", "_kind", "_value", "_slotted")


def interval(start: Column, start_bound: Column, end: Column, end_bound: Column) -> Column:
    """The window of an interval between two points' windows, or null if a closed end has none.

    Bounds are open, inclusive or exclusive. An inclusive start counts from the start of its point on, an
    exclusive one from its end on. An inclusive end counts to the end of its point. An exclusive end counts
    for certain to the start of its point, but possibly to its end.
    """

    def side(window: Column, bound: Column, ever: int, inclusive: tuple[str, str], exclusive: tuple[str, str]) -> tuple[Column, Column]:
        pick = lambda i: F.when(bound == "open", F.lit(ever)).when(bound == "inclusive", window[inclusive[i]]).when(bound == "exclusive", window[exclusive[i]])
        return pick(0), pick(1)

    low = side(start, start_bound, LEAST, ("definite_low", "possible_low"), ("definite_high", "possible_high"))
    high = side(end, end_bound, MOST, ("definite_high", "possible_high"), ("definite_low", "possible_high"))
    sure = low[0].isNotNull() & high[0].isNotNull()
    return F.when(low[1].isNotNull() & high[1].isNotNull(), F.struct(F.when(sure, low[0]).alias("definite_low"), F.when(sure, high[0]).alias("definite_high"), low[1].alias("possible_low"), high[1].alias("possible_high")))


def uncertain(earliest: Column, latest: Column) -> Column:
    """The window of a point known only to lie between two others: definite nowhere, possible from the first of their windows to the last."""
    none = F.lit(None).cast("bigint")
    low, high = F.least(earliest["possible_low"], latest["possible_low"]), F.greatest(earliest["possible_high"], latest["possible_high"])
    return F.when(earliest.isNotNull() & latest.isNotNull(), F.struct(none.alias("definite_low"), none.alias("definite_high"), low.alias("possible_low"), high.alias("possible_high")))


def from_then_on(start: Column) -> Column:
    """The window of what holds from a point's window on, without end."""
    low = start["definite_low"]
    return F.when(start.isNotNull(), F.struct(low.alias("definite_low"), F.when(low.isNotNull(), F.lit(MOST)).alias("definite_high"), start["possible_low"].alias("possible_low"), F.lit(MOST).alias("possible_high")))


def _undominated(left: DataFrame) -> DataFrame:
    """Drops each claim that another of its slot comes after in source order, where the slot orders by source.

    Two claims with different source sequences are ordered by them, others by their source times' possible
    windows if both have one; else neither comes first. The greatest of a few groups of a slot tell whether
    any claim comes after another, so no pairs are made.
    """
    time = F.when(F.col("source_low").isNotNull(), F.struct("source_low", "source_high"))
    left = left.withColumn("_time", time)
    first = left.groupBy("slot").agg(F.min_by("rule", "claim_id").alias("rule0"), F.max("source_seq").alias("seq"), F.max("_time").alias("latest"), F.max(F.when(F.col("source_seq").isNull(), F.col("_time"))).alias("latest_unnumbered"))
    same = left.where(F.col("source_seq").isNotNull()).groupBy("slot", "source_seq").agg(F.max("_time").alias("latest_equal"))
    left = left.join(first, "slot").join(same, ["slot", "source_seq"], "left")
    after = lambda c: F.coalesce(F.col(c) > F.col("_time"), F.lit(False))
    numbered = (F.col("source_seq") < F.col("seq")) | after("latest_equal") | after("latest_unnumbered")
    dominated = F.when(F.col("source_seq").isNull(), after("latest")).otherwise(numbered)
    return left.where(F.col("open") | (F.col("rule0") != "by_source_order") | F.col("rule0").isNull() | ~dominated)


def remaining(claims: DataFrame, supersedes: DataFrame, retracted: DataFrame, query_low: int, query_high: int, possible_counts: bool = True, query_definite: tuple[int, int] | None | bool = True) -> tuple[DataFrame, DataFrame]:
    """(all slots known, claims left in them) of the projection; see ``project``. ``query_definite``: the definite window asked for, True for the possible one, None for none."""
    claims = claims.dropDuplicates(["claim_id"])
    asked = (query_low, query_high) if query_definite is True else query_definite
    definite = F.lit(False) if asked is None else (F.col("definite_low") <= asked[0]) & (F.col("definite_high") >= asked[1])
    possible = (F.col("possible_low") <= query_low) & (F.col("possible_high") >= query_high)
    certainty = F.when(F.coalesce(definite, F.lit(False)), "definite").when(F.lit(possible_counts) & F.coalesce(possible, F.lit(False)), "possible")
    gone = retracted.select("claim_id").distinct().withColumn("_gone", F.lit(True))
    held = claims.withColumn("certainty", certainty).withColumn("covers", F.col("certainty").isNotNull()).withColumn("rank", rank(F.col("authority"))).join(gone, "claim_id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    active = held.where("covers AND NOT _gone")
    ids = active.select("claim_id", "rank")
    strong = supersedes.select("from_id", "to_id", rank(F.col("authority")).alias("by")).distinct()
    replaced = strong.join(ids.select(F.col("claim_id").alias("from_id")), "from_id", "left_semi").join(ids.withColumnRenamed("claim_id", "to_id"), "to_id").where("by >= rank").select(F.col("to_id").alias("claim_id")).distinct()
    # Aggregates a slot decide which claims stay; they are joined back by slot, nulls made equal.
    tag = [F.to_json(F.struct(*SLOT)).alias("slot")]
    left = active.join(replaced, "claim_id", "left_anti").select("*", *tag)
    user, supplier = F.col("sourcing") == "user", F.col("sourcing") == "supplier"
    sides = left.groupBy("slot").agg(F.max(user).alias("user"), F.max(supplier).alias("supplier"), F.count_distinct("value").alias("values"), F.count_distinct("sourcing").alias("sides"), F.max("rank").alias("top"))
    open_ = F.col("user") & F.col("supplier") & (F.col("values") > 1) & (F.col("sides") > 1)
    left = left.join(sides.select("slot", open_.alias("open"), "top"), "slot").where(F.col("open") | (F.col("rank") == F.col("top")))
    slots = held.select("*", *tag).groupBy("slot").agg(*[F.first(c).alias(c) for c in SLOT], F.max("covers").alias("any_cover"), F.max(F.col("covers") & ~F.col("_gone")).alias("any_active"))
    return slots, _undominated(left)


def project(claims: DataFrame, supersedes: DataFrame, retracted: DataFrame, query_low: int, query_high: int, possible_counts: bool = True, query_definite: tuple[int, int] | None | bool = True) -> DataFrame:
    """The current view: one row for each slot known, with its state, its value, certainty and the claims that carry it.

    claims: the slot columns, claim_id, value, authority, sourcing, rule, source_seq, the possible window of the
    source time (source_low, source_high; null if none) and the windows (definite_low, definite_high), null if
    there is none, and (possible_low, possible_high), null if unusable, all within the knowledge bound.
    supersedes: (from_id, to_id, authority); retracted: (claim_id). A window covers the query if it holds
    [query_low, query_high). States: absent, retracted, value, conflicted. Of the claims that cover and are not
    retracted, those superseded by one of them with enough authority go; unless user and supplier disagree,
    only the greatest authority stays, and if the slot's first claim orders by source, only those that no other
    comes after. Slots keep their row even if nothing is left, then as a value that is null. A value is
    definite if one of its claims is.

    Duplicated claim ids count once; null slot keys are equal. Slots are aggregated, never paired. The result
    does not depend on the order in which claims came.
    """
    slots, left = remaining(claims, supersedes, retracted, query_low, query_high, possible_counts, query_definite)
    final = left.groupBy("slot").agg(F.count_distinct("value").alias("values"), F.min("value").alias("value"), F.min("certainty").alias("certainty"), F.array_sort(F.collect_set("claim_id")).alias("claims"))
    out = slots.join(final, "slot", "left")
    state = F.when(~F.col("any_cover"), "absent").when(~F.col("any_active"), "retracted").when(F.col("values") > 1, "conflicted").otherwise("value")
    return out.select(*SLOT, state.alias("state"), F.when(state == "value", F.col("value")).alias("value"), F.when(state.isin("value", "conflicted"), F.col("certainty")).alias("certainty"), F.coalesce("claims", F.array().cast("array<string>")).alias("claims"))


def conflicts(left: DataFrame) -> DataFrame:
    """(slot columns, left_claim, right_claim): for each two different values of a conflicted slot the first claim of each, the lesser id first.

    Claims of one value are one side, so a value held by many makes no more pairs.
    """
    each = left.groupBy("slot", "value").agg(F.min("claim_id").alias("claim"), *[F.first(c).alias(c) for c in SLOT])
    other = each.select("slot", F.col("claim").alias("right_claim"))
    return each.join(other, "slot").where(F.col("claim") < F.col("right_claim")).select(*SLOT, F.col("claim").alias("left_claim"), "right_claim")


def digest(view: DataFrame) -> DataFrame:
    """(slots, low, high): one row that tells views apart, whatever the order of their rows: the count and two sums of parts of each row's hash."""
    text = F.to_json(F.struct(*sorted(view.columns)))
    part = lambda at: F.conv(F.substring(F.sha2(text, 256), at, 10), 16, 10).cast("decimal(38,0)")
    return view.agg(F.count(F.lit(1)).alias("slots"), F.sum(part(1)).cast("string").alias("low"), F.sum(part(11)).cast("string").alias("high"))


def evolution_problems(registry: DataFrame) -> DataFrame:
    """(namespace, version, lost_kinds, lost_values): what a version of a registry drops of the one before it.

    registry: namespace, version, kinds ARRAY, values ARRAY; a successor may only grow. First versions and
    those after a gap are not compared. It is small: one row a version of a namespace.
    """
    before = registry.select("namespace", (F.col("version") + 1).alias("version"), F.col("kinds").alias("_k"), F.col("values").alias("_v"))
    both = registry.join(before, ["namespace", "version"])
    return both.select("namespace", "version", F.array_sort(F.array_except("_k", "kinds")).alias("lost_kinds"), F.array_sort(F.array_except("_v", "values")).alias("lost_values"))
