"""The projection of claims and its windows, against brute force and by hand."""

import itertools
import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from cairn.operators import claims, instants

SLOT = "scope_id STRING, subject_namespace STRING, subject_kind STRING, subject_key STRING, predicate_namespace STRING, predicate_name STRING, predicate_version INT, slot_key STRING"
REST = "claim_id STRING, value STRING, authority STRING, sourcing STRING, rule STRING, source_seq BIGINT, source_low BIGINT, source_high BIGINT, definite_low BIGINT, definite_high BIGINT, possible_low BIGINT, possible_high BIGINT"
LEVELS = claims.LEVELS


def after(a, b):
    """Whether claim a comes after claim b in source order."""
    if a["seq"] is not None and b["seq"] is not None and a["seq"] != b["seq"]:
        return a["seq"] > b["seq"]
    return a["time"] is not None and b["time"] is not None and a["time"] > b["time"]


def brute(rows, supersedes, retracted, low, high):
    """(state, value, claims) of each slot, by pairs."""
    out = {}
    for slot in {r["slot"] for r in rows}:
        own = [r for r in rows if r["slot"] == slot]
        covers = [r for r in own if (r["sure"] and r["from"] <= low and r["to"] >= high) or (r["from"] <= low and r["to"] >= high)]
        out[slot] = ("absent", None, []) if not covers else ("retracted", None, [])
        active = [r for r in covers if r["id"] not in retracted]
        if not active:
            continue
        ids = {r["id"]: r for r in rows if r["from"] <= low and r["to"] >= high and r["id"] not in retracted}
        gone = {t for f, t, level in supersedes if f in ids and t in ids and LEVELS.index(level) >= LEVELS.index(ids[t]["authority"])}
        left = [r for r in active if r["id"] not in gone]
        sides = {r["sourcing"] for r in left}
        held = {"user", "supplier"} <= sides and any(a["sourcing"] != b["sourcing"] and a["value"] != b["value"] for a in left for b in left)
        if left and not held:
            top = max(LEVELS.index(r["authority"]) for r in left)
            left = [r for r in left if LEVELS.index(r["authority"]) == top]
            if min(left, key=lambda r: r["id"])["rule"] == "by_source_order":
                left = [r for r in left if not any(after(o, r) for o in left)]
        values = {r["value"] for r in left}
        out[slot] = ("conflicted" if len(values) > 1 else "value", min(values) if len(values) == 1 else None, sorted(r["id"] for r in left))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_projection_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        start = rng.choice([0, 5, 10, 50])
        rule = rng.choice(["by_source_order", "by_source_order", "explicit_only"])
        rows.append({"slot": rng.randrange(60), "id": f"c{i:03}", "value": rng.choice("xyz"), "authority": rng.choice(LEVELS[:2]), "sourcing": rng.choice(["user", "seed", "supplier", "supplier"]), "rule": rule, "seq": rng.choice([None, None, 1, 2, 3]), "time": rng.choice([None, (1, 2), (1, 3), (4, 5)]), "sure": rng.random() < 0.6, "from": start, "to": rng.choice([8, 40, 100])})
    supersedes = [(f"c{rng.randrange(260):03}", f"c{rng.randrange(260):03}", rng.choice(LEVELS[:3])) for _ in range(120)]
    retracted = [f"c{rng.randrange(260):03}" for _ in range(25)]
    full = [("s", "n", "k", str(r["slot"]), "p", "q", 1, None, r["id"], r["value"], r["authority"], r["sourcing"], r["rule"], r["seq"], *(r["time"] or (None, None)), r["from"] if r["sure"] else None, r["to"] if r["sure"] else None, r["from"], r["to"]) for r in rows]
    rng.shuffle(full)
    parts = spark.createDataFrame(full + full[:20], f"{SLOT}, {REST}"), spark.createDataFrame(supersedes, "from_id STRING, to_id STRING, authority STRING"), spark.createDataFrame([(r,) for r in retracted], "claim_id STRING")
    got = {int(r["subject_key"]): (r["state"], r["value"], list(r["claims"])) for r in claims.project(*parts, 10, 20).collect()}
    assert got == brute(rows, supersedes, set(retracted), 10, 20)
    assert {g[0] for g in got.values()} >= {"absent", "value", "conflicted"}
    _, left = claims.remaining(*parts, 10, 20)
    pairs = {(int(r["subject_key"]), r["left_claim"], r["right_claim"]) for r in claims.conflicts(left).collect()}
    value = {r["id"]: r["value"] for r in rows}
    expected = set()
    for slot, (state, _, ids) in got.items():
        if state == "conflicted":
            firsts = sorted(min(i for i in ids if value[i] == v) for v in {value[i] for i in ids})
            expected |= {(slot, a, b) for a, b in itertools.combinations(firsts, 2)}
    assert pairs == expected


def test_unordered_claims_may_all_be_outdone(spark):
    """Without a sequence on one of three the order is no order: each comes after another, and a value of nothing is left."""
    rows = [("a", 2, (1, 1)), ("b", None, (2, 2)), ("c", 1, (3, 3))]
    full = [("s", "n", "k", "x", "p", "q", 1, None, i, i, "extracted", "supplier", "by_source_order", seq, *time, 0, 100, 0, 100) for i, seq, time in rows]
    none = spark.createDataFrame([], "from_id STRING, to_id STRING, authority STRING"), spark.createDataFrame([], "claim_id STRING")
    out = claims.project(spark.createDataFrame(full, f"{SLOT}, {REST}"), *none, 10, 20).first()
    assert (out["state"], out["value"], out["claims"]) == ("value", None, [])


def test_every_delivery_order_gives_one_digest(spark):
    rows = [("s", "n", "k", "x", "p", "q", 1, None, i, v, "extracted", "supplier", "by_source_order", seq, None, None, 0, 100, 0, 100) for i, v, seq in (("a", "x", 1), ("b", "y", 3), ("c", "z", 2))]
    none = spark.createDataFrame([], "from_id STRING, to_id STRING, authority STRING"), spark.createDataFrame([], "claim_id STRING")
    seen = {tuple(claims.digest(claims.project(spark.createDataFrame(list(order), f"{SLOT}, {REST}").coalesce(1), *none, 10, 20)).first()) for order in itertools.permutations(rows)}
    other = claims.digest(claims.project(spark.createDataFrame(rows[:1], f"{SLOT}, {REST}"), *none, 10, 20)).first()
    assert len(seen) == 1 and tuple(other) not in seen


DAY = 86400
POINTS = [
    ("1714105833", "none", (0, 1), 1714105833), ("2024-02", "warsaw", (0, 29 * DAY), "2024-02-01 00:00"), ("2024-02-26", "warsaw", (0, DAY), "2024-02-26 00:00"), ("2024-02-26T10:30+02:00", "none", (0, 60), "2024-02-26 08:30"), ("2024-02-26T10:30:05Z", "none", (0, 1), "2024-02-26 10:30:05"),
    ("2024-02-26T10Z", "none", (0, 3600), "2024-02-26 10:00"), ("2024-07-01 10:00", "warsaw", (0, 60), "2024-07-01 08:00"), ("next week", "warsaw", None, None), ("2025-03-30 02:30", "warsaw", None, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    systems = spark.createDataFrame([("warsaw", "Europe/Warsaw", "dmy"), ("none", None, "ymd")], "system_name STRING, zone_name STRING, date_order STRING")
    return systems, spark.createDataFrame([("CET", 3600)], "abbrev STRING, offset_seconds INT")


def windowed(spark, tables, rows):
    df = spark.createDataFrame([(i, v, s) for i, (v, s) in enumerate(rows)], "n INT, value STRING, system STRING").withColumn("definite_low", F.lit("clash"))
    return {r["n"]: r["w"] for r in instants.windows(spark, df, "value", "system", *tables, "w").collect()}


def test_windows_of_points(spark, tables):
    got = windowed(spark, tables, [p[:2] for p in POINTS])
    for i, (_, _, span, at) in enumerate(POINTS):
        if span is None:
            assert got[i] is None
            continue
        at = at if isinstance(at, int) else int(datetime.fromisoformat(at).replace(tzinfo=UTC).timestamp())
        assert tuple(got[i]) == (at, at + span[1], at, at + span[1])


def test_windows_without_certainty(spark, tables):
    floating = '{"local":"2024-02-26T10:30","precision":"minute","zone":{"kind":"floating"}}'
    got = windowed(spark, tables, [(floating, "warsaw"), ("2024-02-26 10:30", "none"), ("2025-10-26 02:30", "warsaw"), ("2025-10-26 02:59", "warsaw"), ("2025-10-26T01 Europe/Warsaw", "none")])
    at = int(datetime(2024, 2, 26, 10, 30, tzinfo=UTC).timestamp())
    assert tuple(got[0]) == tuple(got[1]) == (None, None, at - 14 * 3600, at + 60 + 14 * 3600)
    first = int(datetime(2025, 10, 26, 0, 30, tzinfo=UTC).timestamp())
    assert tuple(got[2]) == (None, None, first, first + 3660)
    assert tuple(got[3]) == (None, None, first + 29 * 60, first + 30 * 60 + 3600) or got[3]["definite_low"] is None
    assert got[4]["definite_low"] is None and got[4]["possible_low"] == int(datetime(2025, 10, 25, 23, tzinfo=UTC).timestamp())


def test_windows_of_a_zone_against_zoneinfo(spark, tables):
    zone, start = ZoneInfo("Europe/Warsaw"), datetime(2024, 3, 30)
    local = [start + timedelta(minutes=20 * i) for i in range(5 * 72)] + [datetime(2024, 10, 25) + timedelta(minutes=20 * i) for i in range(5 * 72)]
    got = windowed(spark, tables, [(t.strftime("%Y-%m-%d %H:%M"), "warsaw") for t in local])
    folds = lambda t: sorted({int(u.timestamp()) for f in (0, 1) if (u := t.replace(tzinfo=zone, fold=f).astimezone(UTC)).astimezone(zone).replace(tzinfo=None) == t})
    for i, t in enumerate(local):
        a, b = folds(t), folds(t + timedelta(minutes=1))
        if not a or not b:
            assert got[i] is None
        else:
            sure = len(a) == len(b) == 1
            assert tuple(got[i]) == (a[0] if sure else None, b[-1] if sure else None, a[0], b[-1])


def test_intervals_and_uncertainty(spark):
    df = spark.createDataFrame([((10, 20, 10, 20), (50, 60, 50, 60)), ((None, None, 0, 30), (50, 60, 50, 60)), (None, (50, 60, 50, 60))], "a STRUCT<definite_low: BIGINT, definite_high: BIGINT, possible_low: BIGINT, possible_high: BIGINT>, b STRUCT<definite_low: BIGINT, definite_high: BIGINT, possible_low: BIGINT, possible_high: BIGINT>")
    of = lambda x, y: [r[0] and tuple(r[0]) for r in df.select(claims.interval(F.col("a"), F.lit(x), F.col("b"), F.lit(y))).collect()]
    assert of("inclusive", "inclusive") == [(10, 60, 10, 60), (None, None, 0, 60), None]
    assert of("exclusive", "exclusive") == [(20, 50, 20, 60), (None, None, 30, 60), None]
    assert of("open", "inclusive") == [(claims.LEAST, 60, claims.LEAST, 60)] * 3
    assert of("inclusive", "open") == [(10, claims.MOST, 10, claims.MOST), (None, None, 0, claims.MOST), None]
    assert [r[0] and tuple(r[0]) for r in df.select(claims.uncertain(F.col("a"), F.col("b"))).collect()] == [(None, None, 10, 60), (None, None, 0, 60), None]
    assert [r[0] and tuple(r[0]) for r in df.select(claims.from_then_on(F.col("a"))).collect()] == [(10, claims.MOST, 10, claims.MOST), (None, None, 0, claims.MOST), None]
