"""The general operators against brute force on small random data, with nulls, repeats, ties and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import asof, feed, hierarchy, skew


def test_as_known_against_brute_force(spark):
    rng = random.Random(3)
    changes = [(rng.choice(["a", "b", None]), rng.randrange(0, 2_000_000), rng.randrange(20), rng.randrange(9)) for _ in range(400)]
    changes += changes[:50] + [("a", None, 1, 1)]
    events = [(i, rng.choice(["a", "b", "c", None]), rng.choice([rng.randrange(0, 2_200_000), None] + [c[1] for c in changes[:30]]), "x") for i in range(300)]
    log = spark.createDataFrame(changes, "k STRING, known BIGINT, rank INT, seq INT")
    ev = spark.createDataFrame(events, "id INT, k STRING, at BIGINT, t STRING")
    got = asof.as_known(ev, asof.change_log(log, ["k"], F.col("known"), F.struct("rank", "seq"), 100_000), ["k"], "at", 100_000)
    got = {r["id"]: r["state"] and tuple(r["state"]) for r in got.collect()}
    for i, k, at, _ in events:
        fits = [(c[2], c[3]) for c in changes if c[0] == k and c[1] is not None and at is not None and c[1] <= at]
        assert got[i] == (max(fits) if fits else None)


def test_as_known_of_nothing(spark):
    log = asof.change_log(spark.createDataFrame([], "k STRING, known BIGINT, v INT"), ["k"], F.col("known"), F.col("v"))
    ev = spark.createDataFrame([(1, "a", 5)], "id INT, k STRING, at BIGINT")
    assert [r["state"] for r in asof.as_known(ev, log, ["k"], "at").collect()] == [None]
    assert asof.as_known(ev.where("false"), log, ["k"], "at").count() == 0


def _applied(entries):
    last = {}
    for key, seq, removed, value in sorted(set(entries), key=lambda e: (e[1], e[2], e[3] or "")):
        last[key] = None if removed else value
    return {(k, v) for k, v in last.items() if v is not None}


@pytest.mark.parametrize("seed", range(3))
def test_feed_in_any_order(spark, seed):
    rng = random.Random(seed)
    entries = [(rng.choice("abcdefgh"), seq, rng.random() < 0.3, f"v{seq}") for seq in range(80)]
    delivered = entries + rng.sample(entries, 20)
    rng.shuffle(delivered)
    table = feed.ChangeTable.create(spark, ["k"], ["seq"])
    for at in range(0, len(delivered), 25):
        table.append(spark.createDataFrame(delivered[at : at + 25], "k STRING, seq INT, removed BOOLEAN, v STRING"))
    expected = _applied(entries)
    assert {(r["k"], r["v"]) for r in table.read().collect()} == expected
    assert {(r["k"], r["v"]) for r in table.compact().read().collect()} == expected and len(table.runs) == 1
    table.append(spark.createDataFrame([("a", 1000, True, None), ("z", 1001, False, "new")], "k STRING, seq INT, removed BOOLEAN, v STRING"))
    assert {(r["k"], r["v"]) for r in table.compact(keep_tombstones=False).read().collect()} == {e for e in expected if e[0] != "a"} | {("z", "new")}


def test_appends_compact(spark):
    table = feed.ChangeTable.create(spark, ["k"], ["seq"])
    for at in range(7):
        table.append(spark.createDataFrame([("a", at, at == 3, f"v{at}"), (f"b{at}", at, False, "w"), ("b0", 9 - at, at == 0, "u")], "k STRING, seq INT, removed BOOLEAN, v STRING"))
        assert len(table.runs) < feed.MOST_RUNS
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {("a", "v6"), *((f"b{i}", "w") for i in range(1, 7))}


def test_claim_feed_is_compacted(spark, data):
    parts = [spark.read.parquet(f"{data}/{t}.parquet") for t in ("claim_history", "claim_relation", "claim_retraction")]
    assert len(feed.claim_feed(spark, *parts).runs) == 1


def test_claim_feed_of_empty_tables(spark, data):
    h, r, x = (spark.read.parquet(f"{data}/{t}.parquet").where("false") for t in ("claim_history", "claim_relation", "claim_retraction"))
    assert feed.current_claims(feed.claim_feed(spark, h, r, x)).count() == 0


def _walk(links, start):
    at, steps, seen = start, 0, set()
    while at in links:
        if at in seen:
            return "cycle", -1
        seen.add(at)
        at, steps = links[at], steps + 1
    return at, steps


@pytest.mark.parametrize("seed", range(2))
def test_hierarchy_against_walking(spark, seed):
    rng = random.Random(seed)
    links = {f"n{i:03}": f"n{rng.randrange(max(1, i - 6), i + (6 if rng.random() < 0.05 else 1)):03}" for i in range(1, 150)}
    links |= {"own": "own", "before": "own"} | {f"chain{i:03}": f"chain{i + 1:03}" for i in range(70)} | {f"child{i}": "chain000" for i in range(30)}
    rows = list(links.items()) * 2 + [(None, "x"), ("y", None)]
    got = {r["id"]: r for r in hierarchy.resolve(spark, spark.createDataFrame(rows, "id STRING, parent_id STRING"), with_path=True).collect()}
    assert set(got) == set(links)
    for node in links:
        root, depth = _walk(links, node)
        assert (got[node]["root_id"], got[node]["depth"]) == (root, depth)
        if depth > 0:
            path = got[node]["path"]
            assert path[0] == root and path[-1] == node and len(path) == depth + 1 and all(links[b] == a for a, b in zip(path, path[1:]))
        else:
            assert got[node]["path"] is None


def test_hierarchy_descendants_and_nothing(spark):
    rows = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("l", "m"), ("m", "l")], "id STRING, parent_id STRING")
    found = hierarchy.descendants(hierarchy.resolve(spark, rows, with_path=True)).collect()
    assert {tuple(r) for r in found} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}
    assert hierarchy.resolve(spark, rows.where("false")).count() == 0


def test_lookup_keeps_all_rows_of_hot_keys(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), (None, 2), ("none", 3)], "k STRING, n INT")
    right = spark.createDataFrame([("hot", "H"), ("cold", "C")], "k STRING, v STRING")
    hot = skew.hot_keys(left, "k", least=10)
    assert hot == ["hot"]
    got = skew.lookup(left, right, "k", hot=hot)
    assert got.count() == 53 and {(r["k"], r["v"]) for r in got.collect()} == {("hot", "H"), ("cold", "C"), (None, None), ("none", None)}
    assert skew.lookup(left, right, "k", "inner", hot).count() == 51


def test_p1_against_brute_force(spark, data):
    from cairn.operators import instants
    from cairn.plans import core_problems

    h = spark.read.parquet(f"{data}/claim_history.parquet")
    at = {(r["scope_id"], r["tx_seq"]): r["utc_us"] for r in instants.normalise_fields(spark, h, *(spark.read.parquet(f"{data}/{t}.parquet") for t in ("source_system", "zone_abbrev"))).where("field_name = 'valid_time'").collect()}
    rows = h.select("scope_id", "subject_key", "predicate_name", "slot_key", "tx_seq", F.unix_micros("recorded_at").alias("r")).collect()
    expected = set()
    for q in spark.read.parquet(f"{data}/recall_request.parquet").withColumn("a", F.unix_micros("asked_at")).collect():
        fits = [(at[r[0], r[4]], r[4]) for r in rows if r[:4] == (q["scope_id"], q["subject_key"], q["predicate_name"], q["slot_key"]) and r["r"] <= q["a"] and at.get((r[0], r[4]), q["a"] + 1) <= q["a"]]
        if fits:
            expected.add((q["recall_id"], max(fits)[1]))
    assert {tuple(r) for r in core_problems.p1_found(spark, data).collect()} == expected


def test_reading_a_feed_moves_nothing(spark):
    table = feed.ChangeTable.create(spark, ["k"], ["seq"])
    for i in range(2):
        table.append(spark.range(300).select((F.col("id") % (50 + i)).alias("k"), (F.col("id") * 2 + i).alias("seq"), F.lit(i == 1).alias("removed")))
    assert len(table.runs) == 2
    last = {}
    for seq, k, removed in sorted((n * 2 + i, n % (50 + i), i == 1) for n in range(300) for i in range(2)):
        last[k] = (seq, removed)
    found = table.merged()
    assert {r["k"]: (r["seq"], r["removed"]) for r in found.collect()} == last and found.count() == 51
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan and "Bucketed: false" not in plan


def test_salted_lookup_keeps_every_row(spark):
    left = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 1), (None, 2), ("b", 1), ("zz", 3)], "k STRING, n INT")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "k STRING, v INT")
    for hot in (["a"], []):
        got = sorted((r["k"] or "", r["n"], r["v"] or 0) for r in skew.salted_lookup(left, right, "k", hot, salts=7).collect())
        assert got == sorted([("a", i, 10) for i in range(500)] + [("b", 1, 20)] * 2 + [("", 2, 0), ("zz", 3, 0)])
        assert skew.salted_lookup(left, right, "k", hot, "inner").count() == 502
