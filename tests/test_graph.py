"""Walks and mentions against brute force."""

import random
import re

from pyspark.sql import functions as F

from cairn.operators import graph, lifecycle, records, retrieval

import pytest


def test_walks_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abcdefghij"), rng.choice("abcdefghij")) for _ in range(25)] + [("h", f"x{i:02}") for i in range(40)] + [(None, "a"), ("a", None), ("a", "a")]
    got = {(r["id"], r["other"]): (r["step"], r["path"]) for r in graph.walked(spark.createDataFrame(rows + rows[:5], "memory_id STRING, parent_id STRING"), 4).collect()}
    near = {}
    for a, b in rows:
        if a and b and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    near = {k: sorted(v)[:4] for k, v in near.items()}
    expected = {}
    for a in near:
        for b in near[a]:
            expected[a, b] = min(expected.get((a, b), (9, "")), (1, f"{a}/{b}"))
            for c in near[b]:
                if c != a:
                    expected[a, c] = min(expected.get((a, c), (9, "")), (2, f"{a}/{b}/{c}"))
    assert got == expected and graph.walked(spark.createDataFrame([], "memory_id STRING, parent_id STRING"), 4).count() == 0


def test_whole_names_the_longest_first(spark):
    names = ["Ann", "Ann Lee", "Lee", "Rüdes", "C. D."]
    texts = ["Ann Lee met ann, not Anna or Hann.", "LEE? lee-ann RÜDES rüdesbach", "c. d. and C. D.", "", None, "none here " * 30_000, "Ann " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").withColumn("name", F.lit("clash"))
    got = {r["doc_id"]: r["found"] for r in df.select("doc_id", graph.spans(F.col("text"), names).alias("found")).collect()}
    listed = sorted((n.lower() for n in names), key=lambda n: (-len(n), n))
    pattern = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, listed)) + r")(?![^\W_])")
    for i, t in enumerate(texts):
        if t is None:
            assert not got[i]
        else:
            assert [(f["name"], f["position"]) for f in got[i]] == [(m[0], m.start() + 1) for m in pattern.finditer(t.lower())]
    top = graph.entities(df.select("doc_id", graph.spans(F.col("text"), names).alias("found")), 2)
    assert {(r["doc_id"], r["name"], r["mentions"], r["position"]) for r in top.collect()} == {(0, "ann lee", 1, 1), (0, "ann", 1, 13), (1, "lee", 2, 1), (1, "ann", 1, 10), (2, "c. d.", 2, 1), (6, "ann", 3000, 1)}
    assert df.select(graph.spans(F.col("text"), []).alias("f")).where("size(f) > 0").count() == 0


def test_filters_and_batches(spark):
    df = spark.createDataFrame([("a", "active", "fact", 5), ("b", "expired", "fact", 1), ("c", "active", "task", 2), ("d", "active", "task", 2), ("e", None, None, None)], "id STRING, status STRING, kind STRING, created BIGINT").withColumn("scope_id", F.lit("s"))
    ids = lambda x: sorted(r["id"] for r in x.collect())
    assert ids(records.filtered(df)) == ["a", "c", "d"] and ids(records.filtered(df, {"expired"})) == ["b"] and ids(records.filtered(df, kinds={"task"})) == ["c", "d"]
    assert records.filter_text({"b", "a"}) == records.filter_text({"a", "b"}) != records.filter_text()
    with pytest.raises(ValueError):
        records.filtered(df, set())
    due = lifecycle.due(df, F.col("created") + 1, F.lit(4), 1).collect()
    assert [(r["id"], r["more"]) for r in due] == [("c", True)] and not lifecycle.due(df, F.col("created") + 1, F.lit(4), 2).first()["more"]
    for most in (0, 501):
        with pytest.raises(ValueError):
            lifecycle.due(df, F.col("created"), F.lit(4), most)


def test_numbers_within_hot_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), f"{rng.randrange(10**6):06}") for _ in range(500)]
    rows = sorted(set(rows))
    got = {(r["k"], r["id"]): r["number"] for r in lifecycle.numbered(spark.createDataFrame(rows, "k STRING, id STRING"), ["k"], F.substring("id", 1, 2), ["id"]).collect()}
    assert got == {(k, i): n + 1 for key in "ab" for n, (k, i) in enumerate(x for x in rows if x[0] == key)}


def test_replacements_and_corrections(spark):
    data = [("a", "s", "active", "b", 1), ("b", "s", "active", None, 2), ("c", "s", "active", "c", 3), ("d", "s", "active", "e", 4), ("e", "s", "active", "d", 5), ("f", "s", "active", "zz", 6), ("g", "t", "active", "b", 7), ("h", "s", "active", "i", 8), ("i", "s", "erased", None, 9), ("j", "s", "active", "d", 10)]
    df = spark.createDataFrame(data, "id STRING, scope_id STRING, status STRING, superseded_by STRING, created BIGINT")
    got = {r["id"]: (r["problem"], r["new_status"]) for r in lifecycle.superseded(spark, df).collect()}
    assert got == {"a": (None, "superseded"), "c": ("self", "active"), "d": ("cycle", "active"), "e": ("cycle", "active"), "f": ("unknown_target", "active"), "g": ("other_scope", "active"), "h": ("erased_target", "active"), "j": ("cycle", "active")}
    kinds = df.select("id", "scope_id", F.when(F.col("id").isin("a", "c", "d", "f", "g"), "correction").otherwise("fact").alias("kind"), F.when(F.col("id") == "c", "agent").otherwise("human").alias("actor"), F.when(F.col("id") == "c", "instruction").otherwise("assertion").alias("trust"), "created")
    edges = spark.createDataFrame([("a", "b"), ("d", "b"), ("c", "b"), ("g", "b"), ("d", "yy")], "memory_id STRING, parent_id STRING")
    found = {(r["correction_id"], r["id"]): (r["problem"], r["wins"]) for r in lifecycle.corrected(kinds, edges).collect()}
    assert found == {("a", "b"): (None, False), ("d", "b"): (None, True), ("c", "b"): ("agent_instruction", False), ("g", "b"): ("other_scope", False), ("d", "yy"): ("unknown_target", False), ("f", None): ("unfounded", False)}


def test_freshest_says_if_more(spark):
    df = spark.createDataFrame([("a", 3), ("b", 5), ("c", 5), ("d", 1)], "s STRING, t INT")
    assert [tuple(r) for r in retrieval.freshest(df, "t", "s", 2).orderBy("s").collect()] == [("b", 5, True), ("c", 5, True)]
    assert not any(r["truncated"] for r in retrieval.freshest(df, "t", "s", 4).collect())


def test_scopes_of_requests():
    assert records.scope_key("ann") == ("ann", "personal", "") and records.scope_key("ann", "project", "p") == ("ann", "project", "p")
    for wrong in (("",), ("ann", "personal", "x"), ("ann", "shared"), ("ann", "team", "x")):
        with pytest.raises(ValueError):
            records.scope_key(*wrong)
