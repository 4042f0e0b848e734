import hashlib

import pytest
from pyspark.sql import functions as F

from cairn.functions import chunks
from cairn.operators import claims, records, retrieval
from cairn.plans import catalog
from cairn.sources import cursor, readers

SLOT = ("s", "ns", "k", "subj", "pns", "p", 1)
CLAIM = "scope_id STRING, subject_namespace STRING, subject_kind STRING, subject_key STRING, predicate_namespace STRING, predicate_name STRING, predicate_version INT, slot_key STRING, claim_id STRING, value STRING, authority STRING, sourcing STRING, rule STRING, source_seq BIGINT, definite_low BIGINT, definite_high BIGINT, possible_low BIGINT, possible_high BIGINT, source_low BIGINT, source_high BIGINT"


def project(spark, rows, supersedes=(), retracted=(), possible=True):
    full = [(*SLOT, None, *r) for r in rows]
    out = claims.project(spark.createDataFrame(full, CLAIM), spark.createDataFrame(list(supersedes), "from_id STRING, to_id STRING, authority STRING"), spark.createDataFrame([(r,) for r in retracted], "claim_id STRING"), 10, 11, possible).collect()
    assert len(out) == 1
    return out[0]["state"], out[0]["value"], list(out[0]["claims"])


def claim(cid, value="v", authority="extracted", sourcing="supplier", rule="explicit_only", seq=None, low=0, high=100, definite=True, time=None):
    return (cid, value, authority, sourcing, rule, seq, low if definite else None, high if definite else None, low, high, *(time or (None, None)))


def test_projection_states(spark):
    assert project(spark, [claim("a")]) == ("value", "v", ["a"])
    assert project(spark, [claim("a"), claim("b")]) == ("value", "v", ["a", "b"])
    assert project(spark, [claim("a"), claim("b", "w")]) == ("conflicted", None, ["a", "b"])
    assert project(spark, [claim("a", low=50)]) == ("absent", None, [])
    assert project(spark, [claim("a")], retracted=["a"]) == ("retracted", None, [])
    assert project(spark, [claim("a", "x"), claim("b", "w", "verified")]) == ("value", "w", ["b"])
    assert project(spark, [claim("a", definite=False)]) == ("value", "v", ["a"])
    assert project(spark, [claim("a", definite=False)], possible=False) == ("absent", None, [])


def test_projection_supersession(spark):
    two = [claim("a", "x"), claim("b", "w")]
    assert project(spark, two, [("b", "a", "extracted")]) == ("value", "w", ["b"])
    assert project(spark, two, [("b", "a", "inferred")])[0] == "conflicted"
    assert project(spark, two, [("b", "a", "extracted"), ("a", "b", "extracted")]) == ("value", None, [])
    assert project(spark, [claim("a", "x", rule="by_source_order", seq=1), claim("b", "w", rule="by_source_order", seq=2)]) == ("value", "w", ["b"])
    assert project(spark, [claim("a", "x", "user_asserted", "user"), claim("b", "w", "extracted", "supplier")])[0] == "conflicted"
    assert project(spark, [claim("a"), claim("a")]) == ("value", "v", ["a"])


def test_earned_authority(spark):
    df = spark.sql("SELECT array(named_struct('kind', 'user_statement', 'level', 'user_corrected'), named_struct('kind', 'model_score', 'level', 'verified')) AS e UNION ALL SELECT array(named_struct('kind', 'model_score', 'level', 'verified')) UNION ALL SELECT array(named_struct('kind', 'review', 'level', 'verified'))")
    assert [r[0] for r in df.select(claims.earned(df["e"])).collect()] == [4, 0, None]


CHUNKED = ["", "short", "Ein Satz. Noch einer! " * 300, "ż" * 5000, "x" * 3000, "日本語。" * 900, "a\n" * 4000, "One. " * 200 + "y" * 5000 + " two! three?\u3000four" * 400, None, "z" * 2048, "z" * 2049]


def test_chunks(spark):
    """Whole cover, overlap of at least the bytes asked for, whole characters, no chunk beyond the target, numbers from 0."""
    df = spark.createDataFrame(list(enumerate(CHUNKED)) + [(99, "w" * 1_000_000)], "id INT, text STRING").withColumn("ordinal", F.lit("clash"))
    found = {}
    for r in chunks.chunked(df, "id", "text").orderBy("id", "ordinal").collect():
        found.setdefault(r["id"], []).append(r)
    assert [(r["ordinal"], r["byte_start"], r["too_many"]) for r in found.pop(99)] == [(None, None, True)]
    assert set(found) == {i for i, t in enumerate(CHUNKED) if t}
    for i, rows in found.items():
        body, spans = CHUNKED[i].encode(), [(r["byte_start"], r["byte_end"]) for r in rows]
        assert [r["ordinal"] for r in rows] == list(range(len(rows))) and not any(r["too_many"] for r in rows)
        assert spans[0][0] == 0 and spans[-1][1] == len(body) and (len(spans) == 1) == (len(body) <= 2048)
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert a < c and b < d and 128 <= b - c
        assert all(b - a <= (2048 if len(spans) == 1 else 1024) and body[a:b].decode() for a, b in spans)
    text = CHUNKED[2]
    assert all(text[r["byte_end"] - 2 : r["byte_end"]] in (". ", "! ") and text[r["byte_start"]] in "EN" for r in found[2])


def test_word_pieces():
    vocabulary = {"play": 0, "##ing": 1, "caf": 2, "##e": 3, "!": 4}
    assert chunks.word_pieces("Playing café! zz " + "y" * 101, vocabulary) == ["play", "##ing", "caf", "##e", "!", "[UNK]", "[UNK]"]


def test_top_k_orders_ties_by_key(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert [tuple(r) for r in retrieval.top_k(rows, [1.0, 0.0], 3).collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert retrieval.top_k(rows, [1.0, 0.0], 0).count() == 0


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", 7.0), ("b", None)], "k STRING, v DOUBLE")
    got = {r["k"]: (r["p50"], r["p99"]) for r in retrieval.nearest_rank(df, ["k"], "v", [50, 99]).collect()}
    assert got == {"a": (50.0, 99.0), "b": (7.0, 7.0)}


def test_cursor():
    row = "019166ff-6b74-7300-8b2a-0000000009a8"
    made = cursor.encode(b"k", 17, row, "scope", "f")
    assert cursor.decode(b"k", made, "scope", "f") == (17, row)
    for wrong in ((b"x", made, "scope", "f"), (b"k", made, "other", "f"), (b"k", made[:-1] + ("0" if made[-1] != "0" else "1"), "scope", "f"), (b"k", "00", "scope", "f")):
        with pytest.raises(ValueError):
            cursor.decode(*wrong)


def test_archive_round_trip(spark, tmp_path, data):
    m = spark.read.parquet(f"{data}/model_revision.parquet")
    readers.write_archive({"models": m}, str(tmp_path))
    back = readers.read_archive(spark, str(tmp_path))["models"]
    assert sorted(map(tuple, back.select(m.columns).collect())) == sorted(map(tuple, m.collect()))


def test_captures_and_turns(spark):
    df = spark.createDataFrame([("s", "1", "b", 2), ("s", "1", "a", 1), ("s", None, "c", 3), ("s", None, "c", 3)], "source STRING, external STRING, text STRING, at INT")
    assert sorted(r["text"] for r in readers.captures(df, "source", "external", "text", "at").collect()) == ["a", "c", "c"]
    turns = spark.createDataFrame([("x", 1), ("x", 3), ("y", 2)], "conv_id STRING, turn INT")
    assert [r["turn"] for r in readers.conversation_turns(turns, "x", 2, 3).collect()] == [3]
    with pytest.raises(ValueError):
        readers.conversation_turns(turns, "x", 3, 2)


def test_credentials_beside_the_text(spark, data, tmp_path):
    rows = spark.sql("SELECT 1 AS id, 'fine' AS text, 'password=hunter2hunter2' AS title, 'authenticated' AS origin, 's' AS source, array(named_struct('media_type', 'image/png')) AS media UNION ALL SELECT 2, 'fine', NULL, 'authenticated', 's', array()")
    assert {r["id"]: r["code"] for r in records.verdicts(rows, []).collect()} == {1: "secret", 2: None}
    fonts = spark.sql("SELECT 1 AS id, 'fine' AS text, NULL AS title, 'authenticated' AS origin, 's' AS source, array(named_struct('media_type', 'font/woff2')) AS media UNION ALL SELECT 2, 'fine', NULL, 'authenticated', 's', array(named_struct('media_type', 'model/gltf'))")
    assert {r["id"]: r["code"] for r in records.verdicts(fonts, []).collect()} == {1: None, 2: "unsupported_media"}
    some = spark.read.parquet(f"{data}/memory_record.parquet").limit(1)
    texts = spark.createDataFrame([("1", "token: abcdefghij"), ("2", "plain"), ("3", "Call +44 20 7946 0011 or a@b.example, card 1234 5678 1234 5678")], "key STRING, said STRING")
    changed = some.join(texts).withColumn("id", F.col("key")).withColumn("body", F.col("body").withField("text", F.col("said"))).select(some.columns)
    changed.write.parquet(f"{tmp_path}/memory_record.parquet")
    scrubbed = {r["id"]: (r["scrubbed"], r["changed"]) for r in catalog.QUERIES["text_v17_scrub"](spark, str(tmp_path)).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert scrubbed == {"2": (digest("plain"), False), "3": (digest("Call [phone] or [mail], card [card]"), True)}
    spark.read.parquet(f"{data}/claim_history.parquet").limit(20).withColumn("slot_key", F.lit("secret=abcdefghij")).write.parquet(f"{tmp_path}/claim_history.parquet")
    found = catalog.QUERIES["gate_c2_secrets"](spark, str(tmp_path)).collect()
    assert found and {r["detector"] for r in found} == {"assignment"}


def test_turns_of_all_conversations(spark, data):
    turns = spark.createDataFrame([("x", 1), ("x", 3), ("y", 2), ("y", 5)], "conv_id STRING, turn INT")
    assert sorted(map(tuple, readers.turns_between(turns, 2, 3).collect())) == [("x", 3), ("y", 2)]
    assert readers.turns_between(turns).count() == 4
    with pytest.raises(ValueError):
        readers.turns_between(turns, 3, 2)
    every, few = (catalog.QUERIES[f"source_k6_{n}"](spark, data) for n in ("all_turns", "turns"))
    assert every.where("turn BETWEEN 2 AND 4").exceptAll(few).count() == 0 and every.count() > few.count()


def test_counters_stay_at_zero(spark):
    import random

    from cairn.operators import counters

    rng = random.Random(4)
    rows = [(k, i, rng.choice([1, 1, -1, -2])) for k in "abc" for i in range(200)]
    df = spark.createDataFrame(rows, "k STRING, i INT, d INT").selectExpr("*", "floor(i / 16) AS b")
    got = {r["k"]: r["count"] for r in counters.replayed(df, ["k"], ["i"], "d", "b").collect()}
    for k in "abc":
        held = 0
        for _, _, d in (r for r in rows if r[0] == k):
            held = max(0, held + d)
        assert got[k] == held


def test_what_a_registry_version_drops(spark):
    registry = spark.createDataFrame([("n", 1, ["a", "b"], ["x"]), ("n", 2, ["a"], ["x", "y"]), ("n", 4, [], [])], "namespace STRING, version INT, kinds ARRAY<STRING>, values ARRAY<STRING>")
    assert [tuple(r) for r in claims.evolution_problems(registry).collect()] == [("n", 2, ["b"], [])]
