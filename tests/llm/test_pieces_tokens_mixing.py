import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import mixing, pieces, tokens


def cut(spark, texts, limit=2048, overlap=128):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, text STRING")
    out = {}
    for r in pieces.split_oversized(df, "text", ["id"], limit, overlap).orderBy("id", "chunk_ordinal").collect():
        out.setdefault(r["id"], []).append(r)
    return out


TEXTS = ["", "a", "x" * 2048, "x" * 2049, "word " * 3000, "Ein Satz. Noch einer! " * 400, "日本語の文。" * 1500, "ż😀é" * 2000, "para one.\n\n" * 500, " " * 5000, "\n" * 5000, "a\r\nb\r\n\r\n" * 800, "x" * 200_000, None]


@pytest.mark.parametrize("limit, overlap", [(2048, 128), (64, 16), (40, 0)])
def test_pieces(spark, limit, overlap):
    texts = [t if t is None else t[:20_000] for t in TEXTS]
    got = cut(spark, texts, limit, overlap)
    assert len(TEXTS) - 1 not in got
    for i, text in enumerate(texts[:-1]):
        rows = got[i]
        assert [r["chunk_ordinal"] for r in rows] == list(range(len(rows))) and {r["pieces_total"] for r in rows} == {len(rows)}
        assert b"".join(r["piece"].encode()[r["overlap_bytes"] :] for r in rows).decode() == text
        assert all(len(r["piece"].encode()) <= limit and r["overlap_bytes"] <= overlap for r in rows)
        assert (len(rows) > 1) == (len(text.encode()) > limit)
        for a, b in zip(rows, rows[1:]):
            assert a["piece"].encode().endswith(b["piece"].encode()[: b["overlap_bytes"]])


def test_pieces_end_at_boundaries(spark):
    sentence = "The desk keeps one record for every claim that it admits. "
    rows = cut(spark, [sentence * 200])[0]
    assert all(r["piece"].endswith(". ") for r in rows[:-1]) and all(r["overlap_bytes"] > 0 for r in rows[1:])
    rows = cut(spark, [("Para of text here.\n" + sentence * 10 + "\n\n") * 20])[0]
    assert all(r["piece"].endswith("\n\n") for r in rows[:-1])


def test_very_long_text(spark):
    text = "Ein Satz mit ä. " * 60_000
    rows = cut(spark, [text])[0]
    assert b"".join(r["piece"].encode()[r["overlap_bytes"] :] for r in rows).decode() == text


def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


SAMPLE = ["", "Hello world", "  two  spaces \n\n\tand tabs ", "<|endoftext|> is text", "naïve café ż 日本語 😀👩‍🔬", "I'm we'll they'VE", "x" * 5000, "1234567890 3.14", " 　 \x85", "a\r\nb", "﻿bom ​ zero", "क्षि ไทย"]


def test_ids_and_decoding(spark):
    rows = [(i, t) for i, t in enumerate(SAMPLE)] + [(100, None), (0, "")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("ids", F.lit("clash")).withColumn("pos", F.lit(1))
    encoded = tokens.encode_corpus(spark, df)
    got = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    true = reference()
    assert got == {i: true(t) for i, t in enumerate(SAMPLE)} | {100: []} and encoded.count() == len(got)
    assert {r["doc_id"]: r["text"] for r in tokens.decode(spark, encoded).collect()} == dict(enumerate(SAMPLE)) | {100: ""}
    counts = {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(spark, df.where("doc_id <> 0")).collect()}
    assert counts == {i: len(true(t)) for i, t in enumerate(SAMPLE) if t}


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_ids_of_documents(spark, data, monkeypatch, most):
    monkeypatch.setattr(tokens, "HOT_ROWS", 5)
    monkeypatch.setattr(tokens, "BROADCAST_BYTES", most)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    true = reference()
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(spark, docs).collect()}
    assert got == {r["doc_id"]: true(r["text"]) if r["text"] else [] for r in docs.collect()}


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_ids_over_batches_and_repeats(spark, rows):
    """Texts over several Arrow batches, repeated rows, two texts of one id, and a null id."""
    docs = [(1, "one two, three four five"), (1, "one two, three four five"), (2, "six"), (2, "seven eight"), (None, "nine ten"), (3, "one two, three four five")]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = sorted(((r["doc_id"] or 0, list(r["ids"])) for r in tokens.encode_corpus(spark, spark.createDataFrame(docs, "doc_id BIGINT, text STRING")).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    true = reference()
    assert got == sorted((d or 0, true(t)) for d, t in set(docs))


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_counts_of_documents(spark, data, monkeypatch, most):
    monkeypatch.setattr(tokens, "HOT_ROWS", 5)
    monkeypatch.setattr(tokens, "BROADCAST_BYTES", most)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    true = reference()
    got = {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(spark, docs).collect()}
    assert got == {r["doc_id"]: len(true(r["text"])) for r in docs.collect() if r["text"]}


@pytest.mark.parametrize("weight", [0.05, 0.3, 1.0])
def test_no_bucket_holds_much_of_a_source(spark, weight):
    keys = spark.range(200_000).select(mixing.sampling_key(F.col("id"), F.lit(weight)).alias("k"))
    buckets = keys.groupBy(F.floor(F.log2("k") * mixing.BUCKETS).alias("b")).count()
    assert buckets.agg(F.max("count")).first()[0] < 200_000 / 300


def test_ids_of_nothing(spark):
    assert tokens.encode_corpus(spark, spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0


def test_mix_against_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice("aaaabbc"), rng.randrange(0, 60), rng.expovariate(1)) for i in range(800)] + [(1000, None, 50, 0.1), (1001, "untargeted", 50, 0.1)]
    targets = [("a", 0.3, 1), ("b", 0.5, 4), ("c", 0.3, 2), ("none", 0.1, 3)]
    d, t = spark.createDataFrame(docs, "doc_id INT, source STRING, tokens BIGINT, sample_key DOUBLE"), spark.createDataFrame(targets, "source STRING, target_share DOUBLE, max_repeats INT")
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(d, t).collect()}
    total, expected = sum(x[2] for x in docs), {}
    for source, share, most in targets:
        own = sorted((x for x in docs if x[1] == source and x[2] > 0), key=lambda x: (x[3], x[0]))
        have = sum(x[2] for x in own)
        epochs = min(most, int(share * total // have)) if have else 0
        rest, upto = share * total - epochs * have if epochs < most else 0, 0
        for i, _, n, _ in own:
            upto += n
            copies = epochs + (upto - n / 2 <= rest)
            if copies:
                expected[i] = copies
    assert got == expected
    reached = {r["source"]: r for r in mixing.shares(mixing.mix(d, t), d, t).collect()}
    assert abs(reached["a"]["reached_share"] - 0.3) < 0.01 and reached["none"]["used"] == 0
    assert all(r["used"] <= r["available"] * r["max_repeats"] for r in reached.values())


def test_mix_prefers_weight(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.2).alias("w"))
    keyed = df.select("doc_id", "w", mixing.sampling_key(F.col("doc_id"), F.col("w")).alias("k")).orderBy("k").limit(4000)
    assert keyed.where("w = 1.0").count() > 3000


def test_mix_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id INT, source STRING, tokens BIGINT, sample_key DOUBLE")
    t = spark.createDataFrame([("a", 1.0, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    assert mixing.mix(d, t).count() == 0
    assert [r["reached_share"] for r in mixing.shares(mixing.mix(d, t), d, t).collect()] in ([None], [0.0])
