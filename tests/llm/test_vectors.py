import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import vectors


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 24))
    x[1:400:2] = x[0:399:2] + 0.05 * rng.normal(size=(200, 24))
    data = [(f"c{i:04}", 1, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    data += [("zero", 1, [0.0] * 24), ("nan", 1, [float("nan")] * 24), ("inf", 1, [float("inf")] + [1.0] * 23), ("alone", 2, [1.0, 2.0])]
    return spark.createDataFrame(data, "chunk_id STRING, model_revision INT, vector ARRAY<FLOAT>"), x.astype(np.float32).astype(float)


def truth(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1)[:, :k]


def test_recall_of_nearest(spark, rows):
    df, x = rows
    s, best = truth(x, 10)
    got = {}
    for r in vectors.neighbours(spark, df).collect():
        got.setdefault(r["chunk_id"], {})[r["other_id"]] = r["cosine"]
    assert set(got) == {f"c{i:04}" for i in range(3000)} and all(len(v) == 10 for v in got.values())
    recall = np.mean([len({f"c{j:04}" for j in best[i]} & set(got[f"c{i:04}"])) / 10 for i in range(3000)])
    assert recall >= 0.9
    for o, c in got["c0000"].items():
        assert abs(c - s[0, int(o[1:])]) < 1e-5


@pytest.mark.parametrize("part, turn, first", [(8192, 32768, 4096), (64, 32768, 4096), (64, 50, 4096), (8192, 50, 4096), (8192, 32768, 20)])
def test_pairs_above_a_cosine(spark, rows, monkeypatch, part, turn, first):
    monkeypatch.setattr(vectors, "PART", part)
    monkeypatch.setattr(vectors, "TURN", turn)
    monkeypatch.setattr(vectors, "FIRST_LISTS", first)
    df, x = rows
    s, _ = truth(x, 10)
    true = {(f"c{i:04}", f"c{j:04}") for i, j in zip(*np.nonzero(s >= 0.97)) if i < j}
    pairs, members = vectors.near_classes(spark, df, 0.97)
    found = [tuple(r) for r in pairs.collect()]
    assert len(set(found)) == len(found) and set(found) <= true and len(found) >= 0.97 * len(true)
    assert members.where("chunk_id = class_id").count() == members.count() == 3001


def test_copies_are_one_class(spark):
    """More copies of a vector than any bound on partners: none is lost, and none costs a search."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 16)).astype(np.float32)
    near = (x[0] + 0.01 * rng.normal(size=(60, 16))).astype(np.float32)
    data = [(f"a{i:03}", 1, v.tolist()) for i, v in enumerate(x)] + [(f"b{i:03}", 1, x[0].tolist()) for i in range(300)] + [(f"n{i:02}", 1, v.tolist()) for i, v in enumerate(near)]
    pairs, members = vectors.near_classes(spark, spark.createDataFrame(data, "chunk_id STRING, model_revision INT, vector ARRAY<FLOAT>"), 0.99)
    classes = {r["chunk_id"]: r["class_id"] for r in members.collect()}
    assert len(classes) == 560 and {c for i, c in classes.items() if i[0] == "b"} == {"a000"} and sum(i == c for i, c in classes.items()) == 260
    u = np.concatenate([x, near]).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    names = [f"a{i:03}" for i in range(200)] + [f"n{i:02}" for i in range(60)]
    assert {tuple(r) for r in pairs.collect()} == {(names[i], names[j]) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.99, 1)))}


def test_recall_with_few_lists_probed(spark):
    """Under a tenth of the lists are looked at, and recall against brute force stays above 0.9."""
    rng = np.random.default_rng(5)
    basis = rng.normal(size=(12, 32))
    x = (rng.normal(size=(20_000, 12)) @ basis + 0.4 * rng.normal(size=(20_000, 32))).astype(np.float32)
    df = spark.createDataFrame([(f"c{i:05}", 1, v.tolist()) for i, v in enumerate(x)], "chunk_id STRING, model_revision INT, vector ARRAY<FLOAT>")
    got = {}
    for r in vectors.neighbours(spark, df, probes=12, queries=F.col("chunk_id").endswith("00")).collect():
        got.setdefault(r["chunk_id"], set()).add(r["other_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, 20_000, 100)
    s = u[asked] @ u.T
    s[np.arange(200), asked] = -2
    best = np.argsort(-s, axis=1)[:, :10]
    assert 13 < 0.1 * int(np.sqrt(20_000))
    assert np.mean([len({f"c{j:05}" for j in best[i]} & got[f"c{a:05}"]) / 10 for i, a in enumerate(asked)]) >= 0.9


def test_pairs_of_words_as_lists():
    """With pairs of words the lists nearest by near_lists are those nearest by all sums, but for first words out of sight."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    books = [rng.normal(size=(40, 8)).astype(np.float32), 0.5 * rng.normal(size=(6, 8)).astype(np.float32)]
    sums = (books[0][:, None] + books[1][None]).reshape(-1, 8)
    score = x @ sums.T - 0.5 * (sums**2).sum(1)
    near, further = vectors.near_lists(x, books, 3)
    assert (near == score.argmax(1)).mean() > 0.99 and np.mean([list(f) == list(np.argsort(-s)[1:4]) for f, s in zip(further, score)]) > 0.95
    near, further = vectors.near_lists(x, books, 0, 0.2)
    assert np.mean([set(f) == set(np.flatnonzero(s >= s.max() - 0.2)) - {n} for n, f, s in zip(near, further, score)]) > 0.95


def test_queries_subset(spark, rows):
    df, _ = rows
    got = vectors.neighbours(spark, df, k=3, queries=F.col("chunk_id").endswith("00"))
    assert got.select("chunk_id").distinct().count() == 30 and got.count() == 90


def test_usable(spark):
    data = [("a", 1, [1.0, 2.0], 5), ("a", 1, None, 9), ("b", 1, [1.0], 1), ("b", 1, [3.0, 4.0], 2), ("b", 1, [3.0, 4.0], 2), ("c", 7, [1.0, 1.0], 1), (None, 1, [1.0, 1.0], 1), ("d", 1, [1.0, 1.0], None)]
    v = spark.createDataFrame(data, "chunk_id STRING, model_revision INT, vector ARRAY<FLOAT>, updated INT").withColumn("extra", F.lit(1))
    m = spark.createDataFrame([(1, 2)], "revision INT, dims INT")
    assert sorted((r["chunk_id"], list(r["vector"])) for r in vectors.usable(v, m).collect()) == [("b", [3.0, 4.0]), ("d", [1.0, 1.0])]


def test_nothing(spark):
    assert vectors.neighbours(spark, spark.createDataFrame([], "chunk_id STRING, model_revision INT, vector ARRAY<FLOAT>")).count() == 0


def test_encoding_reduces_error():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    books = vectors.fit(x, 32)
    codes, norms = vectors.encode(x[:200], books)
    sums = sum(b[codes[:, i]] for i, b in enumerate(books))
    assert np.allclose((sums**2).sum(1), norms, rtol=1e-3, atol=1e-4)
    assert len(books[1]) == 1 and not books[1].any()
    first = ((x[:200, None] - books[0][None]) ** 2).sum(2).min(1)
    assert ((x[:200] - sums) ** 2).sum(1).mean() < 0.5 * first.mean()


def test_near_duplicates_are_confirmed_by_texts(spark):
    from cairn.llm import queries

    long = " ".join(f"w{i}" for i in range(60))
    records = [("a", "s", "fact", long), ("b", "s", "fact", long + " more"), ("c", "s", "task", long), ("d", "t", "fact", long), ("e", "s", "fact", "other words entirely here now"), ("f", "s", "fact", None), ("g", "s", "fact", "Two words"), ("h", "s", "fact", "two, words!"), ("i", "s", "fact", "")]
    pairs = [("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("a", "f"), ("g", "h"), ("f", "i"), ("a", "zz")]
    got = queries.confirmed(spark.createDataFrame(pairs, "memory_a STRING, memory_b STRING"), spark.createDataFrame(records, "id STRING, scope_id STRING, kind STRING, text STRING"))
    assert {(r["memory_a"], r["memory_b"], r["alike"]) for r in got.collect()} == {("a", "b", round(56 / 57, 6)), ("g", "h", 1.0)}
