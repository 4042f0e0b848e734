"""The most similar vectors of every vector, by additive quantisation.

A vector is coded as a sum of codewords, one from each of several full-dimensional codebooks fitted to
residuals; a beam keeps the best partial sums while coding. The norm of the sum is stored, so a table of
the query's products with all codewords scores a coded vector by a few look-ups. The first codebook also
lists the vectors: a query probes the lists of the codewords near it, scores their members by look-up,
and reranks the best by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.skew import HOT_ROWS, MAX_HOT_KEYS, salted_lookup
from cairn.session import materialise

#: Codebooks after those of the lists, codewords in each of them, and partial sums kept while coding.
BOOKS, WORDS, BEAM = 4, 256, 4
#: Codebooks where neighbours are sought however far: they are ranked by the codes alone before the rerank.
WIDE_BOOKS = 7
#: At most about so many vectors of a revision are fitted to, picked by the hash of their id.
SAMPLE = 16_384
#: A revision has about as many lists as the square root of its vectors. So many are words of one codebook; beyond that
#: a second one parts every word's list by what the word leaves, and a list is a pair of words.
FIRST_LISTS = 4096
#: Words of the first codebook whose pairs are looked at in the search for a vector's lists.
FIRST_NEAR = 16
#: A list is worked on in parts of at most about so many vectors, and a part's queries in blocks.
PART, BLOCK = 8192, 512
#: Queries of a list come in turns of about so many, so that a crowded list is several tasks.
TURN = 32_768
#: Candidates a query keeps in a part of a list for the exact rerank, for each of its k neighbours.
KEPT = 12
ITERATIONS = 8
#: For partners of a cosine of 0.95 or more: a row also asks in all lists whose score is at most so far below its own's.
NEAR_MARGIN = 0.02
#: So many ids of copies are broadcast; more are shuffled.
FEW_COPIES = 200_000
#: For the nearest neighbours however far: lists in which a query asks besides its own.
WIDE_PROBES = 32


def usable(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """(chunk_id, model_revision, vector): the newest row of each chunk, if it has the width of its revision.

    Of rows with the same ``updated`` the greatest vector counts; a null ``updated`` is the oldest.
    A revision unknown to models has no usable rows. Values are checked where the vectors are coded.
    """
    newest = vectors.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max_by(F.struct("model_revision", "vector"), F.struct("updated", "model_revision", "vector")).alias("n"))
    return of_width(newest.select("chunk_id", "n.model_revision", "n.vector"), models)


def of_width(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """The rows of known revisions (a small table) whose vector has the width of their revision."""
    widths = F.broadcast(models.groupBy(F.col("revision").alias("model_revision")).agg(F.max("dims").alias("_dims")))
    return vectors.join(widths, "model_revision").where(F.size("vector") == F.col("_dims")).drop("_dims")


def _by_revision(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(revision, ids, unit vectors, places in the batch) of a batch's finite, non-zero rows, by revision."""
    ids = np.asarray(batch.column("chunk_id").to_pylist(), dtype=object)
    revisions = batch.column("model_revision").to_numpy(zero_copy_only=False)
    rows = batch.column("vector")
    flat = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    ends = np.asarray(rows.offsets.to_numpy())
    ends = ends - ends[0]
    for revision in np.unique(revisions):
        at = np.flatnonzero(revisions == revision)
        sizes = ends[at + 1] - ends[at]
        width = int(np.median(sizes))  # rows of one revision have one width; should they not, the usual one counts
        at = at[sizes == width]
        if not width:
            continue
        x = flat[ends[at][:, None] + np.arange(width)]
        norms = np.linalg.norm(x, axis=1)
        fine = np.isfinite(norms) & (norms > 0) & np.isfinite(x).all(axis=1)
        if fine.any():
            yield int(revision), ids[at[fine]], (x[fine] / norms[fine, None]).astype(np.float32), at[fine]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k codewords of x by Lloyd's rounds; empty ones are put on the farthest points."""
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ITERATIONS):
        score = x @ words.T - 0.5 * (words**2).sum(1)
        near = score.argmax(1)
        held = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words[held > 0] = sums[held > 0] / held[held > 0, None]
        if (empty := np.flatnonzero(held == 0)).size:
            words[empty] = x[score.max(1).argsort()[: empty.size]]
    return words.astype(np.float32)


def fit(sample: np.ndarray, lists: int, books: int = BOOKS, seed: int = 7) -> list[np.ndarray]:
    """The codebooks, each fitted to what the ones before leave: two of the lists, the second of one word (zero) unless lists are pairs, then ``books`` others of WORDS words."""
    rng = np.random.default_rng(seed)
    rest, found = sample.astype(np.float32), []
    pairs = -(-lists // FIRST_LISTS)
    for words in [min(lists, FIRST_LISTS), min(pairs, WORDS), *[WORDS] * books]:
        if words == 1:
            found.append(np.zeros((1, rest.shape[1]), np.float32))
            continue
        book = _kmeans(rest, max(1, min(words, len(rest) // 4)), rng)
        rest = rest - book[(rest @ book.T - 0.5 * (book**2).sum(1)).argmax(1)]
        found.append(book)
    return found


def near_lists(x: np.ndarray, books: list[np.ndarray], many: int, margin: float | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(nearest list, further lists in order) of each row: the next ``many``, or all whose score is within ``margin`` of the best.

    A list is a pair of words of the first two codebooks, its score the row's product with their sum less
    half the sum's square. With more than one second word the pairs of the FIRST_NEAR best first words are looked at.
    """
    first, second = books[0], books[1]
    score = x @ first.T - 0.5 * (first**2).sum(1)
    if len(second) > 1:
        top = np.argsort(-score, axis=1)[:, :FIRST_NEAR]
        pair = np.take_along_axis(score, top, 1)[:, :, None] + (x @ second.T - 0.5 * (second**2).sum(1))[:, None, :] - (first @ second.T)[top]
        names = (top[:, :, None] * len(second) + np.arange(len(second))).reshape(len(x), -1)
        score = pair.reshape(len(x), -1)
    else:
        names = np.broadcast_to(np.arange(score.shape[1]), score.shape)
    if margin is not None:
        best = score.argmax(1)
        rows = np.arange(len(x))
        fine = score >= (score[rows, best] - margin)[:, None]
        fine[rows, best] = False
        r, c = np.nonzero(fine)
        return names[rows, best], np.split(names[r, c], np.searchsorted(r, np.arange(1, len(x))))
    held = min(many + 1, score.shape[1])
    near = np.argpartition(-score, held - 1, axis=1)[:, :held] if held < score.shape[1] else np.tile(np.arange(held), (len(x), 1))
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1), 1)
    near = np.take_along_axis(names, near, 1)
    return near[:, 0], list(near[:, 1:])


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared norms of the sums): a beam over the codebooks keeps the sums nearest to x."""
    n = len(x)
    sums, codes, norms = np.zeros((n, 1, x.shape[1]), np.float32), np.zeros((n, 1, 0), np.int32), np.zeros((n, 1), np.float32)
    for book in books:
        # |x - s - c|^2 = |x|^2 - 2 x(s + c) + |s + c|^2
        own = (book**2).sum(1)
        grown = norms[:, :, None] + own + 2 * (sums @ book.T)
        loss = grown - 2 * ((x[:, None, :] * sums).sum(2)[:, :, None] + (x @ book.T)[:, None, :])
        wide, kept = loss.reshape(n, -1), min(BEAM, loss.shape[1] * loss.shape[2])
        best = np.argpartition(wide, kept - 1, axis=1)[:, :kept] if kept < wide.shape[1] else np.tile(np.arange(wide.shape[1]), (n, 1))
        beam, word = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        sums = sums[rows, beam] + book[word]
        codes = np.concatenate([codes[rows, beam], word[:, :, None].astype(np.int32)], axis=2)
        norms = (sums**2).sum(2)
    final = ((x[:, None, :] - sums) ** 2).sum(2).argmin(1)
    rows = np.arange(n)
    return codes[rows, final], norms[rows, final]


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _unpacked(column: pa.ChunkedArray, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(n, -1)


CODED = "model_revision INT, chunk_id STRING, list INT, codes BINARY, norm FLOAT, kept FLOAT, vector BINARY, probes ARRAY<INT>, content BIGINT, content2 BIGINT"
_FOUND = "model_revision INT, chunk_id STRING, other_id STRING, cosine DOUBLE"


def code(spark: SparkSession, rows: DataFrame, given: DataFrame, probes: int, margin: float | None, books: int = BOOKS, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """The coded vectors (CODED) and the codebooks by revision.

    Sizes and sample are taken from ``given``, the rows before repeats are left out, so that these are
    sought once. Codebooks are fitted to at most about ``sample`` vectors of a revision; every vector is coded.
    ``probes`` and ``margin`` say in which further lists a row's neighbours are sought (see near_lists).
    ``kept`` is the cosine of a vector and its code; content and content2 are hashes of the vector's values.
    """
    counts = {r[0]: r[1] for r in given.groupBy("model_revision").count().collect()}  # one row a known model revision
    share = F.lit(1.0)
    for revision, n in counts.items():
        share = F.when(F.col("model_revision") == revision, min(1.0, sample / n)).otherwise(share)
    picked = given.where(F.col("vector").isNotNull() & (F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < share * (1 << 30))).select("chunk_id", "model_revision", "vector").toArrow()
    held: dict[int, list[np.ndarray]] = {}
    for batch in picked.to_batches():
        for revision, _, x, _ in _by_revision(batch):
            if x.shape[1] == held.setdefault(revision, [x])[0].shape[1] and held[revision][0] is not x:
                held[revision].append(x)
    fitted = {r: fit(np.concatenate(x), max(8, int(np.sqrt(counts[r]))), books) for r, x in held.items()}
    shared = spark.sparkContext.broadcast(fitted)  # FIRST_LISTS + (1 + books) * WORDS words a revision at most

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                for revision, ids, x, at in _by_revision(whole.slice(start, 1024)):
                    own = shared.value.get(revision)
                    if own is None:
                        continue
                    codes, norms = encode(x, own)
                    sums = sum(book[codes[:, level]] for level, book in enumerate(own))
                    kept = (x * sums).sum(1) / np.sqrt(np.maximum(norms, 1e-12))
                    near, further = near_lists(x, own, probes, margin)
                    hashes = [whole.slice(start, 1024).column(c).take(pa.array(at)) for c in ("content", "content2")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([revision] * len(ids), pa.int32()), pa.array(ids, pa.string()), pa.array(near, pa.int32()), _packed(codes.astype(np.uint16)), pa.array(norms, pa.float32()), pa.array(kept, pa.float32()), _packed(x), pa.array(further, pa.list_(pa.int32())), *hashes],
                        ["model_revision", "chunk_id", "list", "codes", "norm", "kept", "vector", "probes", "content", "content2"],
                    )

    hashed = rows.select("chunk_id", "model_revision", "vector", F.xxhash64("vector").alias("content"), F.xxhash64(F.lit(1), "vector").alias("content2"))
    return materialise(spark, hashed.mapInArrow(coded, CODED), "coded"), fitted


def _scored(spark: SparkSession, coded: DataFrame, books: dict[int, list[np.ndarray]], asks: Column, k: int, least: float | None) -> DataFrame:
    """(model_revision, chunk_id, other_id, cosine): what each asking row finds in each part of each of its lists.

    With ``least`` all partners of at least that cosine; else at least the k nearest of every part, by codes
    and then exactly. A list with many members is split into parts and its queries into turns, each a task
    of its own, so no task grows with the largest list.
    """
    lists = ["model_revision", "in"]
    sizes = coded.groupBy("model_revision", F.col("list").alias("in")).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    turns = coded.where(asks).select("model_revision", F.explode(F.concat("probes", F.array("list"))).alias("in")).groupBy(*lists).agg(F.ceil(F.count(F.lit(1)) / TURN).cast("int").alias("turns"))
    crowd = F.broadcast(sizes.join(turns, lists))  # one row a list: the square root of the vectors

    part = F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")
    turn = F.pmod(F.xxhash64(F.lit(1), "chunk_id"), F.col("turns")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = ["codes", "norm", "kept"]
    member = coded.select("model_revision", F.col("list").alias("in"), "chunk_id", *held, "vector", asks.alias("asks")).join(crowd, lists)
    base = member.withColumn("part", part).withColumn("turn", every("turns")).withColumn("asks", F.col("asks") & (F.col("turn") == turn)).withColumn("member", F.lit(True))
    ask = coded.where(asks).select("model_revision", F.explode("probes").alias("in"), "chunk_id", "vector").join(crowd, lists).withColumn("part", every("parts"))
    same = member.where(F.col("asks") & (F.col("parts") > 1)).withColumn("own", part).withColumn("part", every("parts")).where("part <> own")
    empty = {c: F.lit(None).cast(member.schema[c].dataType) for c in held}
    columns = [*lists, "part", "turn", "chunk_id", *held, "vector", "asks", "member"]
    union = base.select(columns)
    for other in (ask, same):
        union = union.unionByName(other.withColumn("turn", turn).withColumns({**empty, "asks": F.lit(True), "member": F.lit(False)}).select(columns))
    shared = spark.sparkContext.broadcast(books)

    def search(group: pa.Table) -> pa.Table:
        revision = group.column("model_revision")[0].as_py()
        own = shared.value[revision]
        is_member = group.column("member").to_numpy(zero_copy_only=False).astype(bool)
        is_query = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids = np.asarray(group.column("chunk_id").to_pylist(), dtype=object)
        x = _unpacked(group.column("vector"), np.float32, len(ids))
        base, asked = np.flatnonzero(is_member), np.flatnonzero(is_query)
        by_id = np.argsort(ids[base].astype(str), kind="stable")  # places then follow ids, which settles ties
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if base.size and asked.size:
            codes = _unpacked(group.filter(pa.array(is_member)).column("codes"), np.uint16, base.size).astype(np.int64)[by_id]
            base = base[by_id]
            norms, kept = (np.asarray(group.column(c).to_numpy(zero_copy_only=False)[base], dtype=np.float32) for c in ("norm", "kept"))
            scale = 1 / np.sqrt(np.maximum(norms, 1e-12))
            vectors = x[base]
            if least is not None:
                # The angle of a partner to the query is at most that of the bound, its code's at most so much more: none is missed.
                bound = np.cos(np.minimum(np.arccos(least) + np.arccos(np.clip(kept, -1, 1)), np.pi)) - 1e-3
            keep = min(k * KEPT + 1, base.size)
            for start in range(0, asked.size, BLOCK):
                q = asked[start : start + BLOCK]
                score = np.zeros((q.size, base.size), np.float32)
                for level, book in enumerate(own):
                    if len(book) > 1:
                        score += np.take(x[q] @ book.T, codes[:, level], axis=1)
                score *= scale
                if least is not None:
                    r, c = np.nonzero(score >= bound)
                    other = q[r] != base[c]
                    other[other] = ids[q[r[other]]] != ids[base[c[other]]]
                    r, c = r[other], c[other]
                    exact = np.concatenate([np.einsum("id,id->i", x[q[r[i : i + 65536]]], vectors[c[i : i + 65536]], dtype=np.float64, casting="unsafe") for i in range(0, r.size, 65536)] or [np.zeros(0)])
                    fine = exact >= least
                    r, c, exact = r[fine], c[fine], exact[fine]
                else:
                    best = np.sort(np.argpartition(-score, keep - 1, axis=1)[:, :keep], axis=1) if keep < base.size else np.tile(np.arange(base.size), (q.size, 1))
                    value = np.einsum("qd,qkd->qk", x[q], vectors[best], dtype=np.float64, casting="unsafe")
                    value[ids[base][best] == ids[q][:, None]] = -9
                    top = np.argsort(-value, axis=1, kind="stable")[:, :k]
                    value = np.take_along_axis(value, top, 1)
                    r, at = np.nonzero(value >= -1.5)
                    c, exact = best[r, top[r, at]], value[r, at]
                found.append((ids[q[r]], ids[base[c]], exact))
        one = [np.concatenate(f) for f in zip(*found)] if found else [np.zeros(0, object), np.zeros(0, object), np.zeros(0)]
        return pa.table({"model_revision": pa.array([revision] * len(one[0]), pa.int32()), "chunk_id": pa.array(list(one[0]), pa.string()), "other_id": pa.array(list(one[1]), pa.string()), "cosine": pa.array(one[2], pa.float64())})

    return union.groupBy(*lists, "part", "turn").applyInArrow(search, _FOUND)


def neighbours(spark: SparkSession, rows: DataFrame, k: int = 10, probes: int = WIDE_PROBES, queries: Column | None = None, given: DataFrame | None = None, books: int = WIDE_BOOKS) -> DataFrame:
    """(model_revision, chunk_id, other_id, cosine): for each query row its k most similar other rows of its revision.

    rows: (chunk_id, model_revision, vector), unique by chunk_id, of one width a revision. ``queries`` picks
    the query rows, else all are. Null vectors, non-finite values and zero vectors are left out. Ties go by
    other_id. Copies are neighbours of each other. A revision with one usable row has no neighbours.
    """
    coded, fitted = code(spark, rows, rows if given is None else given, probes, None, books)
    scored = _scored(spark, coded, fitted, F.lit(True) if queries is None else queries, k, None)
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "other_id"))), 1, k)  # k rows of each probed part at most
    each = scored.groupBy("model_revision", "chunk_id").agg(top.alias("top")).select("model_revision", "chunk_id", F.explode("top").alias("t"))
    return each.select("model_revision", "chunk_id", F.col("t.other_id").alias("other_id"), (-F.col("t.c")).alias("cosine"))


def near_classes(spark: SparkSession, rows: DataFrame, least: float, given: DataFrame | None = None, margin: float = NEAR_MARGIN) -> tuple[DataFrame, DataFrame]:
    """Rows of equal vectors are one class. Gives the pairs of classes with a cosine of at least ``least``, and the members.

    pairs: (class_a, class_b), the smaller id first; members: (chunk_id, class_id) of every usable row, where
    a class is named by its least chunk_id. Rows as for ``neighbours``. Only one row of a class is searched with
    and searched for, so copies cost nothing, however many; all partners in the lists looked at are found.
    """
    coded, fitted = code(spark, rows, rows if given is None else given, 0, margin)
    named = coded.select("chunk_id", F.concat_ws("/", "model_revision", "content", "content2").alias("_of"))
    classes = named.groupBy("_of").agg(F.min("chunk_id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = [r[0] for r in classes.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "_of").limit(MAX_HOT_KEYS).collect()]
    named = salted_lookup(named, classes.drop("n"), "_of", hot)
    members = materialise(spark, named.select("chunk_id", F.coalesce("class_id", "chunk_id").alias("class_id")), "classes")
    single, copies = coded, members.where("chunk_id <> class_id").select("chunk_id")
    if n := copies.count():
        single = coded.join(F.broadcast(copies) if n <= FEW_COPIES else copies, "chunk_id", "left_anti")
    found = _scored(spark, single, fitted, F.lit(True), 0, least)
    return found.select(F.least("chunk_id", "other_id").alias("class_a"), F.greatest("chunk_id", "other_id").alias("class_b")).distinct(), members
