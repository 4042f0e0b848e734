"""Token ids of a whole corpus: each distinct word is encoded once, over the whole cluster.

Texts are cut into pre-tokens by the tokenizer's pattern, inside the JVM. The distinct pre-tokens are
encoded once, their ids are joined back to the positions, and each text is put together again. A table of
words that is small by measure is broadcast and joined to the words where they lie, a batch of texts at a
time; a larger one meets the words in a shuffled join whose frequent words, at most a thousand, are
salted, and texts are put together from rows sorted by position.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.skew import HOT_ROWS, MAX_HOT_KEYS, salted_lookup
from cairn.session import materialise

#: The folder of the tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes up to which the table of distinct words is broadcast whole; its size is measured first.
BROADCAST_BYTES = 32 << 20
#: Fixed value: the pre-token pattern of this vocabulary. (?U) lets \\s mean white space of Unicode in Java as well.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a file of ranks, loaded once a process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pre_tokens(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit("(?U)" + PATTERN), F.lit(0))


def words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, pos, word): the pre-tokens of each text. The hash keeps different texts of one id apart."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(_pre_tokens(text)).alias("pos", "word"))


def vocabulary(spark: SparkSession, tokens: DataFrame, path: str) -> DataFrame:
    """(word, n, ids): each distinct word with its number of occurrences and its ids."""

    @F.pandas_udf("array<int>")
    def encode(column: pd.Series) -> pd.Series:
        own = encoder(path)
        return pd.Series([own.encode_ordinary(w) for w in column])

    counted = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n")).repartition(spark.sparkContext.defaultParallelism)  # encoding a word costs more than moving it
    return materialise(spark, counted.select("word", "n", encode("word").alias("ids")), "vocabulary")


def held_bytes(vocab: DataFrame) -> int:
    """About the bytes that a broadcast of the words and their ids takes."""
    each = F.octet_length("word") + 4 * F.size("ids") + 64
    return vocab.agg(F.coalesce(F.sum(each.cast("bigint")), F.lit(0))).first()[0]


def hot_words(vocab: DataFrame) -> list[str]:
    """The most frequent words, at most MAX_HOT_KEYS."""
    return [r[0] for r in vocab.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "word").limit(MAX_HOT_KEYS).select("word").collect()]


def encode_corpus(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(doc_id, ids): the token ids of every row's text, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts give the empty list.
    A row repeated with the same text counts once; different texts of one id give a row each. Other
    columns are ignored. A document's ids come together in one task, as they are one value.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids ARRAY<INT>"
    vocab = vocabulary(spark, words(docs, "doc_id", "text"), path)
    if held_bytes(vocab) <= BROADCAST_BYTES:
        once = docs.groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.first("text").alias("text"))
        found = F.coalesce(_pre_tokens("text"), F.array().cast("array<string>"))
        return once.select("doc_id", found.alias("words")).mapInArrow(_joined_in_place(spark, vocab), schema)
    joined = salted_lookup(words(docs, "doc_id", "text"), vocab.select("word", "ids"), "word", hot_words(vocab)).repartition("doc_id")
    whole = joined.select("doc_id", "text_hash", "pos", "ids").sortWithinPartitions("doc_id", "text_hash", "pos")
    empty = docs.where(F.col("text").isNull() | (F.col("text") == "")).select("doc_id", F.array().cast("array<int>").alias("ids")).distinct()
    return whole.mapInArrow(_put_together, schema).unionByName(empty)


def _joined_in_place(spark: SparkSession, vocab: DataFrame):
    """A step from batches (doc_id, words) to (doc_id, ids): all words of a batch meet the broadcast table at once, and the lists keep their order."""
    sink = pa.BufferOutputStream()
    held = vocab.select("word", "ids").toArrow().combine_chunks()  # at most BROADCAST_BYTES
    with pa.ipc.new_stream(sink, held.schema) as out:
        out.write_table(held)
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        known, ids = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns)
        for batch in batches:
            lists = batch.column("words")
            at = pc.index_in(lists.flatten(), value_set=known)
            if at.null_count:
                raise ValueError("a word is not in the vocabulary made from the same texts")
            taken = ids.take(at)
            upto = np.concatenate([[0], np.cumsum(taken.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
            ends = upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            whole = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken.flatten())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), whole], ["doc_id", "ids"])

    return join


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (doc_id, ids) for each run of rows (doc_id, text_hash, pos, ids) of one text, which come in order; repeated rows count once.

    A text may run over several batches; its ids so far are carried over.
    """
    last, carried = None, []

    def batch_of(docs: pa.Array, ends: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([docs, lists], ["doc_id", "ids"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        doc, text, pos = batch.column("doc_id"), batch.column("text_hash").to_numpy(), batch.column("pos").to_numpy()
        ids = batch.column("ids")
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.asarray(ids.offsets.to_numpy(), dtype=np.int64)
        ends = ends - ends[0]
        other = np.ones(n, bool)  # does a row belong to another text than the row before?
        other[1:] = text[1:] != text[:-1]
        changed = pc.fill_null(pc.not_equal(doc[1:], doc[:-1]), True).to_numpy(zero_copy_only=False)  # a null id is told apart by its text
        other[1:] |= changed & ~(np.asarray(doc[1:].is_null()) & np.asarray(doc[:-1].is_null()))
        other[0] = last is None or last[:2] != (doc[0].as_py(), text[0])
        again = np.zeros(n, bool)
        again[1:] = ~other[1:] & (pos[1:] == pos[:-1])
        again[0] = not other[0] and last[2] == pos[0]
        sizes = np.where(again, 0, np.diff(ends))
        if again.any():
            flat = flat[np.repeat(~again, np.diff(ends))]
        at = np.concatenate([[0], np.cumsum(sizes)])
        begins = np.flatnonzero(other)
        first = at[begins[0]] if begins.size else at[-1]
        if first:
            carried.append(flat[:first])
        if begins.size:
            if last is not None:
                whole = np.concatenate(carried) if carried else flat[:0]
                yield batch_of(pa.array([last[0]], doc.type), np.array([0, whole.size]), whole)
            if begins.size > 1:
                cut = at[begins]
                yield batch_of(doc.take(pa.array(begins[:-1])), cut - cut[0], flat[cut[0] : cut[-1]])
            carried = [flat[at[begins[-1]] :]]
        last = (doc[n - 1].as_py(), text[n - 1], pos[n - 1])
    if last is not None:
        whole = np.concatenate(carried) if carried else np.zeros(0, np.int32)
        yield batch_of(pa.array([last[0]], doc.type), np.array([0, whole.size]), whole)


def count_tokens(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(doc_id, tokens) of every text that has any; the same words and ids, without putting texts together.

    Rows repeated with one id add up.
    """
    tokens = docs.select(F.col(doc_id).alias("doc_id"), F.explode(_pre_tokens(text)).alias("word"))
    vocab = vocabulary(spark, tokens, path)
    each = vocab.select("word", F.size("ids").cast("bigint").alias("each"))
    if held_bytes(vocab) <= BROADCAST_BYTES:
        return tokens.join(F.broadcast(each), "word").groupBy("doc_id").agg(F.sum("each").alias("tokens"))
    counted = tokens.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("times"))
    return salted_lookup(counted, each, "word", hot_words(vocab)).groupBy("doc_id").agg(F.sum(F.col("times") * F.col("each")).alias("tokens"))


def decode(spark: SparkSession, encoded: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(doc_id, text) from (doc_id, ids): joins the table of token bytes, whose size is the vocabulary's."""
    with open(path, "rb") as lines:
        table = [(int(b), bytearray(base64.b64decode(a))) for a, b in map(bytes.split, lines)]
    table = F.broadcast(spark.createDataFrame(pd.DataFrame(table, columns=["id", "bytes"]), "id INT, bytes BINARY"))
    each = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(table, "id")
    whole = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))).alias("parts"))
    text = whole.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")), "UTF-8").alias("text"))
    return text.unionByName(encoded.where(F.size("ids") == 0).select("doc_id", F.lit("").alias("text")))
