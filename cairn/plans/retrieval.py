"""Queries over vectors and texts: top-k, lexical search, fusion, budgets, evaluation, chunks, entities."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import chunks
from cairn.functions import text as X
from cairn.functions import vectors as V
from cairn.operators import retrieval as R
from cairn.plans.records import E, M, memories
from cairn.plans.registry import Catalog
from cairn.session import materialise, table

C = Catalog()
TERMS = ["claims", "vectors", "evidence", "receipts"]
K = 20
#: Words that the lexical index leaves out, and the longest it keeps; our own values.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")
LONGEST = 64
#: Dimensions of the token vectors.
DIMS = 8


def _query(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_COS = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"
_SCORED = f"SELECT e.vec_id, e.label, {_COS} AS raw FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@C.query(f"WITH s AS ({_SCORED}) SELECT vec_id, round(raw, 6) AS score FROM s ORDER BY raw DESC, vec_id LIMIT {K}")
def t1_topk(spark, d):
    """Exact cosine top-k against vector 0."""
    return R.top_k(table(spark, d, "embeddings"), _query(spark, d), K)


@C.query(f"WITH s AS ({_SCORED}), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY raw DESC, vec_id) AS rank FROM s) SELECT label, vec_id, round(raw, 6) AS score, rank FROM r WHERE rank <= 3")
def t1_topk_by_label(spark, d):
    """The 3 vectors of each label most like vector 0."""
    s = table(spark, d, "embeddings").select("vec_id", "label", V.cosine_to(F.col("embedding"), _query(spark, d)).alias("raw"))
    ranked = s.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("raw"), "vec_id"))).where("rank <= 3")
    return ranked.select("label", "vec_id", F.round("raw", 6).alias("score"), "rank")


@C.query("SELECT chunk_id, model_revision, updated, vector IS NULL AS missing, len(vector) = dims AS fits, CASE WHEN vector IS NOT NULL THEN len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 END AS finite FROM (SELECT DISTINCT chunk_id, model_revision, updated, dims, vector FROM stored_vector)")
def vector_x5_checks(spark, d):
    """Width and finiteness of every stored vector."""
    v = table(spark, d, "stored_vector").select("chunk_id", "model_revision", "updated", "dims", "vector").distinct()
    return v.select("chunk_id", "model_revision", "updated", F.col("vector").isNull().alias("missing"), (F.size("vector") == F.col("dims")).alias("fits"), F.when(F.col("vector").isNotNull(), V.finite(F.col("vector"))).alias("finite"))


@C.query("SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first_part FROM embeddings")
def vector_x6_normalise(spark, d):
    """Norms, and the first part of each unit vector."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.round(V.normalised(F.col("embedding"))[0], 5).alias("first_part"))


@C.query("WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) SELECT label, d::INT AS dim, round(avg(x), 5) AS mean FROM e GROUP BY 1, 2")
def vector_a9_pool(spark, d):
    """Mean vector of each label, one row a dimension."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    return e.groupBy("label", (F.col("d") + 1).alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


def _postings(spark, d, split=X.words):
    words = table(spark, d, "documents").select("doc_id", F.explode(split(F.col("text"))).alias("word")).where(~F.col("word").isin(*STOP_WORDS) & (F.length("word") <= LONGEST))
    return materialise(spark, words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n")), "postings")


def _recent(spark, d):
    return table(spark, d, "documents").where("captured_at IS NOT NULL").select("doc_id", F.unix_seconds("captured_at").alias("score"))


#: The words of a text as X.words gives them.
_WORDS = (
    "flatten(list_transform(regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '[" + X.DROPPED + "]', '', 'g'))), '" + X.WORD + "'), "
    "lambda w: CASE WHEN regexp_matches(w, '^[" + X.DENSE + "]{2}') THEN list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) ELSE [w] END))"
)
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_P = f"w0 AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents WHERE text IS NOT NULL), w AS (SELECT * FROM w0 WHERE word NOT IN ({_STOP}) AND length(word) <= {LONGEST}), p AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2), l AS (SELECT doc_id, sum(n) AS len FROM p GROUP BY 1), s AS (SELECT count(*) AS docs, avg(len) AS mean FROM l), f AS (SELECT word, count(*) AS df FROM p GROUP BY 1)"
_T = ", ".join(f"'{t}'" for t in TERMS)
_BM25 = f"SELECT p.doc_id, round(sum(ln(1 + (s.docs - f.df + 0.5) / (f.df + 0.5)) * p.n * 2.2 / (p.n + 1.2 * (0.25 + 0.75 * l.len / s.mean))), 6) AS score FROM p JOIN l USING (doc_id) JOIN f USING (word), s WHERE p.word IN ({_T}) GROUP BY 1"


@C.query(f"WITH {_P} SELECT word, sum(n)::BIGINT AS occurrences, count(*) AS documents FROM p GROUP BY 1")
def text_x8_postings(spark, d):
    """Words with their occurrences and documents."""
    return _postings(spark, d).groupBy("word").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


@C.query(f"WITH {_P} {_BM25}")
def text_x8_bm25(spark, d):
    """BM25 scores of all documents for a query of four words."""
    return R.bm25(_postings(spark, d), TERMS)


@C.query(f"WITH {_P}, a AS ({_BM25}), ra AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank_lexical FROM (SELECT * FROM a ORDER BY score DESC, doc_id LIMIT 100)), b AS (SELECT doc_id, epoch(captured_at)::BIGINT AS score FROM documents WHERE captured_at IS NOT NULL), rb AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank_recent FROM (SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 100)) SELECT coalesce(ra.doc_id, rb.doc_id) AS doc_id, rank_lexical, rank_recent, round(coalesce(1.0 / (60 + rank_lexical), 0) + coalesce(1.0 / (60 + rank_recent), 0), 8) AS score FROM ra FULL JOIN rb ON ra.doc_id = rb.doc_id")
def text_x9_x10_fusion(spark, d):
    """Lexical and recency channels fused by reciprocal ranks, with the ranks kept as a trace."""
    return R.fused({"lexical": R.bm25(_postings(spark, d), TERMS), "recent": _recent(spark, d)})


@C.query(f"WITH {M}, r AS (SELECT scope_id, id, created, ceil(octet_length(encode(text)) / 3.0)::BIGINT AS size FROM m WHERE status = 'active' AND text IS NOT NULL), t AS (SELECT *, (sum(size) OVER (PARTITION BY scope_id ORDER BY created DESC, id ROWS UNBOUNDED PRECEDING))::BIGINT AS total, row_number() OVER (PARTITION BY scope_id ORDER BY created DESC, id) AS rank FROM r) SELECT scope_id, id, size, total, rank FROM t WHERE total <= 4000 OR rank = 1")
def text_x11_budget(spark, d):
    """The newest memories of each scope that fit a token budget; the first always stays."""
    m = memories(spark, d, "status = 'active' AND text IS NOT NULL").select("scope_id", "id", "created", "text", F.struct((-F.col("created")).alias("c"), "id").alias("place"))
    return R.packed(m, ["scope_id"], "place", F.ceil(F.octet_length("text") / 3.0), 4000).select("scope_id", "id", "size", "total", F.col("rank").cast("bigint").alias("rank"))


#: The queries of the evaluation, one word each; the last finds nothing.
ASKED = [*TERMS, "zzqx"]
_A = ", ".join(f"'{t}'" for t in ASKED)


@C.query(f"""WITH {_P}, b AS (SELECT p.word AS query, p.doc_id, round(ln(1 + (s.docs - f.df + 0.5) / (f.df + 0.5)) * (p.n * 2.2 / (p.n + 1.2 * (0.25 + 0.75 * l.len / s.mean))), 6) AS score FROM p JOIN l USING (doc_id) JOIN f USING (word), s WHERE p.word IN ({_A})),
 r AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= {R.DEEPEST}), t AS (SELECT p.word AS query, p.doc_id FROM p JOIN documents d USING (doc_id) WHERE d.source = 'glossary' AND p.word IN ({_A})), n AS (SELECT query, count(*) AS n FROM t GROUP BY 1), h AS (SELECT r.* FROM r JOIN t USING (query, doc_id)),
 q AS (SELECT n.query, n.n, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 20) AS h20, min(rank) AS first, coalesce(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0) END), 0) AS dcg FROM n LEFT JOIN h USING (query) GROUP BY 1, 2), c AS (SELECT query, count(*) AS n FROM b GROUP BY 1)
 SELECT round(avg(h5 / n), 6) AS recall_5, round(avg(h10 / n), 6) AS recall_10, round(avg(h20 / n), 6) AS recall_20, round(avg(h5 / 5), 6) AS precision_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(dcg / (SELECT sum(1 / log2(i + 1.0)) FROM range(1, 11) x(i) WHERE i <= n)), 6) AS ndcg_10,
 (SELECT round(({len(ASKED)} - count(*)) / {len(ASKED)}.0, 6) FROM c) AS no_answer, (SELECT round(count(*) FILTER (n > {R.DEEPEST}) / {len(ASKED)}.0, 6) FROM c) AS truncated FROM q""")
def text_x15_evaluation(spark, d):
    """Quality of the BM25 ranking for a few queries if the glossary's documents with the word were the relevant ones, with the rates of no answer and of longer answers."""
    postings = _postings(spark, d)
    scores = materialise(spark, R.bm25_each(postings, ASKED), "scores")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    ranked = scores.withColumn("rank", place).where(F.col("rank") <= R.DEEPEST)  # the rank is limited before the shuffle
    glossary = table(spark, d, "documents").where("source = 'glossary'").select("doc_id")
    truth = postings.where(F.col("word").isin(ASKED)).join(glossary, "doc_id", "left_semi").select(F.col("word").alias("query"), "doc_id")
    quality, rates = R.evaluated(ranked, truth), R.answered(scores, len(ASKED)).first()
    return quality.withColumns({c: F.lit(rates[c]) for c in ("no_answer", "truncated")})


@C.query("WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL) SELECT event_type, min(value) FILTER (r >= ceil(c * 0.50)) AS p50, min(value) FILTER (r >= ceil(c * 0.95)) AS p95, min(value) FILTER (r >= ceil(c * 0.99)) AS p99 FROM n GROUP BY 1")
def agg_x16_percentiles(spark, d):
    """Percentiles of event values by nearest rank."""
    return R.nearest_rank(table(spark, d, "events"), ["event_type"], "value", [50, 95, 99])


@C.query("SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[\\t\\n\\x0b\\f\\r ]|\\n', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s, ' ')) > 0))::BIGINT AS sentences FROM documents WHERE text IS NOT NULL")
def text_x1_sentences(spark, d):
    """Plain sentences of each document, counted."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.size(X.sentence_list(F.col("text"))).cast("bigint").alias("sentences"))


@C.query()
def text_x2_chunks(spark, d):
    """Byte spans of the embedding chunks of every memory."""
    return chunks.chunked(memories(spark, d), "id", "text")


#: Most frequent words that are pieces as a whole; characters are pieces without a bound but that of Unicode.
PIECE_WORDS = 2000


def _piece_vocabulary(spark, d):
    """Ids of pieces: the PIECE_WORDS most frequent words, then each character of the corpus, alone and inside a word."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def flat(texts):
        return texts.map(chunks.flat_words, na_action="ignore")

    words = table(spark, d, "documents").where("text IS NOT NULL").select(F.explode(flat("text")).alias("word"))
    counts = materialise(spark, words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "flat_words")
    top = [r[0] for r in counts.where(F.col("word").rlike(r"[\p{L}\p{N}]")).orderBy(F.desc("n"), "word").limit(PIECE_WORDS).collect()]
    characters = sorted(r[0] for r in counts.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())
    return {p: i for i, p in enumerate(dict.fromkeys([*top, *characters, *(f"##{c}" for c in characters)]))}


@C.query()
def text_x3_pieces(spark, d):
    """Word pieces of every document and their ids, by a vocabulary of the corpus' most frequent words and all its characters; what is unknown has the id after the last."""
    vocabulary = _piece_vocabulary(spark, d)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts):
        return texts.map(lambda t: chunks.word_pieces(t, vocabulary), na_action="ignore")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def numbered(pieces):
        return pieces.map(lambda p: [vocabulary.get(x, len(vocabulary)) for x in p], na_action="ignore")

    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", split("text").alias("p"))
    return docs.select("doc_id", F.size("p").alias("pieces"), F.size(F.filter("p", lambda x: x == "[UNK]")).alias("unknown"), numbered("p").alias("ids"))


@C.query(f"WITH w0 AS (SELECT doc_id, {_WORDS}[1:512] AS ws FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, unnest(ws) AS token FROM w0), e AS (SELECT vec_id, unnest(embedding[1:{DIMS}])::DOUBLE AS x, generate_subscripts(embedding[1:{DIMS}], 1) AS d FROM embeddings), t AS (SELECT token, d, avg(x) AS x FROM (SELECT DISTINCT doc_id, token FROM w) u JOIN e ON e.vec_id = u.doc_id GROUP BY 1, 2), m AS (SELECT doc_id, d, avg(x) AS x FROM w JOIN t USING (token) GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(x * x)) AS s FROM m GROUP BY 1) SELECT doc_id, d::INT AS dim, round(x / s, 4) AS part FROM m JOIN n USING (doc_id) WHERE s > 0")
def text_x4_static_embedding(spark, d):
    """Mean-pooled token vectors of every document: its first 512 words, those without a vector left out, normalised.

    A word's vector is the mean embedding of the documents that hold it and have one (the first DIMS dimensions).
    """
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.explode(F.slice(X.words(F.col("text")), 1, 512)).alias("token"))
    counted = materialise(spark, docs.groupBy("id", "token").agg(F.count(F.lit(1)).alias("n")), "tokens")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.slice("embedding", 1, DIMS)).alias("d", "x"))
    known = counted.select("id", "token").join(e, "id").groupBy("token", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = known.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("vector"))
    pooled = chunks.static_embedding(counted, vectors)
    return pooled.select(F.col("id").alias("doc_id"), F.posexplode("vector").alias("p", "x")).select("doc_id", (F.col("p") + 1).alias("dim"), F.round("x", 4).alias("part"))


_SCRUBS = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[mail]"), (r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", "[card]"), (r"\+[0-9]{1,3}(?:[ .-]?[(]?[0-9]{1,5}[)]?){2,6}|[(][0-9]{3}[)] ?[0-9]{3}-[0-9]{4}|\b0[0-9]{2,4} [0-9]{3,6}(?: [0-9]{3,4})?\b", "[phone]"))
_SCRUBBED = "text"
for _pattern, _mark in _SCRUBS:
    _SCRUBBED = f"regexp_replace({_SCRUBBED}, '{_pattern}', '{_mark}', 'g')"


@C.query(f"WITH {M} SELECT id, sha256({_SCRUBBED}) AS scrubbed, text <> {_SCRUBBED} AS changed FROM m WHERE text IS NOT NULL AND NOT (" + " OR ".join(f"regexp_matches(text, '{p}')" for p in X.DETECTORS.values()) + ")")
def text_v17_scrub(spark, d):
    """Texts scrubbed of mail addresses, card and phone numbers; texts with a credential are dropped."""
    m = memories(spark, d, "text IS NOT NULL").where(X.detected(F.col("text")).isNull())
    t = F.col("text")
    for pattern, mark in _SCRUBS:
        t = F.regexp_replace(t, pattern, mark)
    return m.select("id", F.sha2(t, 256).alias("scrubbed"), (F.col("text") != t).alias("changed"))


#: Price of a million tokens in millionths, by model, where it is known; our own example.
PRICES = {"tern-embed": 20_000}


@C.query(f"WITH {M}, t AS (SELECT count(*) AS memories, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(ceil(octet_length(encode(text)) / 3.0))::BIGINT AS tokens FROM m WHERE status = 'active' AND text IS NOT NULL) SELECT r.model_id, r.revision, t.memories, t.bytes, t.tokens, CASE WHEN r.model_id = 'tern-embed' THEN ceil(t.tokens * {PRICES['tern-embed']} / 1000000.0)::BIGINT END AS cost, CASE WHEN r.model_id <> 'tern-embed' THEN 'pricing unknown' END AS note FROM model_revision r, t")
def agg_x18_preview(spark, d):
    """What embedding all active records anew would read and cost with each model revision."""
    m = memories(spark, d, "status = 'active' AND text IS NOT NULL")
    t = m.agg(F.count(F.lit(1)).alias("memories"), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.ceil(F.octet_length("text") / 3.0)), F.lit(0)).alias("tokens")).first()
    price = F.coalesce(*[F.when(F.col("model_id") == k, v) for k, v in PRICES.items()])
    sums = {k: F.lit(t[k]).cast("bigint") for k in ("memories", "bytes", "tokens")}
    return table(spark, d, "model_revision").select("model_id", "revision").withColumns({**sums, "cost": F.ceil(F.lit(t["tokens"]).cast("double") * price / 1_000_000), "note": F.when(price.isNull(), "pricing unknown")})


@C.query("WITH v AS (SELECT DISTINCT memory_id, chunk_ordinal AS o, model_revision AS r FROM stored_vector), s AS (SELECT memory_id, r, o, d AS radius, CASE WHEN o - lag(o) OVER (PARTITION BY memory_id, r, d ORDER BY o) <= 2 * d THEN 0 ELSE 1 END AS start FROM v, range(1, 4) x(d)), g AS (SELECT *, sum(start) OVER (PARTITION BY memory_id, r, radius ORDER BY o) AS run FROM s) SELECT memory_id, r AS model_revision, radius::INT AS radius, min(o) AS first_chunk, max(o) AS last_chunk, count(*) AS chunks FROM g GROUP BY memory_id, r, radius, run")
def window_w3_units(spark, d):
    """Chunks of a memory joined to units where their windows meet, for the radii 1 to 3."""
    v = table(spark, d, "stored_vector").select("memory_id", F.col("chunk_ordinal").alias("o"), "model_revision").distinct().withColumn("radius", F.explode(F.sequence(F.lit(1), F.lit(3))))
    key = ["memory_id", "model_revision", "radius"]
    w = W.partitionBy(*key).orderBy("o")
    s = v.withColumn("start", F.when(F.col("o") - F.lag("o").over(w) <= 2 * F.col("radius"), 0).otherwise(1)).withColumn("run", F.sum("start").over(w))
    return s.groupBy(*key, "run").agg(F.min("o").alias("first_chunk"), F.max("o").alias("last_chunk"), F.count(F.lit(1)).alias("chunks")).drop("run")


@C.query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def tpch_q1(spark, d):
    """Summary of line items by flag and status."""
    l = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"))


QUERIES, ORACLES = C.queries, C.oracles
