"""Queries over entities, walks, pages and channels of retrieval."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.functions import vectors as V
from cairn.operators import graph, records
from cairn.operators import retrieval as R
from cairn.plans.claims import H, history
from cairn.plans.records import E, M, NOW, edges, memories
from cairn.plans.registry import Catalog
from cairn.plans.retrieval import _WORDS
from cairn.session import materialise, table

C = Catalog()
FAN_OUT = 8
TERMS = ["claims", "receipts", "desk"]

_NEAR = f"""b AS (SELECT DISTINCT id, other FROM (SELECT memory_id AS id, parent_id AS other FROM e UNION ALL SELECT parent_id, memory_id FROM e) WHERE id <> other),
 k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY other) <= {FAN_OUT}), w AS (SELECT id, other, 1 AS step, id || '/' || other AS path FROM k UNION ALL SELECT a.id, c.other, 2, a.id || '/' || a.other || '/' || c.other FROM k a JOIN k c ON c.id = a.other WHERE a.id <> c.other),
 s AS (SELECT id, other, min((step, path)) AS way FROM w GROUP BY 1, 2)"""


@C.query(f"WITH {E}, {_NEAR} SELECT id, other, way[1] AS step, way[2] AS path FROM s")
def join_j9_walk(spark, d):
    """What lies within two steps of each record, with the way to it and a bound on the fan-out."""
    return graph.walked(edges(spark, d), FAN_OUT)


@C.query(f"WITH {M}, {E}, {_NEAR}, q AS (SELECT DISTINCT from_claim_id FROM claim_relation WHERE relation_kind = 'contradicts') SELECT s.id, s.other, s.way[1] AS step, s.way[2] AS path, m.kind, m.status FROM s JOIN m ON m.id = s.other WHERE m.status = 'active'")
def entity_v13_neighbours(spark, d):
    """The active records that a walk of two steps reaches, with the way to each."""
    m = memories(spark, d, "status = 'active'").select(F.col("id").alias("other"), "kind", "status")
    return graph.walked(edges(spark, d), FAN_OUT).join(m, "other").select("id", "other", "step", "path", "kind", "status")


@C.query(f"WITH {M}, g AS (SELECT coalesce(source, '?') AS source, count(*) AS n, max(created) AS newest, arg_max(id, (created, id)) AS newest_id FROM m WHERE status = 'active' GROUP BY 1) SELECT *, (SELECT count(*) FROM g) > 8 AS truncated FROM g ORDER BY newest DESC, source LIMIT 8")
def agg_a11_freshness(spark, d):
    """The newest active record and the number of each source: the 8 newest sources, and whether there are more."""
    m = memories(spark, d, "status = 'active'")
    g = m.groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.max("created").alias("newest"), F.max(F.struct("created", "id"))["id"].alias("newest_id"))
    return R.freshest(g, "newest", "source", 8)


@C.query(f"WITH {H}, v AS (SELECT DISTINCT ON (scope_id, subject_key, predicate_name, slot_key) scope_id, subject_namespace, subject_kind, subject_key, predicate_name, slot_key, claim_id, recorded_at FROM h WHERE erased = 0 ORDER BY scope_id, subject_key, predicate_name, slot_key, tx_seq DESC), a AS (SELECT scope_id, subject_key, count(*) AS claims, min(recorded_at) AS first, max(recorded_at) AS last, count(*) FILTER (claim_id IN (SELECT from_claim_id FROM claim_relation WHERE relation_kind = 'contradicts' UNION SELECT to_id FROM claim_relation WHERE relation_kind = 'contradicts')) AS contradictions FROM h WHERE erased = 0 GROUP BY 1, 2) SELECT a.scope_id, a.subject_key, any_value(v.subject_namespace) AS namespace, any_value(v.subject_kind) AS kind, a.claims, count(*) AS facts, a.contradictions, a.first, a.last, max(v.claim_id) AS last_fact FROM a JOIN v ON v.scope_id = a.scope_id AND v.subject_key = a.subject_key GROUP BY a.scope_id, a.subject_key, a.claims, a.contradictions, a.first, a.last")
def entity_x17_page(spark, d):
    """The page of each subject: what it is, its current facts (one a predicate and slot), its claims and contradictions, and its span of time."""
    h = history(spark, d, "erased = 0").select("scope_id", "subject_namespace", "subject_kind", "subject_key", "predicate_name", "slot_key", "claim_id", "tx_seq", "recorded_at")
    r = table(spark, d, "claim_relation").where("relation_kind = 'contradicts'")
    sides = r.select(F.col("from_claim_id").alias("claim_id")).union(r.select("to_id")).distinct().withColumn("_c", F.lit(1))
    a = h.join(sides, "claim_id", "left").groupBy("scope_id", "subject_key").agg(F.count(F.lit(1)).alias("claims"), F.min("recorded_at").alias("first"), F.max("recorded_at").alias("last"), F.count("_c").alias("contradictions"))
    v = h.groupBy("scope_id", "subject_key", "predicate_name", "slot_key").agg(F.max_by(F.struct("subject_namespace", "subject_kind", "claim_id"), "tx_seq").alias("f"))
    v = v.groupBy("scope_id", "subject_key").agg(F.first("f.subject_namespace").alias("namespace"), F.first("f.subject_kind").alias("kind"), F.count(F.lit(1)).alias("facts"), F.max("f.claim_id").alias("last_fact"))
    return a.join(v, ["scope_id", "subject_key"])


_MP = f"w AS (SELECT id, unnest({_WORDS}) AS word FROM m WHERE status = 'active' AND text IS NOT NULL), p AS (SELECT id, word, count(*) AS n FROM w GROUP BY 1, 2), l AS (SELECT id, sum(n) AS len FROM p GROUP BY 1), s AS (SELECT count(*) AS docs, avg(len) AS mean FROM l), f AS (SELECT word, count(*) AS df FROM p GROUP BY 1)"
_LIST = ", ".join(f"'{t}'" for t in TERMS)
_AGED = "pow(0.5, greatest({now} - {at}, 0) / 2592000.0)"


@C.query(f"""WITH {M}, {_MP}, a AS (SELECT p.id, round(sum(ln(1 + (s.docs - f.df + 0.5) / (f.df + 0.5)) * p.n * 2.2 / (p.n + 1.2 * (0.25 + 0.75 * l.len / s.mean))), 6) AS score FROM p JOIN l USING (id) JOIN f USING (word), s WHERE p.word IN ({_LIST}) GROUP BY 1),
 ra AS (SELECT id, row_number() OVER (ORDER BY score DESC, id)::INT AS rank_lexical FROM a QUALIFY rank_lexical <= 100), b AS (SELECT id, created FROM m WHERE status = 'active' AND created >= {NOW} - 31536000), rb AS (SELECT id, row_number() OVER (ORDER BY round({_AGED.format(now=NOW, at='created')}, 9) DESC, id)::INT AS rank_recent FROM b QUALIFY rank_recent <= 100),
 j AS (SELECT coalesce(ra.id, rb.id) AS id, rank_lexical, rank_recent FROM ra FULL JOIN rb ON ra.id = rb.id)
 SELECT j.id, rank_lexical, rank_recent, round((coalesce(1.0 / (60 + rank_lexical), 0) + coalesce(1.0 / (60 + rank_recent), 0)) * m.base::DOUBLE * {_AGED.format(now=NOW, at='m.last_used')}, 9) AS score FROM j JOIN m ON m.id = j.id""")
def text_x9_x10_recall(spark, d):
    """Records recalled by words and by recency (decayed, within a year), fused by reciprocal ranks and weighed by decayed importance; the ranks stay as a trace."""
    m = materialise(spark, memories(spark, d, "status = 'active'").select(F.col("id").alias("doc_id"), "text", "created", "base", "last_used"), "active")
    words = m.where("text IS NOT NULL").select("doc_id", F.explode(X.words(F.col("text"))).alias("word"))
    postings = materialise(spark, words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n")), "postings")
    recent = m.where(F.col("created") >= NOW - 31536000).select("doc_id", F.round(X.decayed(F.lit(1.0), F.col("created"), F.lit(NOW)), 9).alias("score"))
    ranked = R.fused({"lexical": R.bm25(postings, TERMS), "recent": recent}, digits=None)
    weighed = ranked.join(m.select("doc_id", X.decayed(F.col("base"), F.col("last_used"), F.lit(NOW)).alias("weight")), "doc_id")
    return weighed.select(F.col("doc_id").alias("id"), "rank_lexical", "rank_recent", F.round(F.col("score") * F.col("weight"), 9).alias("score"))


_LAST = "v AS (SELECT chunk_id, arg_max({'m': memory_id, 'r': model_revision, 'd': dims, 'v': vector}, (updated, model_revision)) AS x FROM stored_vector WHERE vector IS NOT NULL GROUP BY 1), u AS (SELECT chunk_id, x.m AS memory_id, x.v AS vector FROM v WHERE x.r = (SELECT max(revision) FROM model_revision WHERE active = 1) AND len(x.v) = 64 AND len(list_filter(x.v, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x.v, lambda y: y <> 0)) > 0)"
_SIZE = "sqrt(list_sum(list_transform({0}, lambda y: y::DOUBLE * y::DOUBLE)))"


@C.query(f"WITH {_LAST}, q AS (SELECT vector FROM u ORDER BY chunk_id LIMIT 1), s AS (SELECT u.memory_id, u.chunk_id, round(list_sum(list_transform(list_zip(u.vector, q.vector), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / ({_SIZE.format('u.vector')} * {_SIZE.format('q.vector')}), 5) AS score FROM u, q) SELECT memory_id, (min((-score, chunk_id)))[2] AS chunk_id, max(score) AS score FROM s GROUP BY 1")
def vector_a10_best_chunk(spark, d):
    """The chunk of each memory that is most like a query, which is the first usable chunk of the active revision."""
    revision = table(spark, d, "model_revision").where("active = 1").agg(F.max("revision")).first()[0]
    v = table(spark, d, "stored_vector").where("vector IS NOT NULL").groupBy("chunk_id").agg(F.max_by(F.struct("memory_id", "model_revision", "vector"), F.struct("updated", "model_revision")).alias("r"))
    u = v.select("chunk_id", "r.*").where((F.col("model_revision") == revision) & (F.size("vector") == 64) & V.finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)).drop("model_revision")
    u = materialise(spark, u, "usable")
    query = u.orderBy("chunk_id").select("vector").first()
    s = u.select("memory_id", "chunk_id", F.round(V.cosine_to(F.col("vector"), list(query[0]) if query else []), 5).alias("score"))
    return s.groupBy("memory_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk_id")).alias("b")).select("memory_id", "b.chunk_id", (-F.col("b.s")).alias("score"))


@C.query()
def entity_x12_spans(spark, d):
    """The entities of each record: whole names of the gazetteer, the longest at each place, at most 5 a text, with mentions and first place."""
    names = [r[0] for r in table(spark, d, "name_list").select("name").distinct().collect()]  # a fixed table
    found = memories(spark, d, "text IS NOT NULL").select(F.col("id").alias("doc_id"), graph.spans(F.col("text"), names).alias("found"))
    return graph.entities(found)


#: Fixed value: the closed list of predicates that edges may bear.
EDGE_KINDS = ("supersedes", "derived_from")


@C.query(f"SELECT relation_kind, count(*) AS edges, relation_kind IN {EDGE_KINDS} AS admitted, count(DISTINCT from_claim_id) AS sources FROM (SELECT DISTINCT scope_id, from_claim_id, relation_kind, to_id FROM claim_relation) GROUP BY 1")
def entity_v12_edges(spark, d):
    """Edges by predicate, and which are of the closed list; those that are not are rejected and counted."""
    e = table(spark, d, "claim_relation").select("scope_id", "from_claim_id", "relation_kind", "to_id").distinct()
    return e.groupBy("relation_kind").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("from_claim_id").alias("sources")).withColumn("admitted", F.col("relation_kind").isin(*EDGE_KINDS))


@C.query(f"WITH {M} SELECT id, scope_id, status, kind FROM m WHERE status IN ('active') AND kind IN ('fact', 'decision')")
def filter_p2_default(spark, d):
    """Records by the default set of statuses and two kinds."""
    return records.filtered(memories(spark, d, "status = 'active'"), kinds={"fact", "decision"}).select("id", "scope_id", "status", "kind")


@C.query("""SELECT * FROM (VALUES ('{"kinds":["decision","fact"],"statuses":["active"]}'), ('{"kinds":[],"statuses":["active","expired"]}')) v(filter) CROSS JOIN LATERAL (SELECT sha256(filter) AS digest)""")
def filter_p3_digest(spark, d):
    """The digests of two filters, by which a cursor is bound to its filter; they do not depend on the order in which sets are given."""
    rows = [(records.filter_text(kinds={"fact", "decision"}),), (records.filter_text(statuses={"expired", "active"}),)]
    return spark.createDataFrame(rows, "filter STRING").withColumn("digest", F.sha2("filter", 256))


@C.query(f"WITH {M}, {E}, g AS (SELECT id FROM m WHERE status = 'erased'), i AS (SELECT DISTINCT memory_id AS id FROM e), o AS (SELECT DISTINCT memory_id AS id FROM e WHERE parent_id IN (SELECT id FROM g)) SELECT i.id, i.id IN (SELECT id FROM o) AS origin_erased FROM i JOIN m USING (id)")
def filter_p5_probe(spark, d):
    """For a list of ids (every derived record) whether an origin of it was erased."""
    gone = memories(spark, d, "status = 'erased'").select(F.col("id").alias("parent_id"))
    e = edges(spark, d).select("memory_id", "parent_id").distinct()
    marked = e.join(gone, "parent_id", "left_semi").select(F.col("memory_id").alias("id")).distinct().withColumn("_o", F.lit(True))
    asked = e.select(F.col("memory_id").alias("id")).distinct().join(memories(spark, d).select("id"), "id", "left_semi")
    return asked.join(marked, "id", "left").select("id", F.coalesce("_o", F.lit(False)).alias("origin_erased"))


@C.query("WITH v AS (SELECT scope_id, model_revision, chunk_id, max(updated) AS updated FROM stored_vector WHERE vector IS NOT NULL GROUP BY 1, 2, 3), f AS (SELECT scope_id, model_revision, min(chunk_id) AS first FROM v GROUP BY 1, 2) SELECT v.scope_id, v.model_revision, v.chunk_id, v.updated, row_number() OVER (PARTITION BY v.scope_id, v.model_revision ORDER BY v.chunk_id) AS number FROM v JOIN f USING (scope_id, model_revision) WHERE v.chunk_id > f.first QUALIFY number <= 20")
def scan_s5_page(spark, d):
    """The page of 20 vectors after the first of each scope and revision."""
    v = table(spark, d, "stored_vector").where("vector IS NOT NULL").groupBy("scope_id", "model_revision", "chunk_id").agg(F.max("updated").alias("updated"))
    f = v.groupBy("scope_id", "model_revision").agg(F.min("chunk_id").alias("first"))
    after = v.join(f, ["scope_id", "model_revision"]).where("chunk_id > first").drop("first")
    return after.withColumn("number", F.row_number().over(W.partitionBy("scope_id", "model_revision").orderBy("chunk_id")).cast("bigint")).where("number <= 20")


@C.query("SELECT DISTINCT scope_id FROM memory_record WHERE scope_id > (SELECT min(scope_id) FROM memory_record) ORDER BY scope_id LIMIT 20")
def scan_s6_after(spark, d):
    """The next 20 scope keys after the first."""
    s = table(spark, d, "memory_record").select("scope_id")
    first = s.agg(F.min("scope_id")).first()[0]
    return s.where(F.col("scope_id") > first).distinct().orderBy("scope_id").limit(20)


@C.query(f"WITH {H}, x AS (SELECT scope_id, subject_key, predicate_name, claim_id, tx_seq, row_number() OVER (PARTITION BY scope_id, subject_key ORDER BY tx_seq) AS number FROM h WHERE tx_seq > 100 AND predicate_name IS NOT NULL QUALIFY number <= 10) SELECT x.*, EXISTS (SELECT 1 FROM claim_retraction r WHERE r.scope_id = x.scope_id AND r.target_claim_id = x.claim_id) AS retracted, (SELECT count(DISTINCT (r.relation_kind, r.to_id)) FROM claim_relation r WHERE r.scope_id = x.scope_id AND r.from_claim_id = x.claim_id) AS relations FROM x")
def scan_s7_page(spark, d):
    """The first 10 claims of each subject after a sequence, with their relations and retractions looked up for the page alone."""
    h = history(spark, d, "tx_seq > 100 AND predicate_name IS NOT NULL").select("scope_id", "subject_key", "predicate_name", "claim_id", "tx_seq")
    page = h.withColumn("number", F.row_number().over(W.partitionBy("scope_id", "subject_key").orderBy("tx_seq")).cast("bigint")).where("number <= 10")
    page = materialise(spark, page, "page")
    gone = table(spark, d, "claim_retraction").select("scope_id", F.col("target_claim_id").alias("claim_id")).join(page, ["scope_id", "claim_id"], "left_semi").distinct().withColumn("_x", F.lit(True))
    rel = table(spark, d, "claim_relation").select("scope_id", F.col("from_claim_id").alias("claim_id"), "relation_kind", "to_id").join(page, ["scope_id", "claim_id"], "left_semi").distinct().groupBy("scope_id", "claim_id").agg(F.count(F.lit(1)).alias("relations"))
    out = page.join(gone, ["scope_id", "claim_id"], "left").join(rel, ["scope_id", "claim_id"], "left")
    return out.select("scope_id", "subject_key", "predicate_name", "claim_id", "tx_seq", "number", F.coalesce("_x", F.lit(False)).alias("retracted"), F.coalesce("relations", F.lit(0)).alias("relations"))


@C.query(f"WITH {M}, c AS (SELECT scope_id, count(*) AS contradictions FROM (SELECT DISTINCT scope_id, from_claim_id, to_id FROM claim_relation WHERE relation_kind = 'contradicts') GROUP BY 1), r AS (SELECT scope_id, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status IN ('superseded', 'expired')) AS retired, count(*) FILTER (status = 'erased') AS erased, count(DISTINCT source) AS sources, min(CASE trust WHEN 'evidence' THEN 0 WHEN 'assertion' THEN 1 ELSE 2 END)::INT AS least_trust FROM m GROUP BY 1) SELECT r.*, coalesce(c.contradictions, 0) AS contradictions FROM r LEFT JOIN c USING (scope_id)")
def agg_a12_scope_digest(spark, d):
    """The digest of each scope: records that are active, retired and erased, its sources, least trust and contradictions."""
    c = table(spark, d, "claim_relation").where("relation_kind = 'contradicts'").select("scope_id", "from_claim_id", "to_id").distinct().groupBy("scope_id").agg(F.count(F.lit(1)).alias("contradictions"))
    count = lambda test: F.count(F.when(test, 1))
    trust = F.when(F.col("trust") == "evidence", 0).when(F.col("trust") == "assertion", 1).otherwise(2)
    r = memories(spark, d).groupBy("scope_id").agg(count(F.col("status") == "active").alias("active"), count(F.col("status").isin("superseded", "expired")).alias("retired"), count(F.col("status") == "erased").alias("erased"), F.count_distinct("source").alias("sources"), F.min(trust).alias("least_trust"))
    return r.join(c, "scope_id", "left").fillna(0, ["contradictions"])


QUERIES, ORACLES = C.queries, C.oracles
