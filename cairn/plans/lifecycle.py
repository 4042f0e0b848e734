"""Queries of the lifecycle: replacements, corrections, expiry, use, erasure, activation of models, and what a write consists of."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import lifecycle, records
from cairn.plans.records import DENIED, E, M, NOW, _normal_sql, edges, memories, origins, verdict_sql
from cairn.plans.registry import Catalog
from cairn.session import fresh_path, materialise, table
from cairn.sources import readers

C = Catalog()
YEAR = 31536000
BATCH, SCOPE_BATCH = 3, 50


@C.query(f"""WITH RECURSIVE {M}, l AS (SELECT id, superseded_by AS up FROM m WHERE superseded_by IS NOT NULL), w AS (SELECT id, up AS head, [up] AS path FROM l UNION ALL SELECT w.id, l.up, list_append(w.path, l.up) FROM w JOIN l ON l.id = w.head WHERE NOT list_contains(w.path, l.up)), e AS (SELECT DISTINCT id FROM w WHERE head NOT IN (SELECT id FROM l)),
 p AS (SELECT a.id, a.superseded_by AS successor, a.status, CASE WHEN a.id = a.superseded_by THEN 'self' WHEN t.id IS NULL THEN 'unknown_target' WHEN t.scope_id <> a.scope_id THEN 'other_scope' WHEN t.status = 'erased' THEN 'erased_target' WHEN a.id NOT IN (SELECT id FROM e) THEN 'cycle' END AS problem FROM m a LEFT JOIN m t ON t.id = a.superseded_by WHERE a.superseded_by IS NOT NULL)
 SELECT id, successor, problem, CASE WHEN problem IS NULL THEN 'superseded' ELSE status END AS new_status FROM p""")
def lifecycle_l3_supersede(spark, d):
    """Every replacement that the records ask for, refused or carried out."""
    return lifecycle.superseded(spark, materialise(spark, memories(spark, d).select("id", "scope_id", "status", "superseded_by"), "records"))


@C.query(f"""WITH {M}, {E}, c AS (SELECT id AS correction_id, scope_id, actor, trust, created FROM m WHERE kind = 'correction'), g AS (SELECT DISTINCT memory_id, parent_id FROM e),
 p AS (SELECT c.*, g.parent_id AS id, CASE WHEN g.parent_id IS NULL THEN 'unfounded' WHEN c.actor = 'agent' AND c.trust = 'instruction' THEN 'agent_instruction' WHEN t.id IS NULL THEN 'unknown_target' WHEN t.scope_id <> c.scope_id THEN 'other_scope' END AS problem FROM c LEFT JOIN g ON g.memory_id = c.correction_id LEFT JOIN m t ON t.id = g.parent_id)
 SELECT correction_id, id, problem, problem IS NULL AND correction_id = (max((created, correction_id)) FILTER (problem IS NULL) OVER (PARTITION BY id))[2] AS wins FROM p""")
def lifecycle_l4_correct(spark, d):
    """Corrections with the records that they correct, and which is the last of each record's."""
    return lifecycle.corrected(memories(spark, d).select("id", "scope_id", "kind", "actor", "trust", "created"), edges(spark, d))


@C.query(f"WITH {M}, r AS (SELECT scope_id, id, created + {YEAR} AS valid_until, row_number() OVER (PARTITION BY scope_id ORDER BY created, id) AS number, count(*) OVER (PARTITION BY scope_id) > {BATCH} AS more FROM m WHERE status = 'active' AND created + {YEAR} <= {NOW}) SELECT * FROM r WHERE number <= {BATCH}")
def lifecycle_l5_batch(spark, d):
    """The next batch of each scope's records that expire, in order, and whether more are due."""
    m = memories(spark, d, f"status = 'active' AND created <= {NOW - YEAR}").select("scope_id", "id", "status", "created")
    return lifecycle.due(m, F.col("created") + YEAR, F.lit(NOW), BATCH)


@C.query(f"WITH {M}, b AS (SELECT scope_id, count(*) FILTER (status = 'active') AS was, count(*) FILTER (status = 'active' AND created + {YEAR} <= {NOW}) AS moved FROM m GROUP BY 1) SELECT scope_id, was, moved, was - moved AS remain, was > 0 AND was = moved AS held, was AS after_undo FROM b")
def check_v16_curation(spark, d):
    """What expiry would leave in each scope; a run that leaves nothing where there was something is held, and undoing it restores the count."""
    over = (F.col("status") == "active") & (F.col("created") + YEAR <= NOW)
    b = memories(spark, d).groupBy("scope_id").agg(F.count(F.when(F.col("status") == "active", 1)).alias("was"), F.count(F.when(over, 1)).alias("moved"))
    remain = F.col("was") - F.col("moved")
    return b.select("scope_id", "was", "moved", remain.alias("remain"), ((F.col("was") > 0) & (remain == 0)).alias("held"), (remain + F.col("moved")).alias("after_undo"))


@C.query(f"WITH {M} SELECT id, CASE WHEN status = 'active' THEN greatest(created + {YEAR}, {NOW}) END AS valid_until, sha256(scope_id || chr(31) || kind || chr(31) || text) AS before, sha256(scope_id || chr(31) || kind || chr(31) || {_normal_sql('text')}) AS after FROM m WHERE text IS NOT NULL")
def lifecycle_l6_redigest(spark, d):
    """Fingerprints of the raw text replaced by those of its normal form, and the end of validity set on what is active."""
    m = memories(spark, d, "text IS NOT NULL")
    raw = F.sha2(F.concat_ws("\u001f", "scope_id", "kind", "text"), 256)
    return m.select("id", F.when(F.col("status") == "active", F.greatest(F.col("created") + YEAR, F.lit(NOW))).alias("valid_until"), raw.alias("before"), X.fingerprint(F.col("scope_id"), F.col("kind"), F.col("text")).alias("after"))


_GONE = "g AS (SELECT id, source, external_id FROM m WHERE status = 'erased')"


@C.query(f"WITH {M}, {E}, {_GONE} SELECT g.id, (SELECT count(*) FROM (SELECT DISTINCT chunk_id, memory_id FROM stored_vector) v WHERE v.memory_id = g.id) AS vectors, (SELECT count(*) FROM (SELECT DISTINCT memory_id, parent_id FROM e) x WHERE x.memory_id = g.id) AS origins, (SELECT count(*) FROM (SELECT DISTINCT memory_id, parent_id FROM e) x WHERE x.parent_id = g.id) AS marked, (SELECT count(*) FROM (SELECT DISTINCT claim_id, provenance.source.system AS s, provenance.source.external_id AS x FROM claim_history) h WHERE h.s = g.source AND h.x = g.external_id) AS claims FROM g")
def lifecycle_l9_swept(spark, d):
    """What goes with each erased record: vectors and origins are swept, records derived from it directly and claims from its source are marked."""
    gone = memories(spark, d, "status = 'erased'").select("id", "source", "external_id")
    v = table(spark, d, "stored_vector").select("chunk_id", F.col("memory_id").alias("id")).distinct()
    e = edges(spark, d).select("memory_id", "parent_id").distinct()
    h = table(spark, d, "claim_history").select("claim_id", F.col("provenance.source.system").alias("source"), F.col("provenance.source.external_id").alias("external_id")).distinct()
    cited = h.join(gone, ["source", "external_id"]).select("id", "claim_id")
    return lifecycle.swept(gone, {"vectors": v, "origins": e.withColumnRenamed("memory_id", "id"), "marked": e.withColumnRenamed("parent_id", "id"), "claims": cited})


@C.query(f"WITH {M}, r AS (SELECT scope_id, id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, row_number() OVER (PARTITION BY scope_id ORDER BY id) AS number FROM m) SELECT scope_id, (number - 1) // {SCOPE_BATCH} AS batch, count(*) AS records, sum(bytes)::BIGINT AS bytes, min(id) AS first_id, max(id) AS last_id FROM r GROUP BY 1, 2")
def lifecycle_l8_receipts(spark, d):
    """The receipts of erasing every scope in bounded batches."""
    return lifecycle.receipts(memories(spark, d).select("scope_id", "id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes")), SCOPE_BATCH)


@C.query(f"WITH {M}, r AS (SELECT scope_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, row_number() OVER (PARTITION BY scope_id ORDER BY id) AS number FROM m) SELECT scope_id, (max(number) - 1) // {SCOPE_BATCH} + 1 AS batches, count(*) AS records, sum(bytes)::BIGINT AS bytes FROM r GROUP BY 1")
def agg_a6_journal(spark, d):
    """The totals of the journal that erasing every scope would write."""
    return lifecycle_l8_receipts(spark, d).groupBy("scope_id").agg(F.count(F.lit(1)).alias("batches"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))


@C.query(f"WITH {M}, {E}, u AS (SELECT e.parent_id AS id, c.created AS moment FROM (SELECT DISTINCT memory_id, parent_id FROM e) e JOIN m c ON c.id = e.memory_id), n AS (SELECT id, count(*) AS n, max(moment) AS moment FROM u GROUP BY 1) SELECT m.id, m.uses + coalesce(n.n, 0) AS uses, coalesce(n.moment, m.last_used) AS last_used FROM m LEFT JOIN n USING (id)")
def lifecycle_l11_use(spark, d):
    """Use counters after each derivation counts as a use of its parents, at the time of the derived record."""
    child = memories(spark, d).select(F.col("id").alias("memory_id"), F.col("created").alias("at"))
    uses = edges(spark, d).select("memory_id", "parent_id").distinct().join(child, "memory_id").select(F.col("parent_id").alias("id"), "at")
    return lifecycle.used(memories(spark, d).select("id", F.col("uses").cast("bigint").alias("uses"), "last_used"), uses)


@C.query(f"WITH {M}, v AS (SELECT r.revision, r.active = 1 AS active, (SELECT count(DISTINCT s.memory_id) FROM stored_vector s JOIN m ON m.id = s.memory_id WHERE s.model_revision = r.revision AND s.vector IS NOT NULL AND m.status = 'active') AS covered, (SELECT count(*) FROM m WHERE status = 'active') AS live FROM model_revision r), a AS (SELECT bool_or(active AND covered = live) AS whole FROM v) SELECT revision, active, covered, live, NOT active AS may_activate, NOT active AND whole AS may_drop FROM v, a")
def lifecycle_l14_guard(spark, d):
    """Which model revisions may become the active one or be dropped: only inactive ones, and only if the active one covers all that lives."""
    live = memories(spark, d, "status = 'active'").select(F.col("id").alias("memory_id"))
    done = table(spark, d, "stored_vector").where("vector IS NOT NULL").select(F.col("model_revision").alias("revision"), "memory_id").distinct().join(live, "memory_id", "left_semi").groupBy("revision").agg(F.count(F.lit(1)).alias("covered"))
    alive = F.lit(live.count()).cast("bigint")
    v = table(spark, d, "model_revision").select("revision", (F.col("active") == 1).alias("active")).join(done, "revision", "left").fillna(0, ["covered"]).withColumn("live", alive)
    whole = v.where(F.col("active") & (F.col("covered") == F.col("live"))).count() > 0
    return v.select("revision", "active", "covered", "live", (~F.col("active")).alias("may_activate"), (~F.col("active") & F.lit(whole)).alias("may_drop"))


@C.query(f"WITH {M}, {verdict_sql()}, p AS (SELECT m.id, m.scope_id, m.created, v.verdict, v.code, CASE WHEN v.verdict <> 'refuse' THEN sha256(m.scope_id || chr(31) || m.kind || chr(31) || coalesce({_normal_sql('m.text')}, '')) END AS fp FROM m JOIN verdicts v USING (id)) SELECT id, verdict, code, CASE WHEN fp IS NOT NULL THEN (min((created, id)) OVER (PARTITION BY scope_id, fp))[2] END AS kept_as, fp IS NOT NULL AND (min((created, id)) OVER (PARTITION BY scope_id, fp))[2] <> id AS merged FROM p")
def gate_v6_response(spark, d):
    """The answer to each capture: verdict, code, the record it is kept as, and whether it was merged into an earlier one."""
    m = records.verdicts(memories(spark, d).withColumn("origin", origins()), DENIED)
    p = m.select("id", "scope_id", "created", "verdict", "code", F.when(F.col("verdict") != "refuse", X.fingerprint(F.col("scope_id"), F.col("kind"), F.coalesce("text", F.lit("")))).alias("fp"))
    first = p.where("fp IS NOT NULL").groupBy("scope_id", "fp").agg(F.min(F.struct("created", "id"))["id"].alias("kept_as"))
    return p.join(first, ["scope_id", "fp"], "left").select("id", "verdict", "code", "kept_as", F.coalesce(F.col("kept_as") != F.col("id"), F.lit(False)).alias("merged"))


@C.query(f"WITH {M}, {E}, k AS (SELECT source, external_id, count(*) AS captures, count(DISTINCT sha256(coalesce(text, ''))) AS bodies, max(created) - min(created) AS seconds FROM m WHERE external_id IS NOT NULL GROUP BY 1, 2) SELECT source, external_id, captures, CASE WHEN bodies > 1 AND seconds <= 86400 THEN 'conflict' WHEN captures > 1 AND seconds <= 86400 THEN 'repeat' ELSE 'new' END AS answer FROM k")
def capture_r2_conflicts(spark, d):
    """Captures under one key within a day: repeats of one body answer alike, different bodies conflict."""
    m = memories(spark, d, "external_id IS NOT NULL").select("source", "external_id", "created", F.sha2(F.coalesce("text", F.lit("")), 256).alias("body"))
    k = m.groupBy("source", "external_id").agg(F.count(F.lit(1)).alias("captures"), F.count_distinct("body").alias("bodies"), (F.max("created") - F.min("created")).alias("seconds"))
    soon = F.col("seconds") <= 86400
    return k.select("source", "external_id", "captures", F.when((F.col("bodies") > 1) & soon, "conflict").when((F.col("captures") > 1) & soon, "repeat").otherwise("new").alias("answer"))


@C.query(f"WITH {M} SELECT id, sha256(scope_id || chr(31) || kind || chr(31) || text) AS material FROM m WHERE text IS NOT NULL")
def gate_g10_material(spark, d):
    """The digest of what a decision is about; only equality can be seen, keys are not kept here."""
    return memories(spark, d, "text IS NOT NULL").select("id", F.sha2(F.concat_ws("\u001f", "scope_id", "kind", "text"), 256).alias("material"))


@C.query(f"WITH {M}, {E} SELECT m.id, m.status, m.source, (SELECT count(*) FROM (SELECT DISTINCT memory_id, parent_id, position FROM e) x WHERE x.memory_id = m.id) AS derivations, count(*) OVER (PARTITION BY m.scope_id, m.kind, m.status) AS counter, 1 AS outbox FROM m")
def sink_k1_insert(spark, d):
    """A batch of records written as records, provenance, derivations, counters and outbox entries, and read back from what was written."""
    root = fresh_path(spark, "insert")
    m = materialise(spark, memories(spark, d).select("id", "scope_id", "kind", "status", "source"), "batch")
    parts = {
        "memory": m.select("id", "scope_id", "kind", "status"), "provenance": m.select("id", "source"), "derivation": edges(spark, d).select("memory_id", "parent_id", "position").distinct(),
        "counter": m.groupBy("scope_id", "kind", "status").agg(F.count(F.lit(1)).alias("counter")), "outbox": m.select("id", F.lit(1).alias("outbox")),
    }
    for name, part in parts.items():
        part.write.parquet(f"{root}/{name}")
    held = {name: spark.read.parquet(f"{root}/{name}") for name in parts}
    n = held["derivation"].groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("derivations"))
    out = held["memory"].join(held["provenance"], "id").join(n, "id", "left").join(held["counter"], ["scope_id", "kind", "status"]).join(held["outbox"], "id")
    return out.select("id", "status", "source", F.coalesce("derivations", F.lit(0)).alias("derivations"), "counter", "outbox")


@C.query(f"WITH {M} SELECT id, TRUE AS same FROM m")
def sink_k2_round_trip(spark, d):
    """Records written as lines of JSON, read back as types and written again: whether the bytes are the same."""
    whole = table(spark, d, "memory_record")
    schema, root = whole.schema, fresh_path(spark, "json")
    whole.dropDuplicates(["id"]).select(F.to_json(F.struct(*whole.columns))).write.text(root)
    held = spark.read.text(root).withColumn("again", F.to_json(F.from_json("value", schema)))
    return held.select(F.get_json_object("value", "$.id").alias("id"), (F.col("value") == F.col("again")).alias("same"))


@C.query("SELECT 'memory' AS entity, count(DISTINCT id) AS rows, count(DISTINCT id) AS read FROM memory_record UNION ALL SELECT 'vector', count(*), count(*) FROM (SELECT DISTINCT chunk_id, updated FROM stored_vector WHERE vector IS NOT NULL) UNION ALL SELECT 'claim', count(*), count(*) FROM (SELECT DISTINCT scope_id, tx_seq FROM claim_history)")
def sink_k3_archive(spark, d):
    """An archive of records, vectors and claims as lines of JSON with a manifest, and the rows read back from it."""
    path = fresh_path(spark, "archive")
    tables = {"memory": table(spark, d, "memory_record").dropDuplicates(["id"]), "vector": table(spark, d, "stored_vector").where("vector IS NOT NULL").dropDuplicates(["chunk_id", "updated"]), "claim": table(spark, d, "claim_history").dropDuplicates(["scope_id", "tx_seq"])}
    manifest = readers.write_archive(tables, path)
    held = None
    for name, part in readers.read_archive(spark, path).items():
        one = part.agg(F.count(F.lit(1)).alias("read")).select(F.lit(name).alias("entity"), "read")
        held = one if held is None else held.unionByName(one)
    return manifest.join(held, "entity").select("entity", "rows", "read")


_CHAT = r"^\[(\d\d:\d\d)\] ([A-Za-z0-9-]+): (.*)$"


@C.query(f"WITH t AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) AS turn FROM documents WHERE layout = 'lines' AND text IS NOT NULL) SELECT doc_id || '/' || turn AS external_id, doc_id, turn, regexp_extract(line, '{_CHAT}', 1) AS clock, regexp_extract(line, '{_CHAT}', 2) AS speaker, regexp_extract(line, '{_CHAT}', 3) AS body FROM t WHERE regexp_matches(line, '{_CHAT}')")
def source_k5_chat(spark, d):
    """A chat export as one record a message, named by conversation and turn (from 1); lines that are no messages are left out."""
    t = table(spark, d, "documents").where("layout = 'lines' AND text IS NOT NULL").select("doc_id", F.posexplode(F.split(F.replace(F.col("text"), F.lit("\r"), F.lit("")), "\n")).alias("p", "line"))
    t = t.where(F.col("line").rlike(_CHAT)).withColumn("turn", (F.col("p") + 1).cast("bigint"))
    return t.select(F.concat_ws("/", "doc_id", "turn").alias("external_id"), "doc_id", "turn", *[F.regexp_extract("line", _CHAT, i).alias(n) for i, n in ((1, "clock"), (2, "speaker"), (3, "body"))])


@C.query(f"WITH {M}, r AS (SELECT source, id, created, row_number() OVER (PARTITION BY source ORDER BY id) AS number FROM m WHERE source IS NOT NULL) SELECT source, (number - 1) // 50 AS page, count(*) AS candidates, max(id) AS cursor FROM r GROUP BY 1, 2")
def source_k4_pages(spark, d):
    """The pages in which an adapter of each source would be read, and the cursor after each."""
    m = memories(spark, d, "source IS NOT NULL").select("source", "id")
    placed = lifecycle.numbered(m, ["source"], F.substring("id", 1, 6), ["id"]).withColumn("page", F.floor((F.col("number") - 1) / 50))
    return placed.groupBy("source", "page").agg(F.count(F.lit(1)).alias("candidates"), F.max("id").alias("cursor"))


QUERIES, ORACLES = C.queries, C.oracles
