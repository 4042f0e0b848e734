"""Queries over memory records: scans, filters, joins, aggregates, windows, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import hierarchy, records
from cairn.plans.registry import Catalog
from cairn.session import table
from cairn.sources import readers

C = Catalog()
NOW = 1767225600  # the instant at which time-dependent queries look at the records


def memories(spark: SparkSession, d: str, where: str | None = None) -> DataFrame:
    """memory_record flattened, each repeated row once; of those that ``where`` admits.

    Repeats are exact, so the condition comes first: it reaches the scan, and only what it admits is shuffled.
    """
    m = table(spark, d, "memory_record")
    flat = m.select("id", "scope_id", "kind", F.col("status.state").alias("status"), F.col("status.superseded_by").alias("superseded_by"), F.col("trust.class").alias("trust"), F.col("actor.kind").alias("actor"),
                    F.col("body.text").alias("text"), F.col("body.title").alias("title"), F.col("body.media").alias("media"), F.col("provenance.source.system").alias("source"), F.col("provenance.source.external_id").alias("external_id"),
                    F.col("provenance.derived_from").alias("derived_from"), F.col("provenance.captured_at").alias("captured_at"), F.col("importance.base").alias("base"), F.col("importance.last_used").alias("last_used"), F.col("importance.uses").alias("uses"), "created", "updated")
    return (flat if where is None else flat.where(where)).dropDuplicates(["id"])


M = """m AS (SELECT id, any_value(scope_id) AS scope_id, any_value(kind) AS kind, any_value(status.state) AS status, any_value(status.superseded_by) AS superseded_by, any_value(trust.class) AS trust, any_value(actor.kind) AS actor,
 any_value(body.text) AS text, any_value(body.title) AS title, any_value(body.media) AS media, any_value(provenance.source.system) AS source, any_value(provenance.source.external_id) AS external_id, any_value(provenance.derived_from) AS derived_from,
 any_value(provenance.captured_at) AS captured_at, any_value(importance.base) AS base, any_value(importance.last_used) AS last_used, any_value(importance.uses) AS uses, any_value(created) AS created, any_value(updated) AS updated FROM memory_record GROUP BY id)"""
E = "e AS (SELECT DISTINCT memory_id, parent_id, position, scope_id FROM memory_derivation)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_derivation").select("memory_id", "parent_id", "position", "scope_id").distinct()


@C.query(f"WITH {M}, {E} SELECT r.scope_id, r.parent_id AS id, m.id IS NOT NULL AS found, m.kind, m.status FROM (SELECT DISTINCT scope_id, parent_id FROM e) r LEFT JOIN m ON m.id = r.parent_id AND m.scope_id = r.scope_id")
def scan_s1_get(spark, d):
    """Point gets of every (scope, parent) that a derivation names."""
    wanted = edges(spark, d).select("scope_id", F.col("parent_id").alias("id")).distinct()
    held = memories(spark, d).select("scope_id", "id", "kind", "status", F.lit(True).alias("_f"))
    return wanted.join(held, ["scope_id", "id"], "left").select("scope_id", "id", F.coalesce("_f", F.lit(False)).alias("found"), "kind", "status")


@C.query(f"WITH {M}, r AS (SELECT scope_id, id, created, row_number() OVER (PARTITION BY scope_id ORDER BY created DESC, id DESC) AS rank FROM m WHERE status = 'active') SELECT scope_id, id, created, rank, count(*) OVER (PARTITION BY scope_id) = 100 AS next FROM r WHERE rank <= 100")
def scan_s2_first_page(spark, d):
    """The first page of active memories of each scope."""
    active = memories(spark, d, "status = 'active'").select("scope_id", "id", "created")
    return records.newest_first(active, "scope_id", 100).select("scope_id", "id", "created", "rank", "next")


@C.query(f"WITH {M}, b AS (SELECT scope_id, count(*) AS n, max((created, id)) AS first FROM m GROUP BY 1) SELECT m.scope_id, count(*) AS after_first FROM m JOIN b USING (scope_id) WHERE m.created < b.first[1] OR (m.created = b.first[1] AND m.id < b.first[2]) GROUP BY 1")
def scan_s2_keyset(spark, d):
    """How many memories follow each scope's first by the keyset predicate (created, id) descending."""
    m = memories(spark, d).select("scope_id", "created", "id")
    first = m.groupBy("scope_id").agg(F.max(F.struct("created", "id")).alias("f"))
    after = (F.col("created") < F.col("f.created")) | ((F.col("created") == F.col("f.created")) & (F.col("id") < F.col("f.id")))
    return m.join(first, "scope_id").where(after).groupBy("scope_id").agg(F.count(F.lit(1)).alias("after_first"))


@C.query(f"WITH {M}, r AS (SELECT revision, max(dims) AS dims FROM model_revision WHERE active = 1 GROUP BY 1), v AS (SELECT chunk_id, memory_id, scope_id, model_revision, chunk_ordinal, dims FROM stored_vector WHERE vector IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY updated DESC) = 1) SELECT v.chunk_id, v.memory_id, v.chunk_ordinal, m.status FROM v JOIN r ON r.revision = v.model_revision AND r.dims = v.dims JOIN m ON m.id = v.memory_id AND m.scope_id = v.scope_id WHERE m.status = 'active'")
def scan_s4_vectors(spark, d):
    """Comparable chunks of the active model revision whose memory is active."""
    v = table(spark, d, "stored_vector").where("vector IS NOT NULL").groupBy("chunk_id").agg(F.max_by(F.struct("memory_id", "scope_id", "model_revision", "chunk_ordinal", "dims"), "updated").alias("v")).select("chunk_id", "v.*")
    r = table(spark, d, "model_revision").where("active = 1").groupBy(F.col("revision").alias("model_revision")).agg(F.max("dims").alias("dims"))
    m = memories(spark, d, "status = 'active'").select(F.col("id").alias("memory_id"), "scope_id", "status")
    return v.join(F.broadcast(r), ["model_revision", "dims"]).join(m, ["memory_id", "scope_id"]).select("chunk_id", "memory_id", "chunk_ordinal", "status")


@C.query("SELECT scope_id, count(DISTINCT id) AS memories FROM memory_record GROUP BY 1")
def scan_s6_scopes(spark, d):
    """Scope keys in use with their number of memories."""
    return table(spark, d, "memory_record").groupBy("scope_id").agg(F.countDistinct("id").alias("memories"))


@C.query(f"WITH {M}, {E} SELECT e.memory_id, string_agg(e.parent_id, ',' ORDER BY e.position) AS parents, count(m.id) AS existing FROM e LEFT JOIN m ON m.id = e.parent_id AND m.scope_id = e.scope_id GROUP BY 1")
def scan_s10_parents(spark, d):
    """Each derived memory's parents in order, and how many exist in its scope."""
    m = memories(spark, d).select(F.col("id").alias("parent_id"), "scope_id", F.lit(1).alias("_f"))
    e = edges(spark, d).join(m, ["parent_id", "scope_id"], "left")
    return e.groupBy("memory_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "parent_id"))), lambda p: p["parent_id"]), ",").alias("parents"), F.count("_f").alias("existing"))


@C.query(f"WITH {M} SELECT id, kind, status, text, len(media)::BIGINT AS media FROM m")
def sink_k2_json(spark, d):
    """Records written as JSON text and read back with a fixed schema."""
    m = memories(spark, d).select("id", "kind", "status", "text", "media")
    held = m.select(F.to_json(F.struct("id", "kind", "status", "text", "media")).alias("j"))
    schema = "id STRING, kind STRING, status STRING, text STRING, media ARRAY<STRUCT<digest: STRING, media_type: STRING, bytes: BIGINT>>"
    return held.select(F.from_json("j", schema).alias("r")).select("r.id", "r.kind", "r.status", "r.text", F.size("r.media").cast("bigint").alias("media"))


@C.query("SELECT 'memory' AS entity, count(DISTINCT id) AS rows FROM memory_record UNION ALL SELECT 'derivation', count(*) FROM (SELECT DISTINCT memory_id, parent_id, position FROM memory_derivation) UNION ALL SELECT 'claim', count(*) FROM (SELECT DISTINCT scope_id, tx_seq FROM claim_history) UNION ALL SELECT 'relation', count(*) FROM (SELECT DISTINCT scope_id, tx_seq FROM claim_relation) UNION ALL SELECT 'retraction', count(*) FROM (SELECT DISTINCT scope_id, tx_seq FROM claim_retraction)")
def sink_k3_manifest(spark, d):
    """The manifest of an archive: rows of each entity, repeats counted once."""
    key = {"memory": ("memory_record", ["id"]), "derivation": ("memory_derivation", ["memory_id", "parent_id", "position"]), "claim": ("claim_history", ["scope_id", "tx_seq"]), "relation": ("claim_relation", ["scope_id", "tx_seq"]), "retraction": ("claim_retraction", ["scope_id", "tx_seq"])}
    parts = [table(spark, d, t).select(*k).distinct().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(e).alias("entity"), "rows") for e, (t, k) in key.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@C.query(f"WITH {M} SELECT source, external_id, min((created, id))[2] AS id, count(*) AS captures FROM m WHERE external_id IS NOT NULL GROUP BY 1, 2")
def source_k4_idempotent(spark, d):
    """Captures of an adapter, one for each (source, external id): the first."""
    m = memories(spark, d, "external_id IS NOT NULL")
    return m.groupBy("source", "external_id").agg(F.min(F.struct("created", "id"))["id"].alias("id"), F.count(F.lit(1)).alias("captures"))


def _turns(spark, d):
    t = table(spark, d, "documents").where("layout = 'lines' AND text IS NOT NULL").select("doc_id", F.posexplode(F.split(F.replace(F.col("text"), F.lit("\r"), F.lit("")), "\n")).alias("p", "line"))
    return t.select("doc_id", (F.col("p") + 1).cast("bigint").alias("turn"), "line").where("length(trim(line)) > 0")


@C.query("WITH t AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) AS turn FROM documents WHERE layout = 'lines' AND text IS NOT NULL) SELECT doc_id, turn, line FROM t WHERE turn BETWEEN 2 AND 4 AND length(trim(line, ' ')) > 0")
def source_k6_turns(spark, d):
    """Turns 2 to 4 of every conversation-like document (one line a turn, from 1); gaps stay gaps."""
    return readers.turns_between(_turns(spark, d), 2, 4)


@C.query("WITH t AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) AS turn FROM documents WHERE layout = 'lines' AND text IS NOT NULL) SELECT doc_id, turn, line FROM t WHERE length(trim(line, ' ')) > 0")
def source_k6_all_turns(spark, d):
    """All turns of every conversation-like document (one line a turn, from 1); gaps stay gaps."""
    return readers.turns_between(_turns(spark, d))


@C.query(f"WITH {M} SELECT scope_id, status, kind, count(*) AS n FROM m GROUP BY 1, 2, 3")
def filter_p2_p3_status_kind(spark, d):
    """Memories by scope, status and kind: what each status or kind filter admits."""
    return memories(spark, d).groupBy("scope_id", "status", "kind").agg(F.count(F.lit(1)).alias("n"))


@C.query(f"WITH {M} SELECT id, kind, trust, actor, source, created FROM m WHERE status = 'active' AND trust IN ('evidence', 'assertion') AND actor <> 'system' AND source IN ('stay-sync', 'berth-board', 'southern-log') AND created BETWEEN 1704067200 AND 1767225600")
def filter_p7_recall(spark, d):
    """The recall filter: status, trust, actor, source and time range together."""
    m = memories(spark, d, "status = 'active' AND trust IN ('evidence', 'assertion') AND actor <> 'system' AND source IN ('stay-sync', 'berth-board', 'southern-log') AND created BETWEEN 1704067200 AND 1767225600")
    return m.select("id", "kind", "trust", "actor", "source", "created")


@C.query(f"""WITH {M} SELECT id, '<<<MEMORY ' || id || '>>>' || chr(10) || replace(replace(replace(coalesce(text, ''), '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') || chr(10) || '<<<END_MEMORY ' || id || '>>>' AS framed FROM m WHERE status = 'active'""")
def project_p8_envelope(spark, d):
    """Texts framed by lines that bear their id, with no delimiter left inside."""
    m = memories(spark, d, "status = 'active'")
    return m.select("id", F.concat(F.lit("<<<MEMORY "), "id", F.lit(">>>\n"), X.escaped(F.coalesce("text", F.lit(""))), F.lit("\n<<<END_MEMORY "), "id", F.lit(">>>")).alias("framed"))


@C.query(f"WITH {M} SELECT id, scope_id, kind, status, trust, octet_length(encode(text))::BIGINT AS body_bytes, title IS NOT NULL AS titled, len(media)::BIGINT AS media, created, updated FROM m")
def project_p9_meta(spark, d):
    """The metadata of a listing."""
    return memories(spark, d).select("id", "scope_id", "kind", "status", "trust", F.octet_length("text").cast("bigint").alias("body_bytes"), F.col("title").isNotNull().alias("titled"), F.size("media").cast("bigint").alias("media"), "created", "updated")


_SPACE = "\\t\\x0b\\x0c\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_GONE = "\\x{ad}\\x{180e}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}\\x{2066}-\\x{2069}\\x{feff}"


def _normal_sql(column: str) -> str:
    return f"regexp_replace(regexp_replace(nfc_normalize(regexp_replace({column}, '[{_GONE}]', '', 'g')), '[{_SPACE}]+\\n', chr(10), 'g'), '[{_SPACE}\\n]+\\z', '')"


@C.query(f"SELECT doc_id, sha256({_normal_sql('text')}) AS normal_hash FROM documents WHERE text IS NOT NULL")
def gate_g0_normalise(spark, d):
    """The normal form of every document, by its hash."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.sha2(X.normal_form(F.col("text")), 256).alias("normal_hash"))


DENIED = ["orphan-drop"]
_ORIGIN = {"human": "authenticated", "agent": "registered", "import": "asserted"}


def origins() -> F.Column:
    """How a record's origin is established, by its actor."""
    return F.when(F.col("actor") == "human", "authenticated").when(F.col("actor").isin("agent", "system"), "registered").when(F.col("actor") == "import", "asserted").otherwise("unestablished")


def verdict_sql() -> str:
    """The verdicts over m as common table expressions."""
    found = lambda c: " OR ".join(f"regexp_matches({c}, '{p}')" for p in X.DETECTORS.values())
    return (
        f"n AS (SELECT id, coalesce({_normal_sql('text')}, '') AS t, coalesce({_normal_sql('title')}, '') AS h, media, source, CASE actor WHEN 'human' THEN 'authenticated' WHEN 'agent' THEN 'registered' WHEN 'import' THEN 'asserted' WHEN 'system' THEN 'registered' ELSE 'unestablished' END AS origin FROM m), "
        "f AS (SELECT id, origin, CASE WHEN t = '' THEN 'empty_after_normalization' WHEN octet_length(encode(t)) > 65536 THEN 'too_large' WHEN len(media) > 16 OR len(list_filter(media, lambda x: split_part(x.media_type, '/', 1) NOT IN ('image', 'audio', 'video', 'application', 'text', 'font'))) > 0 THEN 'unsupported_media' WHEN source IN ('orphan-drop') THEN 'policy_denied' "
        f"WHEN {found('t')} OR {found('h')} THEN 'secret' WHEN origin = 'unestablished' THEN 'origin_unestablished' END AS fault FROM n), "
        "verdicts AS (SELECT id, CASE WHEN fault IS NOT NULL THEN 'refuse' WHEN origin = 'asserted' THEN 'quarantine' ELSE 'admit' END AS verdict, coalesce(fault, CASE WHEN origin = 'asserted' THEN 'origin_asserted' END) AS code FROM f)"
    )


@C.query(f"WITH {M}, {verdict_sql()} SELECT * FROM verdicts")
def gate_g1_g7_verdict(spark, d):
    """The admission verdict of every memory: faults before holds, the earlier check first."""
    return records.verdicts(memories(spark, d).withColumn("origin", origins()), DENIED).select("id", "verdict", "code")


_BYTES_BEFORE = "octet_length(encode(substr({0}, 1, instr({0}, regexp_extract({0}, '{1}')) - 1)))::BIGINT"


@C.query(f"WITH {M}, n AS (SELECT id, part, t FROM (SELECT id, 'text' AS part, {_normal_sql('text')} AS t FROM m UNION ALL SELECT id, 'title', {_normal_sql('title')} FROM m) WHERE t IS NOT NULL) SELECT id, part, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in X.DETECTORS.items()) + " END AS detector, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {_BYTES_BEFORE.format('t', p)}" for p in X.DETECTORS.values()) + " END AS byte_offset FROM n")
def gate_g5_findings(spark, d):
    """Text and title of every memory with the first detector that finds a credential, and the bytes before it."""
    m = memories(spark, d)
    both = m.select("id", F.lit("text").alias("part"), X.normal_form(F.col("text")).alias("t")).unionByName(m.select("id", F.lit("title").alias("part"), X.normal_form(F.col("title")).alias("t")))
    offset = F.coalesce(*[F.when(F.col("t").rlike(p), F.octet_length(F.expr("substr(t, 1, {} - 1)".format(f"instr(t, regexp_extract(t, r'{p}', 0))")))) for p in X.DETECTORS.values()])
    return both.where("t IS NOT NULL").select("id", "part", X.detected(F.col("t")).alias("detector"), offset.cast("bigint").alias("byte_offset"))


@C.query("WITH v AS (SELECT model_revision, memory_id, scope_id FROM stored_vector GROUP BY ALL), " + M + " SELECT r.revision, count(DISTINCT v.memory_id) AS embedded, (SELECT count(*) FROM m WHERE status NOT IN ('erased', 'quarantined')) AS live FROM model_revision r LEFT JOIN (SELECT v.* FROM v JOIN m ON m.id = v.memory_id AND m.scope_id = v.scope_id WHERE m.status NOT IN ('erased', 'quarantined')) v ON v.model_revision = r.revision GROUP BY 1")
def agg_a3_a4_coverage(spark, d):
    """Live memories, and those embedded by each model revision, 0 where none is."""
    live = memories(spark, d, "status NOT IN ('erased', 'quarantined')").select(F.col("id").alias("memory_id"), "scope_id")
    done = table(spark, d, "stored_vector").select("model_revision", "memory_id", "scope_id").distinct().join(live, ["memory_id", "scope_id"], "left_semi")
    done = done.groupBy(F.col("model_revision").alias("revision")).agg(F.countDistinct("memory_id").alias("embedded"))
    revisions = table(spark, d, "model_revision").select("revision").distinct()
    return revisions.join(done, "revision", "left").select("revision", F.coalesce("embedded", F.lit(0)).alias("embedded"), F.lit(live.count()).cast("bigint").alias("live"))


@C.query(f"WITH {M} SELECT m.scope_id, m.id FROM m WHERE m.status = 'active' AND NOT EXISTS (SELECT 1 FROM stored_vector v JOIN model_revision r ON r.revision = v.model_revision AND r.active = 1 WHERE v.memory_id = m.id)")
def join_j3_missing(spark, d):
    """Active memories without a vector of the active revision."""
    r = table(spark, d, "model_revision").where("active = 1").select(F.col("revision").alias("model_revision"))
    v = table(spark, d, "stored_vector").join(F.broadcast(r), "model_revision").select(F.col("memory_id").alias("id"))
    return memories(spark, d, "status = 'active'").select("scope_id", "id").join(v, "id", "left_anti").select("scope_id", "id")


@C.query(f"WITH {M}, v AS (SELECT memory_id, count(*) AS chunks, sum((vector IS NULL)::INT)::BIGINT AS failed, max(updated) AS newest FROM (SELECT DISTINCT chunk_id, memory_id, vector IS NULL AS vector_missing, any_value(vector) AS vector, max(updated) AS updated FROM stored_vector GROUP BY chunk_id, memory_id, vector IS NULL) GROUP BY 1) SELECT m.scope_id, sum((m.status = 'active' AND v.memory_id IS NULL)::INT)::BIGINT AS pending, sum((v.failed > 0)::INT)::BIGINT AS failed, sum((m.status = 'quarantined')::INT)::BIGINT AS quarantined, min(CASE WHEN m.status = 'active' AND v.memory_id IS NULL THEN m.created END) AS oldest_pending FROM m LEFT JOIN v ON v.memory_id = m.id GROUP BY 1")
def agg_a5_j5_queue(spark, d):
    """Work of the embedding queue by scope: pending, failed and quarantined memories, and the oldest pending."""
    v = table(spark, d, "stored_vector").groupBy("memory_id").agg(F.max(F.col("vector").isNull().cast("int")).alias("failed"))
    m = memories(spark, d).select("scope_id", F.col("id").alias("memory_id"), "status", "created").join(v, "memory_id", "left")
    pending = (F.col("status") == "active") & F.col("failed").isNull()
    count = lambda c: F.sum(c.cast("bigint"))
    return m.groupBy("scope_id").agg(count(pending).alias("pending"), count(F.col("failed") > 0).alias("failed"), count(F.col("status") == "quarantined").alias("quarantined"), F.min(F.when(pending, F.col("created"))).alias("oldest_pending"))


@C.query(f"WITH {M} SELECT scope_id, kind, status, count(*) AS n FROM m GROUP BY GROUPING SETS ((scope_id), (scope_id, kind), (scope_id, status))")
def agg_a1_stats(spark, d):
    """Statistics of each scope: total, by kind, by status."""
    sets = memories(spark, d).select("scope_id", "kind", "status")
    return sets.groupingSets([["scope_id"], ["scope_id", "kind"], ["scope_id", "status"]], "scope_id", "kind", "status").agg(F.count(F.lit(1)).alias("n"))


_RANK = "CASE trust WHEN 'evidence' THEN 0 WHEN 'assertion' THEN 1 ELSE 2 END"


@C.query(f"WITH {M}, {E} SELECT e.memory_id, min({_RANK})::INT AS least_trust, count(DISTINCT m.id) AS sources FROM e JOIN m ON m.id = e.parent_id GROUP BY 1")
def agg_v15_least_trust(spark, d):
    """The least trust among the sources of each derived memory."""
    rank = F.when(F.col("trust") == "evidence", 0).when(F.col("trust") == "assertion", 1).otherwise(2)
    m = memories(spark, d).select(F.col("id").alias("parent_id"), rank.alias("rank"))
    return edges(spark, d).join(m, "parent_id").groupBy("memory_id").agg(F.min("rank").alias("least_trust"), F.countDistinct("parent_id").alias("sources"))


@C.query(f"WITH {M} SELECT scope_id, id, row_number() OVER (PARTITION BY scope_id, source, external_id ORDER BY created, id) - 1 AS ordinal FROM m WHERE external_id IS NOT NULL")
def window_w1_ordinal(spark, d):
    """The ordinal of each capture of one source item, from 0."""
    w = W.partitionBy("scope_id", "source", "external_id").orderBy("created", "id")
    return memories(spark, d, "external_id IS NOT NULL").select("scope_id", "id", (F.row_number().over(w) - 1).cast("bigint").alias("ordinal"))


@C.query(f"WITH {M} SELECT a.id, a.superseded_by AS successor, min(p.id) AS predecessor, count(p.id) AS predecessors FROM m a LEFT JOIN m p ON p.superseded_by = a.id GROUP BY 1, 2")
def window_w2_chain(spark, d):
    """Successor and predecessors of each memory in its chain of replacements."""
    m = memories(spark, d).select("id", "superseded_by")
    p = m.where("superseded_by IS NOT NULL").groupBy(F.col("superseded_by").alias("id")).agg(F.min("id").alias("predecessor"), F.count(F.lit(1)).alias("predecessors"))
    return m.join(p, "id", "left").select("id", F.col("superseded_by").alias("successor"), "predecessor", F.coalesce("predecessors", F.lit(0)).alias("predecessors"))


@C.query(f"WITH RECURSIVE {M}, l AS (SELECT id, superseded_by AS up FROM m WHERE superseded_by IS NOT NULL), w AS (SELECT id, up AS head, 1::BIGINT AS steps, [up] AS path FROM l UNION ALL SELECT w.id, l.up, w.steps + 1, list_append(w.path, l.up) FROM w JOIN l ON l.id = w.head WHERE NOT list_contains(w.path, l.up)), e AS (SELECT * FROM w WHERE head NOT IN (SELECT id FROM l)) SELECT l.id, coalesce(e.head, 'cycle') AS head, coalesce(e.steps, -1) AS steps FROM l LEFT JOIN e USING (id)")
def join_j6_chain_head(spark, d):
    """The last replacement of each superseded memory, by pointer doubling; loops are marked."""
    links = memories(spark, d, "superseded_by IS NOT NULL").select("id", F.col("superseded_by").alias("parent_id"))
    return hierarchy.resolve(spark, links).select("id", F.col("root_id").alias("head"), F.col("depth").alias("steps"))


@C.query(f"WITH {M}, p AS (SELECT source, updated AS moment, count(*) AS here FROM m WHERE status IN ('superseded', 'expired', 'erased') GROUP BY 1, 2) SELECT source, moment, here, (sum(here) OVER (PARTITION BY source ORDER BY moment RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))::BIGINT AS within, within <= 100 AND (t.total <= 25 OR within <= 0.2 * t.total) AS allowed FROM p JOIN (SELECT source, count(*) AS total FROM m GROUP BY 1) t USING (source)")
def window_w4_valve(spark, d):
    """Retirements of each source within 24 hours against the valve: at most 100, and a fifth of its records where it has more than 25."""
    gone = memories(spark, d, "status IN ('superseded', 'expired', 'erased')").select("source", F.col("updated").alias("moment"))
    total = memories(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("_total"))
    held = records.rolling_valve(gone, ["source"], "moment", 86400, 100).join(total, "source")
    return held.withColumn("allowed", F.col("allowed") & ((F.col("_total") <= 25) | (F.col("within") <= 0.2 * F.col("_total")))).drop("_total")


@C.query(f"WITH {M}, f AS (SELECT id, scope_id, sha256(scope_id || chr(31) || kind || chr(31) || {_normal_sql('text')}) AS fingerprint, title, created, media FROM m WHERE text IS NOT NULL) SELECT scope_id, fingerprint, min((created, id))[2] AS id, count(*) - 1 AS uses, max(created) AS last_used, max(created) AS updated, arg_min(title, (created, id)) FILTER (title IS NOT NULL) AS title, len(list_distinct(flatten(list(media))))::BIGINT AS media_refs FROM f GROUP BY 1, 2")
def lifecycle_l1_l2_merge(spark, d):
    """Captures merged by fingerprint."""
    m = memories(spark, d, "text IS NOT NULL")
    return records.merge_captures(m.select("id", "scope_id", X.fingerprint(F.col("scope_id"), F.col("kind"), F.col("text")).alias("fingerprint"), "title", "created", "media"))


@C.query(f"WITH {M} SELECT id, status, CASE WHEN status = 'active' AND created + 31536000 <= {NOW} THEN 'expired' ELSE status END AS new_status FROM m")
def lifecycle_l5_expire(spark, d):
    """Statuses after expiry of what is valid for a year."""
    return records.expire_due(memories(spark, d), F.col("created") + 31536000, F.lit(NOW)).select("id", "status", "new_status")


@C.query(f"WITH {M}, {E}, g AS (SELECT id FROM m WHERE status = 'erased') SELECT m.id, CASE WHEN g.id IS NULL THEN octet_length(encode(m.text))::BIGINT END AS bytes_left, m.status, m.id IN (SELECT memory_id FROM e WHERE parent_id IN (SELECT id FROM g)) AS origin_erased FROM m LEFT JOIN g USING (id)")
def lifecycle_l7_erase(spark, d):
    """Records after erasure, their direct derivations marked."""
    m = memories(spark, d).select("id", "status", "text")
    done = records.erase(m, m.where("status = 'erased'").select("id"), edges(spark, d))
    return done.select("id", F.octet_length("text").cast("bigint").alias("bytes_left"), "status", "origin_erased")


@C.query(f"WITH {M} SELECT id, round(base::DOUBLE * pow(0.5, greatest({NOW} - last_used, 0) / 2592000.0), 6) AS importance FROM m")
def lifecycle_l10_decay(spark, d):
    """Importance at one instant."""
    return memories(spark, d).select("id", F.round(X.decayed(F.col("base"), F.col("last_used"), F.lit(NOW)), 6).alias("importance"))


@C.query(f"WITH {M} SELECT id, kind, (status = 'superseded' AND superseded_by IS NULL) OR (status <> 'superseded' AND superseded_by IS NOT NULL) AS broken, kind = 'correction' AND len(derived_from) = 0 AS unfounded, superseded_by = id AS own FROM m")
def lifecycle_l3_l4_checks(spark, d):
    """Broken replacements: a status without its successor, a correction without a source, a memory that replaces itself."""
    s = F.col("superseded_by")
    broken = ((F.col("status") == "superseded") & s.isNull()) | ((F.col("status") != "superseded") & s.isNotNull())
    return memories(spark, d).select("id", "kind", broken.alias("broken"), ((F.col("kind") == "correction") & (F.size("derived_from") == 0)).alias("unfounded"), (s == F.col("id")).alias("own"))


#: The instant of the earlier look at a vault.
SEEN = 1735689600


@C.query(f"WITH {M}, v AS (SELECT source, external_id, arg_max(sha256(coalesce(text, '')), (created, id)) FILTER (created <= {SEEN}) AS was, arg_max(sha256(coalesce(text, '')), (created, id)) FILTER (status <> 'erased') AS now FROM m WHERE external_id IS NOT NULL GROUP BY 1, 2) SELECT source, external_id, CASE WHEN was IS NULL THEN 'capture' WHEN now IS NULL THEN 'expire' WHEN was <> now THEN 'supersede' ELSE 'keep' END AS action FROM v WHERE was IS NOT NULL OR now IS NOT NULL")
def set_o9_u2_reconcile(spark, d):
    """A vault as it was seen and as it is: what is new is captured, what changed is superseded, what is gone expires."""
    m = memories(spark, d, "external_id IS NOT NULL").select("source", "external_id", "created", "id", "status", F.sha2(F.coalesce("text", F.lit("")), 256).alias("body"))
    last = lambda rows, name: rows.groupBy("source", "external_id").agg(F.max_by("body", F.struct("created", "id")).alias(name))
    both = last(m.where(F.col("created") <= SEEN), "was").join(last(m.where("status <> 'erased'"), "now"), ["source", "external_id"], "full")
    action = F.when(F.col("was").isNull(), "capture").when(F.col("now").isNull(), "expire").when(F.col("was") != F.col("now"), "supersede").otherwise("keep")
    return both.select("source", "external_id", action.alias("action"))


@C.query(f"WITH {M}, {E}, k AS (SELECT memory_id, list(DISTINCT parent_id ORDER BY parent_id) AS linked FROM e GROUP BY 1) SELECT m.id AS memory_id, array_to_string(list_sort(list_distinct(m.derived_from)), ',') AS listed, coalesce(array_to_string(k.linked, ','), '') AS linked, listed = coalesce(array_to_string(k.linked, ','), '') AS same FROM m LEFT JOIN k ON k.memory_id = m.id WHERE len(m.derived_from) > 0")
def check_derivations_agree(spark, d):
    """Each derived record's own list of origins beside the table's, and whether they name the same."""
    m = memories(spark, d).where(F.size("derived_from") > 0).select(F.col("id").alias("memory_id"), F.array_join(F.array_sort(F.array_distinct("derived_from")), ",").alias("listed"))
    e = edges(spark, d).groupBy("memory_id").agg(F.array_join(F.array_sort(F.collect_set("parent_id")), ",").alias("linked"))  # the parents of one record
    out = m.join(e, "memory_id", "left").withColumn("linked", F.coalesce("linked", F.lit("")))
    return out.withColumn("same", F.col("listed") == F.col("linked"))


@C.query(f"WITH {M} SELECT id FROM m WHERE status = 'active' AND kind IN ('fact', 'decision') UNION SELECT memory_id FROM stored_vector INTERSECT SELECT id FROM m WHERE trust = 'evidence'")
def set_u1_union(spark, d):
    """Candidates of two channels, united and cut to what is evidence."""
    m = memories(spark, d)
    a = m.where("status = 'active' AND kind IN ('fact', 'decision')").select("id")
    b = table(spark, d, "stored_vector").select(F.col("memory_id").alias("id")).intersect(m.where("trust = 'evidence'").select("id"))
    return a.union(b).distinct()


@C.query("SELECT model_id, revision, active = 1 AS active, (SELECT sum(active)::BIGINT FROM model_revision) = 1 AS one_active FROM model_revision")
def lifecycle_l14_activation(spark, d):
    """Model revisions, and whether exactly one is active."""
    m = table(spark, d, "model_revision")
    return m.select("model_id", "revision", (F.col("active") == 1).alias("active"), F.lit(m.where("active = 1").count() == 1).alias("one_active"))


@C.query(f"WITH {M}, a AS (SELECT scope_id, id AS memory_id, 'captured' AS what, created AS moment, '' AS ref FROM m UNION ALL SELECT scope_id, id, 'updated', updated, '' FROM m WHERE updated > created UNION ALL SELECT scope_id, memory_id, 'embedded', updated, chunk_id FROM (SELECT DISTINCT scope_id, memory_id, updated, chunk_id FROM stored_vector WHERE memory_id IS NOT NULL)) SELECT *, row_number() OVER (PARTITION BY scope_id, memory_id ORDER BY moment, what, ref) AS number FROM a")
def audit_x21(spark, d):
    """The history of each record in order: its capture, its last change and the vectors made of it."""
    m = memories(spark, d).select("scope_id", F.col("id").alias("memory_id"), "created", "updated")
    parts = [m.select("scope_id", "memory_id", F.lit("captured").alias("what"), F.col("created").alias("moment"), F.lit("").alias("ref")), m.where("updated > created").select("scope_id", "memory_id", F.lit("updated").alias("what"), F.col("updated").alias("moment"), F.lit("").alias("ref"))]
    v = table(spark, d, "stored_vector").where("memory_id IS NOT NULL").select("scope_id", "memory_id", F.lit("embedded").alias("what"), F.col("updated").alias("moment"), F.col("chunk_id").alias("ref")).distinct()
    place = F.row_number().over(W.partitionBy("scope_id", "memory_id").orderBy("moment", "what", "ref"))
    return parts[0].unionByName(parts[1]).unionByName(v).withColumn("number", place.cast("bigint"))


QUERIES, ORACLES = C.queries, C.oracles
