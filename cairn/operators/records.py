"""Operators over governed records: reads, lifecycle and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import text as X


def newest_first(df: DataFrame, scope: str, limit: int) -> DataFrame:
    """The first page of each scope: created descending, id descending, with ``next`` if the page is full.

    The rank is limited before the shuffle, so a scope with many rows sends only its best ones.
    """
    order = W.partitionBy(scope).orderBy(F.desc("created"), F.desc("id"))
    page = df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return page.withColumn("next", F.count(F.lit(1)).over(W.partitionBy(scope)) == limit)


def merge_captures(captures: DataFrame) -> DataFrame:
    """One row for each (scope_id, fingerprint): the first capture, merged with its repeats.

    captures: id, scope_id, fingerprint, title, created, media. The first by (created, id) gives the id;
    uses counts the repeats; last_used and updated are of the last; the first title that is not null wins.
    """
    order, key = F.struct("created", "id"), ["scope_id", "fingerprint"]
    titled = F.min_by("title", F.when(F.col("title").isNotNull(), order))
    merged = captures.groupBy(*key).agg(F.min(order)["id"].alias("id"), (F.count(F.lit(1)) - 1).alias("uses"), F.max(order)["created"].alias("last_used"), F.max("created").alias("updated"), titled.alias("title"))
    media = captures.where(F.size("media") > 0).select(*key, F.explode("media").alias("m")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("media_refs"))
    return merged.join(media, key, "left").fillna(0, ["media_refs"])


def expire_due(df: DataFrame, valid_until: Column, now: Column) -> DataFrame:
    """The new status of each record: active ones whose time is over are expired."""
    due = (F.col("status") == "active") & valid_until.isNotNull() & (valid_until <= now)
    return df.withColumn("new_status", F.when(due, "expired").otherwise(F.col("status")))


def erase(df: DataFrame, erased: DataFrame, edges: DataFrame) -> DataFrame:
    """Records after erasure: the erased ones blanked, their direct derivations marked.

    erased: (id); edges: (memory_id, parent_id). Repeated ids and edges count once.
    """
    gone = erased.select("id").distinct().withColumn("_gone", F.lit(True))
    marked = edges.join(gone, F.col("parent_id") == F.col("id"), "left_semi").select(F.col("memory_id").alias("id")).distinct().withColumn("_marked", F.lit(True))
    out = df.join(gone, "id", "left").join(marked, "id", "left")
    is_gone = F.coalesce("_gone", F.lit(False))
    out = out.withColumns({"text": F.when(~is_gone, F.col("text")), "status": F.when(is_gone, "erased").otherwise(F.col("status")), "origin_erased": F.coalesce("_marked", F.lit(False))})
    return out.drop("_gone", "_marked")


def verdicts(df: DataFrame, denied: list[str], max_bytes: int = 65536, max_media: int = 16) -> DataFrame:
    """Adds (verdict, code): faults before holds, the earlier check first.

    df: id, text, title, origin, source, media. A null text is empty. Credentials are sought in text and title.
    """
    normal = F.coalesce(X.normal_form(F.col("text")), F.lit(""))
    kinds = ("image", "audio", "video", "application", "text", "font")
    bad_media = (F.size("media") > max_media) | F.exists("media", lambda m: ~F.substring_index(m["media_type"], "/", 1).isin(*kinds))
    fault = F.when(normal == "", "empty_after_normalization").when(F.octet_length(normal) > max_bytes, "too_large").when(bad_media, "unsupported_media")
    fault = fault.when(F.col("source").isin(*denied), "policy_denied").when(X.detected(normal).isNotNull() | X.detected(X.normal_form(F.col("title"))).isNotNull(), "secret").when(F.col("origin") == "unestablished", "origin_unestablished")
    hold = F.when(F.col("origin") == "asserted", "origin_asserted")
    return df.withColumns({"verdict": F.when(fault.isNotNull(), "refuse").when(hold.isNotNull(), "quarantine").otherwise("admit"), "code": F.coalesce(fault, hold)})


def rolling_valve(events: DataFrame, keys: list[str], at: str, seconds: int, most: int) -> DataFrame:
    """Events with the number within the last ``seconds`` of their key, themselves included, and whether it is at most ``most``.

    Counted per second first, then over the seconds of a key.
    """
    per = events.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("here"))
    window = W.partitionBy(*keys).orderBy(at).rangeBetween(-seconds, 0)
    return per.withColumn("within", F.sum("here").over(window)).withColumn("allowed", F.col("within") <= most)


def filter_text(statuses: set[str] | None = None, kinds: set[str] | None = None) -> str:
    """A filter in one form, whatever the order of its sets: the default status is active alone, and no kinds mean all."""
    import json

    held = {"active"} if statuses is None else statuses
    if not held:
        raise ValueError("a filter admits at least one status")
    return json.dumps({"kinds": sorted(kinds or ()), "statuses": sorted(held)}, separators=(",", ":"))


def filtered(df: DataFrame, statuses: set[str] | None = None, kinds: set[str] | None = None) -> DataFrame:
    """The records that a filter admits. An empty set of statuses is refused; no kinds mean all."""
    filter_text(statuses, kinds)
    out = df.where(F.col("status").isin(*sorted({"active"} if statuses is None else statuses)))
    return out.where(F.col("kind").isin(*sorted(kinds))) if kinds else out


def scope_key(owner: str, kind: str = "personal", key: str = "") -> tuple[str, str, str]:
    """(owner, kind, key) of the scope that a request names: personal without a key unless it names a project or a share by its key."""
    if kind not in ("personal", "project", "shared"):
        raise ValueError(f"no such kind of scope: {kind}")
    if not owner or (kind == "personal") == bool(key):
        raise ValueError("a scope has an owner, and a key unless it is personal")
    return owner, kind, key
