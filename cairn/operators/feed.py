"""A change feed kept as a log-structured merge table.

Changes are appended as runs. A run is a table bucketed by key and sorted by key within its buckets, with
one row a key: its last entry. A read merges the runs bucket by bucket: sort-merge joins on the key, which
need no exchange as all runs have the same buckets, keep of each key the run whose entry is the last, and a
key whose last entry is a removal (a tombstone) is absent. Compaction writes the merge of all runs as one
run; an append that makes the runs MOST_RUNS does it, so a read merges fewer.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import fresh_path, remove_path

#: Runs at which an append compacts them. The claim feed, a run a source, reaches it with its last one.
MOST_RUNS = 3
#: Columns of a run besides the entry's own: the key as one value, and what orders the entries of a key.
KEY, PLACE = "_key", "_place"


@dataclass
class ChangeTable:
    """Runs of one table below ``path``. ``keys`` identify a row, ``order`` (a list of columns) orders its entries, ``removed`` marks tombstones.

    Entries may come repeated, late and in any order: a read depends only on the set of entries. Entries
    with a null order count as the earliest; of entries with one order a removal is the last, then the one
    with the greatest hash. Null keys are keys like others. All runs have the same columns; extra columns
    are payload. ``buckets`` is the session's number of shuffle partitions, so that the shuffle by which a
    run is reduced to a row a key makes its buckets, too.
    """

    spark: SparkSession
    path: str
    keys: list[str]
    order: list[str]
    removed: str = "removed"
    buckets: int = 0
    runs: list[str] = field(default_factory=list)

    @classmethod
    def create(cls, spark: SparkSession, keys: list[str], order: list[str], label: str = "feed", **options) -> "ChangeTable":
        return cls(spark, fresh_path(spark, label), keys, order, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")), **options)

    def append(self, entries: DataFrame) -> "ChangeTable":
        """Adds entries as one run, first reduced to the last entry of each key, and compacts MOST_RUNS runs.

        Tombstones stay. Compaction removes the runs that it merged, so read again after an append.
        """
        rest = [c for c in entries.columns if c not in (*self.order, self.removed)]
        place = F.struct(*self.order, self.removed, F.xxhash64(*rest).alias("_hash")).alias(PLACE)
        # Pre-aggregated before the shuffle, so a hot key costs one row a task.
        keyed = entries.select(F.to_json(F.struct(*self.keys)).alias(KEY), place, F.struct(*entries.columns).alias("_entry"))
        last = keyed.groupBy(KEY).agg(F.max_by(F.struct(PLACE, "_entry"), PLACE).alias("_last"))
        self._write(last.select(KEY, f"_last.{PLACE}", "_last._entry.*"))
        return self.compact() if len(self.runs) >= MOST_RUNS else self

    def merged(self) -> DataFrame:
        """The last entry of each key over all runs, tombstones included."""
        return self._merge().drop(KEY, PLACE)

    def read(self) -> DataFrame:
        """The rows present: the last entries that are no tombstones."""
        return self.merged().where(~F.col(self.removed)).drop(self.removed)

    def compact(self, keep_tombstones: bool = True) -> "ChangeTable":
        """Replaces all runs by their merge. Tombstones may go only once no older entry can still arrive."""
        merged = self._merge()
        old, self.runs = self.runs, []
        self._write(merged if keep_tombstones else merged.where(~F.col(self.removed)))
        for run in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            remove_path(self.spark, f"{self.path}/{run}")
        return self

    def _write(self, entries: DataFrame) -> None:
        run = f"run_{uuid.uuid4().hex}"
        entries.write.bucketBy(self.buckets, KEY).sortBy(KEY).option("path", f"{self.path}/{run}").format("parquet").saveAsTable(run)
        self.runs.append(run)

    def _merge(self) -> DataFrame:
        """Of each run the entries that no other run outdoes; equal ones count in the first run that has them."""
        found = [self.spark.table(run) for run in self.runs]
        merged = None
        for i, run in enumerate(found):
            left = run.hint("merge")
            for j, other in enumerate(found):
                if j != i:
                    left = left.join(other.select(KEY, F.col(PLACE).alias(f"_place_{j}")).hint("merge"), KEY, "left")
                    theirs = F.col(f"_place_{j}")
                    left = left.where(theirs.isNull() | (theirs < F.col(PLACE)) | ((theirs == F.col(PLACE)) & F.lit(i < j))).drop(f"_place_{j}")
            merged = left if merged is None else merged.unionByName(left)
        return merged


SLOT = ["scope_id", "subject_key", "predicate_name", "predicate_version", "slot_key"]


def claim_feed(spark: SparkSession, history: DataFrame, relations: DataFrame, retractions: DataFrame) -> ChangeTable:
    """The feed of claims as a ChangeTable with one run a source: writes, replacements (supersedes) and removals.

    Ids and scopes that are null name nothing and are left out. A write carries its slot and source order.
    """
    feed = ChangeTable.create(spark, ["scope_id", "claim_id"], ["tx_seq"], "claims")
    slot = [c for c in SLOT if c != "scope_id"] + ["supersession", "source_seq"]
    entry = ["scope_id", "claim_id", "tx_seq"]
    known = F.col("scope_id").isNotNull() & F.col("claim_id").isNotNull()
    feed.append(history.select(*entry, F.lit(False).alias("removed"), *slot).where(known))
    none = [F.lit(None).cast(history.schema[c].dataType).alias(c) for c in slot]
    gone = [
        relations.where(F.col("relation_kind") == "supersedes").select("scope_id", F.col("to_id").alias("claim_id"), "tx_seq"),
        retractions.select("scope_id", F.col("target_claim_id").alias("claim_id"), "tx_seq"),
    ]
    for removals in gone:
        feed.append(removals.select(*entry, F.lit(True).alias("removed"), *none).where(known))
    return feed


def current_claims(feed: ChangeTable) -> DataFrame:
    """The claims present at the end of the feed.

    In a slot (nulls equal) only the claim with the greatest source_seq among those by_source_order stays
    (ties: the greater tx_seq, then claim_id; a null source_seq is the least); others are untouched.
    """
    present = feed.read()
    ordered = F.coalesce(F.col("supersession") == "by_source_order", F.lit(False))
    winner = F.max(F.struct("source_seq", "tx_seq", "claim_id")).alias("w")
    winners = present.where(ordered).groupBy(*SLOT).agg(winner).select("scope_id", F.col("w.claim_id").alias("claim_id"), *[c for c in SLOT if c != "scope_id"], F.col("w.tx_seq").alias("tx_seq"), F.col("w.source_seq").alias("source_seq"), F.lit("by_source_order").alias("supersession"))
    return winners.unionByName(present.where(~ordered).select(winners.columns))
