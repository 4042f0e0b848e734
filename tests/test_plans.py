"""Plans: conditions reach the scan, and states of a work queue."""

import re

import pytest

from cairn.plans import catalog
from cairn.streaming import jobs


@pytest.mark.parametrize("name", ["filter_p7_recall", "scan_s2_first_page", "join_j3_missing", "filter_x20_stale", "filter_p2_default", "lifecycle_l5_batch", "scan_s7_history"])
def test_conditions_reach_the_scan(spark, data, name):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    table = "claim_history" if name == "scan_s7_history" else "memory_record"
    pushed = [p for scan in re.findall(r"FileScan parquet.*", plan) if table in scan for p in re.findall(r"PushedFilters: \[([^\]]+)", scan)]
    assert pushed and all("recorded_at" in p if table == "claim_history" else "status" in p for p in pushed)


def test_states_of_a_queue(spark):
    rows = [("a", 10, True), ("a", 20, False), ("b", 10, True), ("b", 20, True), ("d", 1, False)] + [("c", i, True) for i in range(5)] + [("e", i, True) for i in range(4)]
    got = {r["k"]: (r["attempts"], r["state"], r["next_at"], r["held_until"]) for r in jobs.queue_states(spark.createDataFrame(rows, "k STRING, at BIGINT, failed BOOLEAN"), "k", "at", "failed").collect()}
    assert got == {"a": (1, "done", None, None), "b": (2, "waiting", 24, 80), "c": (5, "dead", None, None), "d": (0, "done", None, None), "e": (4, "waiting", 19, 63)}
