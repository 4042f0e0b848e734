from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from cairn.operators import instants


def us(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp() * 1_000_000)


CASES = [
    ("1714105833", "none", "2024-04-26 04:30:33"), ("1714105833.5", "none", "2024-04-26 04:30:33.5"), ("1752965472666", "none", "2025-07-19 22:51:12.666"), ("1724489659204405", "none", "2024-08-24 08:54:19.204405"),
    ("2024-04-28T07:06:11Z", "none", "2024-04-28 07:06:11"), ("20241112T025948Z", "none", "2024-11-12 02:59:48"), (" \t2024-04-28 07:06 ", "warsaw", "2024-04-28 05:06:00"), ("2026-04-04T19+11", "none", "2026-04-04 08:00:00"),
    ("2025-11-05T16:28:27−03:30", "none", "2025-11-05 19:58:27"), ("22/09/2024 19:35", "warsaw", "2024-09-22 17:35:00"), ("09/22/2024 19:35", "york", "2024-09-22 23:35:00"), ("2024/09/22 19:35", "utc", "2024-09-22 19:35:00"),
    ("12.05.2025 05:36", "york", "2025-05-12 09:36:00"), ("Thu, 06 Mar 2025 06:02:55 +0000", "none", "2025-03-06 06:02:55"), ("Dec 11, 2024 12:03 AM", "warsaw", "2024-12-10 23:03:00"), ("Oct 31, 2024 6:43 PM GMT", "york", "2024-10-31 18:43:00"),
    ("2024-10-30T06:53:51+09:00[Europe/Warsaw]", "none", "2024-10-29 21:53:51"), ("2026-01-29T02:29:01[Europe/Warsaw]", "none", "2026-01-29 01:29:01"), ("2025-02-03T16:00 America/St_Johns", "none", "2025-02-03 19:30:00"),
    ("2024-11-01 15:06 CET", "york", "2024-11-01 14:06:00"), ("2024-09", "utc", "2024-09-01 00:00:00"), ("2024-02-26", "york", "2024-02-26 05:00:00"),
    ('{"local":"2026-02-04T20","precision":"hour","zone":{"kind":"iana","name":"Asia/Kolkata"}}', "none", "2026-02-04 14:30:00"), ('{"local":"2026-04-11T13","precision":"hour","zone":{"kind":"offset","seconds":37800}}', "none", "2026-04-11 02:30:00"),
    ("2025-03-30 02:30", "warsaw", None), ("2025-10-26 02:30", "warsaw", None), ("2025-10-26 02:30 CEST", "warsaw", "2025-10-26 00:30:00"), ("2025-01-01 10:00", "none", None), ("2025-01-01 10:00", "unknown", None),
    ('{"local":"2026-02-04T20","precision":"hour","zone":{"kind":"floating"}}', "warsaw", None), ("2025-02-30T10:00:00Z", "utc", None), ("2025-01-01T27:00:00Z", "utc", None), ("13/13/2025 10:00", "york", None), ("Dec 11, 2024 13:03 PM", "utc", None),
    ("next Tuesday", "utc", None), ("", "utc", None), ("null", "utc", None), ("2025-01-01 10:00 XYZ", "utc", None), ("2025-01-01 10:00 Mars/Base", "utc", None), ("2025-01-01T10:00:00+25:00", "utc", None), ("a|b", "utc", None), (None, "utc", None), ("x" * 100_000, "utc", None),
]


@pytest.fixture(scope="module")
def tables(spark):
    systems = spark.createDataFrame([("warsaw", "Europe/Warsaw", "dmy"), ("york", "America/New_York", "mdy"), ("utc", "UTC", "ymd"), ("none", None, "ymd")], "system_name STRING, zone_name STRING, date_order STRING")
    return systems, spark.createDataFrame([("CET", 3600), ("CEST", 7200), ("GMT", 0)], "abbrev STRING, offset_seconds INT")


def test_forms(spark, tables):
    df = spark.createDataFrame([(i, v, s) for i, (v, s, _) in enumerate(CASES)], "n INT, value STRING, system STRING")
    got = {r["n"]: r["utc_us"] for r in instants.normalise(spark, df, "value", "system", *tables).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if got[i] != (us(c[2]) if c[2] else None)]
    assert not wrong and len(got) == len(CASES)


def test_every_hour_of_a_year(spark, tables):
    """Against zoneinfo: a local time counts if exactly one fold of it comes back unchanged."""
    for system, name in (("warsaw", "Europe/Warsaw"), ("york", "America/New_York")):
        zone, start = ZoneInfo(name), datetime(2024, 1, 1)
        local = [start + timedelta(minutes=30 * i) for i in range(366 * 48)]
        df = spark.createDataFrame([(t.strftime("%Y-%m-%d %H:%M"), system) for t in local], "value STRING, system STRING")
        got = {r["value"]: r["utc_us"] for r in instants.normalise(spark, df, "value", "system", *tables).collect()}
        for t in local:
            found = {u for f in (0, 1) if (u := t.replace(tzinfo=zone, fold=f).astimezone(UTC)).astimezone(zone).replace(tzinfo=None) == t}
            assert got[t.strftime("%Y-%m-%d %H:%M")] == (int(found.pop().timestamp() * 1e6) if len(found) == 1 else None)


def test_empty_and_extra_columns(spark, tables):
    df = spark.createDataFrame([], "value STRING, system STRING, zone STRING, year INT, held STRING")
    assert instants.normalise(spark, df, "value", "system", *tables).columns == ["value", "system", "zone", "year", "held", "utc_us"]
    assert instants.normalise(spark, df, "value", "system", *tables).count() == 0


def test_offset_intervals_match_zoneinfo():
    for name in ("Australia/Lord_Howe", "Africa/Casablanca", "Pacific/Apia", "Asia/Kathmandu"):
        for low, high, offset in instants.offset_intervals(name):
            for second in (low, (low + high) // 2, high - 1):
                assert ZoneInfo(name).utcoffset(datetime.fromtimestamp(second, ZoneInfo(name))).total_seconds() == offset


def test_years_far_from_now(spark, tables):
    """Zone-local times of any year from 1 to 9998, against zoneinfo."""
    import random

    rng = random.Random(4)
    names = ["Europe/Warsaw", "America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "Asia/Kolkata", "America/Santiago", "Europe/Dublin", "Pacific/Apia", "Asia/Tehran", "UTC"]
    local = {}
    for _ in range(4000):
        t = datetime(rng.choice([rng.randrange(1, 1900), rng.randrange(1900, 2200), rng.randrange(2100, 9999)]), 1, 1) + timedelta(minutes=30 * rng.randrange(364 * 48))
        local[f"{t:%H:%M}|{t.year:04}-{t:%m-%d}|{rng.choice(names)}".replace("|", " ")] = t
    rows = [f"{k.split(' ')[1]}T{k.split(' ')[0]} {k.split(' ')[2]}" for k in local]
    for year in (2100, 2104, 2400, 9998):  # the hours about a change of the clock
        t = datetime(year, 3, 25)
        for i in range(8 * 24):
            x = t + timedelta(hours=i, minutes=30)
            rows.append(f"{x.year:04}-{x:%m-%d}T{x:%H:%M} Europe/Warsaw")
    df = spark.createDataFrame([(r, "utc") for r in rows], "value STRING, system STRING")
    got = {r["value"]: r["utc_us"] for r in instants.normalise(spark, df, "value", "system", *tables).collect()}
    for row in rows:
        t, zone = datetime.fromisoformat(row.split(" ")[0]), ZoneInfo(row.split(" ")[1])
        found = {u for f in (0, 1) if (u := t.replace(tzinfo=zone, fold=f).astimezone(UTC)).astimezone(zone).replace(tzinfo=None) == t}
        exact = found.pop() - datetime(1970, 1, 1, tzinfo=UTC) if len(found) == 1 else None
        assert got[row] == (exact and exact // timedelta(microseconds=1)), row
