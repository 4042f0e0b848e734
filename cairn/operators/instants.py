"""Mixed timestamp forms and time zones, normalised to microseconds since 1970 UTC.

A value is brought into one canonical form by anchored patterns (one replacement per form tried), its
civil date is checked by a cast, and its zone is settled in this order: stated offset, abbreviation,
named zone, zone of the system that wrote it. Zone-local times meet a table of zone-offset intervals,
exploded by (zone, span of local years): two intervals that hold the local time mean ambiguous, none means
skipped, and one gives the offset.
"""

from __future__ import annotations

import bisect
import struct
from calendar import isleap
from datetime import UTC, date, datetime
from functools import lru_cache
from importlib import resources
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Local years that the interval table covers. Before them every zone keeps its first offset, which holds without a beginning;
#: the rules that hold from then on repeat with the calendar, so a later year is looked up as one of the last 28 before the end.
YEARS = (1830, 2132)
#: Earlier than any local second.
EVER = -(1 << 52)
#: Local years whose intervals one row of the table holds.
SPAN = 5
#: Seconds between two looks at a zone's yearly rule; no rule undoes its change within that time.
STEP = 14 * 86400

MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_MON = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_TAIL = r"\s*(?:([Zz])(?![A-Za-z])|([+-]\d{2}(?::?\d{2})?))?\s*(?:\[([A-Za-z][A-Za-z0-9_+/-]*)\]|([A-Za-z][A-Za-z0-9_+/-]*))?$"

#: form -> (pattern, replacement); the replacement's fields are year|month|day|hour|minute|second|fraction|AM or PM|offset|zone.
FORMS = {
    "iso": (rf"^(\d{{4}})-(\d{{2}})(?:-(\d{{2}})(?:[T ](\d{{2}})(?::(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,9}}))?)?)?)?)?{_TAIL}", "$1|$2|$3|$4|$5|$6|$7||$8$9|$10$11"),
    "basic": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_TAIL}", "$1|$2|$3|$4|$5|$6|$7||$8$9|$10$11"),
    "dots": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:[T ]{_CLOCK})?{_TAIL}", "$3|$2|$1|$4|$5|$6|$7||$8$9|$10$11"),
    "mail": (rf"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),\s*)?(\d{{1,2}}) {_MON} (\d{{4}})(?:\s+{_CLOCK})?{_TAIL}", "$3|$2|$1|$4|$5|$6|$7||$8$9|$10$11"),
    "us": (rf"^{_MON} (\d{{1,2}}), (\d{{4}})(?:,? {_CLOCK}(?:\s*([AP]M))?)?{_TAIL}", "$3|$1|$2|$4|$5|$6|$7|$8|$9$10|$11$12"),
    "dmy": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:[T ]{_CLOCK})?{_TAIL}", "$3|$2|$1|$4|$5|$6|$7||$8$9|$10$11"),
    "mdy": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:[T ]{_CLOCK})?{_TAIL}", "$3|$1|$2|$4|$5|$6|$7||$8$9|$10$11"),
    "ymd": (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:[T ]{_CLOCK})?{_TAIL}", "$1|$2|$3|$4|$5|$6|$7||$8$9|$10$11"),
}
_JSON = "local STRING, precision STRING, zone STRUCT<kind: STRING, name: STRING, seconds: STRING>"
_BLANKS = "' \\t\\n\\r\\u000b\\f\\u00a0\\u3000'"


def _zone_file(name: str) -> bytes:
    for folder in TZPATH:
        path = Path(folder, name)
        if path.is_file():
            return path.read_bytes()
    return resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()


def _listed(raw: bytes) -> tuple[list[tuple[int, int]], int, bool]:
    """Of a zone file (RFC 8536, second block): (UTC second, offset from then on) of each change, the offset before them, whether a yearly rule follows."""
    sizes = lambda at: struct.unpack(">6l", raw[at + 20 : at + 44])
    utc, std, leap, times, types, chars = sizes(0)
    at = 44 + times * 5 + types * 6 + chars + leap * 8 + std + utc
    utc, std, leap, times, types, chars = sizes(at)
    at += 44
    moments = struct.unpack(f">{times}q", raw[at : at + 8 * times])
    kinds = raw[at + 8 * times : at + 9 * times]
    at += 9 * times
    offsets = [struct.unpack(">l", raw[at + 6 * i : at + 6 * i + 4])[0] for i in range(types)]
    at += types * 6 + chars + leap * 12 + std + utc
    return [(m, offsets[k]) for m, k in zip(moments, kinds)], offsets[0], b"," in raw[at:]


def offset_intervals(name: str, years: tuple[int, int] = YEARS) -> list[tuple[int, int, int]]:
    """(first UTC second, UTC second after the last, offset) of each stretch of one offset in a zone."""
    begin, end = (int(datetime(y, m, d, tzinfo=UTC).timestamp()) for y, m, d in ((years[0] - 1, 12, 25), (years[1] + 1, 1, 8)))
    changes, before, ruled = _listed(_zone_file(name))
    if ruled:
        zone, at = ZoneInfo(name), changes[-1][0] if changes else begin
        offset_at = lambda second: int(datetime.fromtimestamp(second, zone).utcoffset().total_seconds())
        offset = offset_at(at)
        while at < end:
            new = offset_at(at + STEP)
            if new != offset:
                cut = at + bisect.bisect_left(range(STEP), True, key=lambda s: offset_at(at + s) != offset)
                changes.append((cut, new))
                offset = new
            at += STEP
    found, begun, offset = [], begin, before
    for moment, new in changes:
        if moment <= begin:
            offset = new
        elif moment < end and new != offset:
            found.append((begun, moment, offset))
            begun, offset = moment, new
    return [*found, (begun, end, offset)]


@lru_cache(maxsize=4)
def _zone_rows(years: tuple[int, int] = YEARS) -> pa.Table:
    day = 86400
    first_day = {b: int(datetime(b * SPAN, 1, 1, tzinfo=UTC).timestamp()) // day for b in range(years[0] // SPAN, years[1] // SPAN + 2)}
    spans = sorted(first_day)
    starts = [first_day[b] * day for b in spans]
    rows = []
    for name in sorted(available_timezones()):
        held: dict[int, list[dict]] = {}
        for n, (start, end, offset) in enumerate(offset_intervals(name, years)):
            low, high = start + offset if n else EVER, end + offset
            for i in range(max(0, bisect.bisect_right(starts, low) - 1), bisect.bisect_left(starts, high)):
                held.setdefault(spans[i], []).append({"low": low, "high": high, "offset": offset})
        rows += [{"zone": name, "span": span, "held": x} for span, x in held.items()]
    one = pa.struct([("low", pa.int64()), ("high", pa.int64()), ("offset", pa.int32())])
    return pa.Table.from_pylist(rows, schema=pa.schema([("zone", pa.string()), ("span", pa.int32()), ("held", pa.list_(one))]))


def zone_table(spark: SparkSession, years: tuple[int, int] = YEARS) -> DataFrame:
    """(zone, span, held): for each IANA zone and SPAN local years the intervals [low, high) of local seconds with their offset.

    Its size follows from the zone database (about 600 zones) and the years alone, so it may be broadcast.
    """
    return spark.createDataFrame(_zone_rows(years))


def _like_years(years: tuple[int, int] = YEARS) -> list[int]:
    """For each first weekday (Sunday first) and each of plain and leap: the year among the 28 before the end of ``years`` with that calendar."""
    of = {(date(y, 1, 1).isoweekday() % 7, isleap(y)): y for y in range(years[1] - 28, years[1])}
    return [of[weekday, leap] for weekday in range(7) for leap in (False, True)]


def _looked_up(local: Column, year: Column) -> Column:
    """The local second to be looked up in the zone table: moved, from the end of the table's years on, into a year of the same calendar."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    leap = F.day(F.last_day(F.make_date(year, F.lit(2), F.lit(1)))) == 29
    like = F.element_at(F.array(*map(F.lit, _like_years())), 2 * F.dayofweek(first) - 1 + leap.cast("int"))
    days = F.unix_date(first) - F.unix_date(F.make_date(like, F.lit(1), F.lit(1)))
    return F.when(year < YEARS[1], local).otherwise(local - days.cast("bigint") * 86400)


def _replaced(value: Column, form: str) -> Column:
    pattern, into = FORMS[form]
    return F.regexp_replace(value, pattern, into)


def _canonical(value: Column, order: Column) -> Column:
    """The value's ten fields, joined by bars; unchanged if it has no known form. Slashes are read in the given order.

    The place of the first separator picks the one pattern to try.
    """
    at = lambda i, c: F.substring(value, i, 1) == c
    slash = F.when(order == "dmy", _replaced(value, "dmy")).when(order == "mdy", _replaced(value, "mdy")).when(order == "ymd", _replaced(value, "ymd"))
    form = F.when(at(5, "-"), _replaced(value, "iso")).when(at(9, "T"), _replaced(value, "basic"))
    form = form.when(at(2, "/") | at(3, "/") | at(5, "/"), slash).when(at(2, ".") | at(3, "."), _replaced(value, "dots"))
    return form.when(at(4, " ") & ~at(2, " "), _replaced(value, "us")).otherwise(_replaced(value, "mail"))


def _parsed(spark: SparkSession, df: DataFrame, value: str, system: str, systems: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """df with columns ``_t_``: the value's fields, its local second, its offset where one is stated, and the zone intervals that may hold it."""
    known = F.broadcast(systems.select(F.col("system_name").alias("_t_system"), F.col("zone_name").alias("_t_home"), F.col("date_order").alias("_t_order")).dropDuplicates(["_t_system"]))
    short = F.broadcast(abbreviations.select(F.col("abbrev").alias("_t_abbrev"), F.col("offset_seconds").cast("int").alias("_t_short")).dropDuplicates(["_t_abbrev"]))
    zones = F.broadcast(zone_table(spark).select(F.col("zone").alias("_t_zone"), F.col("span").alias("_t_span"), F.col("held").alias("_t_held")))

    v = F.replace(F.expr(f"btrim(`{value}`, {_BLANKS})"), F.lit("−"), F.lit("-"))
    df = df.join(known, F.col(system) == F.col("_t_system"), "left").withColumn("_t_v", F.when(~v.contains("|"), v))
    is_json = F.col("_t_v").startswith("{")
    df = df.withColumn("_t_json", F.when(is_json, F.from_json("_t_v", _JSON)))
    kind = F.col("_t_json.zone.kind")
    seconds = F.when(kind == "offset", F.col("_t_json.zone.seconds").try_cast("int"))
    local = F.when(kind.isNull() | (kind == "floating"), F.col("_t_json.local"))
    local = local.when((kind == "iana") & F.col("_t_json.zone.name").isNotNull(), F.concat("_t_json.local", F.lit("["), "_t_json.zone.name", F.lit("]")))
    local = local.when((kind == "offset") & seconds.isNotNull(), F.concat("_t_json.local", F.lit("Z")))
    digits = F.col("_t_v").rlike(r"^\d{1,17}(\.\d+)?$")
    df = df.withColumns({"_t_digits": digits, "_t_floating": F.coalesce(kind == "floating", F.lit(False))})
    df = df.withColumn("_t_f", F.split(F.when(digits, None).otherwise(_canonical(F.when(is_json, local).otherwise(F.col("_t_v")), F.col("_t_order"))), r"\|"))

    f = [F.get("_t_f", i) for i in range(10)]
    number = lambda c: F.when(c == "", 0).otherwise(c.try_cast("int"))
    month = F.when(F.length(f[1]) == 3, ((F.instr(F.lit(MONTHS), f[1]) + 2) / 3).cast("int").cast("string")).otherwise(f[1])
    date = F.concat(f[0], F.lit("-"), month, F.lit("-"), F.when(f[2] == "", "1").otherwise(f[2])).try_cast("date")
    hour = number(f[3])
    hour = F.when(f[7] == "", hour).when(hour.between(1, 12), hour % 12 + F.when(f[7] == "PM", 12).otherwise(0)).otherwise(99)
    fits = (hour <= 23) & (number(f[4]) <= 59) & (number(f[5]) <= 59)
    df = df.withColumn("_t_local", F.when((F.size("_t_f") == 10) & fits, F.unix_date(date).cast("bigint") * 86400 + hour * 3600 + number(f[4]) * 60 + number(f[5])))
    df = df.withColumn("_t_fraction", F.rpad(F.coalesce(f[6], F.lit("")), 6, "0").try_cast("bigint"))

    bare = F.replace(f[8], F.lit(":"), F.lit(""))
    hours, minutes = F.substring(bare, 2, 2).try_cast("int"), number(F.substring(bare, 4, 2))
    offset = F.when(f[8].isin("Z", "z"), 0).when((f[8] != "") & (hours <= 18) & (minutes <= 59), (hours * 3600 + minutes * 60) * F.when(f[8].startswith("-"), -1).otherwise(1))
    offset = F.coalesce(seconds, offset)
    df = df.withColumn("_t_offset", F.when(F.abs(offset) <= 64800, offset)).withColumn("_t_stated", f[8] != "")
    df = df.withColumn("_t_token", F.when(~F.col("_t_stated") & (f[9] != ""), f[9]))
    df = df.join(short, F.col("_t_token") == F.col("_t_abbrev"), "left")
    df = df.withColumn("_t_offset", F.coalesce("_t_offset", F.when(~F.col("_t_stated"), F.col("_t_short"))))
    needs = F.col("_t_local").isNotNull() & F.col("_t_offset").isNull() & ~F.col("_t_stated") & ~F.col("_t_floating")
    df = df.withColumn("_t_ask", F.when(needs, F.coalesce("_t_token", "_t_home"))).withColumn("_t_year", F.when(needs, f[0].try_cast("int")))
    df = df.withColumn("_t_at", F.when(needs, _looked_up(F.col("_t_local"), F.col("_t_year"))))
    looked = F.when(F.col("_t_year") < YEARS[1], F.col("_t_year")).when(F.col("_t_at").isNotNull(), F.year(F.timestamp_seconds("_t_at")))
    df = df.withColumn("_t_y", F.greatest((looked / SPAN).cast("int"), F.lit(YEARS[0] // SPAN)))
    df = df.join(zones, (F.col("_t_ask") == F.col("_t_zone")) & (F.col("_t_y") == F.col("_t_span")), "left")
    return df


def _epoch() -> Column:
    """The microseconds since 1970 that a value of digits alone counts, as seconds, milliseconds or microseconds by its length."""
    whole, part = F.substring_index("_t_v", ".", 1), F.when(F.col("_t_v").contains("."), F.substring_index("_t_v", ".", -1)).otherwise("")
    length = F.length(whole)
    places = F.when(length <= 11, 6).when(length <= 14, 3).otherwise(0)
    return F.concat(whole, F.substring(F.rpad(part, 6, "0"), F.lit(1), places)).try_cast("bigint")


def _bare(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_t_")])


def normalise(spark: SparkSession, df: DataFrame, value: str, system: str, systems: DataFrame, abbreviations: DataFrame, out: str = "utc_us") -> DataFrame:
    """Adds ``out``: the one instant (microseconds since 1970 UTC, BIGINT) that ``value`` names, or null.

    ``system`` holds the name of the writing system, to be found in ``systems`` (system_name, zone_name,
    date_order), a fixed small table like ``abbreviations`` (abbrev, offset_seconds). All other columns
    of df are kept, and nothing is shuffled.

    Null, empty and unknown texts, impossible dates and times, floating times, local times that their
    zone skips or has twice, unknown zones, and zone-less values of a system that is unknown or has no
    zone give null. A bar in a value (no known form has one) gives null. Fractions beyond microseconds
    are cut off. An empty df gives an empty result. Column names of df that begin with ``_t_`` clash.
    """
    df = _parsed(spark, df, value, system, systems, abbreviations)
    df = df.withColumn("_t_fit", F.filter("_t_held", lambda x: (x["low"] <= F.col("_t_at")) & (F.col("_t_at") < x["high"])))
    at = F.coalesce("_t_offset", F.when(F.size("_t_fit") == 1, F.col("_t_fit")[0]["offset"]))
    return _bare(df.withColumn(out, F.when(F.col("_t_digits"), _epoch()).when(~F.col("_t_floating"), (F.col("_t_local") - at) * 1_000_000 + F.col("_t_fraction"))))


#: Seconds by which a time without a zone may lie earlier or later.
FLOATING = 14 * 3600


def windows(spark: SparkSession, df: DataFrame, value: str, system: str, systems: DataFrame, abbreviations: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: STRUCT<definite_low, definite_high, possible_low, possible_high>, seconds since 1970 UTC, [low, high), or null for an unusable value.

    A value stands for the whole second, minute or hour that it names, a date for its day, month or year in
    UTC. A floating time, or one without a zone from a system whose zone is unknown, is possible up to 14 hours
    before and after and definite nowhere; so is, within its two instants, a local time that its zone has twice.
    A local time that its zone skips is unusable. Other columns are kept, and nothing is shuffled.
    """
    df = _parsed(spark, df, value, system, systems, abbreviations)
    f = [F.get("_t_f", i) for i in range(10)]
    written = lambda c: F.coalesce(c != "", F.lit(False))
    width = F.when(written(f[5]), 1).when(written(f[4]), 60).otherwise(3600)
    start = F.col("_t_local")
    held = lambda second: F.filter("_t_held", lambda x: (x["low"] <= second) & (second < x["high"]))
    df = df.withColumns({"_t_width": width.cast("bigint"), "_t_from": held(F.col("_t_at")), "_t_upto": held(F.col("_t_at") + width)})
    end = start + F.col("_t_width")
    day = F.timestamp_seconds(start).cast("date")
    after = F.when(written(f[2]), F.date_add(day, 1)).when(written(f[1]), F.add_months(day, 1)).otherwise(F.add_months(day, 12))
    offsets = lambda c, pick: pick(F.transform(c, lambda x: x["offset"]))
    first, last = start - offsets("_t_from", F.array_max), end - offsets("_t_upto", F.array_min)
    sure = (F.size("_t_from") == 1) & (F.size("_t_upto") == 1)
    known = (F.size("_t_from") >= 1) & (F.size("_t_upto") >= 1)
    floating = F.col("_t_floating") | (F.col("_t_offset").isNull() & F.col("_t_ask").isNull() & ~F.col("_t_stated"))
    second = F.floor(_epoch() / 1_000_000).cast("bigint")

    def window(low: Column, high: Column, definite: Column) -> Column:
        return F.struct(F.when(definite, low).alias("definite_low"), F.when(definite, high).alias("definite_high"), low.alias("possible_low"), high.alias("possible_high"))

    yes, no = F.lit(True), F.lit(False)
    found = F.when(F.col("_t_digits"), F.when(second.isNotNull(), window(second, second + 1, yes)))
    found = found.when(start.isNull(), None).when(~written(f[3]), window(start, F.unix_date(after).cast("bigint") * 86400, yes))
    found = found.when(F.col("_t_offset").isNotNull(), window(start - F.col("_t_offset"), end - F.col("_t_offset"), yes))
    found = found.when(floating, window(start - FLOATING, end + FLOATING, no)).when(known, window(first, last, sure))
    return _bare(df.withColumn(out, found))


def normalise_fields(spark: SparkSession, history: DataFrame, systems: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """(scope_id, tx_seq, field_name, utc_us) of the three written times of a claim history; only usable values.

    A row delivered again counts once; should its copies name different instants, the earliest stands.
    """
    field = lambda name, c: F.struct(F.lit(name).alias("field_name"), c.alias("value"))
    each = F.explode(F.array(field("valid_time", F.col("valid_time")), field("source_time", F.col("source_time")), field("captured_at", F.col("provenance.captured_at"))))
    long = history.select("scope_id", "tx_seq", F.col("provenance.source.system").alias("system"), each.alias("x")).select("scope_id", "tx_seq", "system", "x.field_name", "x.value")
    done = normalise(spark, long.where(F.col("value").isNotNull()), "value", "system", systems, abbreviations)
    done = done.where(F.col("utc_us").isNotNull())
    return done.groupBy("scope_id", "tx_seq", "field_name").agg(F.min("utc_us").alias("utc_us"))
