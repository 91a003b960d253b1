"""Mixed timestamp notations to one UTC instant.

All notations are compiled into one alternation with named groups. One regular
expression replacement per entry takes every component out of the text at once
(unmatched groups are empty, so ``${y1}${y2}`` is the year of whichever notation
matched); calendar ranges are checked and the instant is put together from day
numbers in integer arithmetic. Only the offset of a time zone at an instant is
looked up. Everything is a Catalyst expression; no Python runs on the data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and their three-letter forms.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

# Minutes east of UTC of zone letters, by country of the office ("" = any).
ZONE_LETTERS = {
    "": {"utc": 0, "gmt": 0, "z": 0, "ut": 0},
    "DE": {"cet": 60, "cest": 120, "mez": 60, "mesz": 120},
    "US": {"est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420},
    "AU": {"aest": 600, "aedt": 660, "est": 600, "edt": 660, "acst": 570, "acdt": 630, "cst": 570, "cdt": 630, "awst": 480, "wst": 480},
    "IN": {"ist": 330},
    "JP": {"jst": 540},
    "GB": {"bst": 60},
    "IE": {"ist": 60},
}

# IANA zones by country, as far as zone letters depend on it.
ZONE_COUNTRY = {
    "Europe/Berlin": "DE", "Europe/London": "GB", "Europe/Dublin": "IE", "Asia/Kolkata": "IN", "Asia/Tokyo": "JP",
    "America/New_York": "US", "America/Chicago": "US", "America/Denver": "US", "America/Los_Angeles": "US",
    "America/Phoenix": "US", "Australia/Sydney": "AU", "Australia/Melbourne": "AU", "Australia/Brisbane": "AU",
    "Australia/Adelaide": "AU", "Australia/Perth": "AU",
}

# Words for a day, counted from the reference date.
DAY_WORDS = {"today": 0, "yesterday": -1, "tomorrow": 1}

_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" + ("|sept" if m == "september" else "") for m in MONTHS) + ")"
_WEEKDAY = "(?:" + "|".join(f"{d[:3]}(?:{d[3:]})?" for d in WEEKDAYS) + ")"
_HM = r"(?<h{n}>\d{{1,2}})[:.](?<mi{n}>\d{{2}})(?:[:.](?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d{{1,9}}))?)?"
_AMPM = r"(?:\s*(?<ap{n}>[ap])\.?m\b\.?)?"
_ZONE = r"(?:\s*(?:(?<o{n}>[+-]\d{{2}}:?(?:\d{{2}})?)|\(?(?<z{n}>[a-z]{{1,4}})\)?))?"
_CLOCK = _HM + _AMPM + _ZONE

#: One entry per notation; ``{n}`` numbers its groups.
NOTATIONS = (
    # 2024-03-05T10:11:12.5+02:00 and 2024/03/05 10:11
    r"(?<y{n}>\d{{4}})[-/](?<mo{n}>\d{{1,2}})[-/](?<d{n}>\d{{1,2}})(?:t|,?\s+)" + _CLOCK,
    # 20240305T101112Z and 20240305 1011
    r"(?<y{n}>\d{{4}})(?<mo{n}>\d{{2}})(?<d{n}>\d{{2}})(?:t|\s+)(?<h{n}>\d{{2}}):?(?<mi{n}>\d{{2}})(?::?(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d{{1,9}}))?)?" + _ZONE,
    # 2024-148 00:13, day of the year
    r"(?<y{n}>\d{{4}})-(?<j{n}>\d{{3}})(?:t|\s+)" + _CLOCK,
    # 5 March 2024, 10:11 UTC; Tue, 5 Mar 2024 10:11:12 +0200; 1st October 2024, 15:07
    r"(?:(?<w{n}>" + _WEEKDAY + r"),?\s+)?(?<d{n}>\d{{1,2}})(?:st|nd|rd|th)?\s+(?<mn{n}>" + _MONTH + r")\.?,?\s+(?<y{n}>\d{{4}})(?:,\s*|\s+(?:at\s+)?)" + _CLOCK,
    # March 25, 2024 at 5.23pm
    r"(?:(?<w{n}>" + _WEEKDAY + r"),?\s+)?(?<mn{n}>" + _MONTH + r")\.?\s+(?<d{n}>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?<y{n}>\d{{4}})(?:,\s*|\s+(?:at\s+)?)" + _CLOCK,
    # 05/03/2024 10:11, 5.3.24 10.11, order of the office
    r"(?<a{n}>\d{{1,2}})(?<sep{n}>[-/.])(?<b{n}>\d{{1,2}})\k<sep{n}>(?<y{n}>\d{{4}}|\d{{2}}),?\s+(?:at\s+)?" + _CLOCK,
    # 1103 hours, on the reference date
    r"(?<h{n}>\d{{2}})(?<mi{n}>\d{{2}})\s*(?:hours|hrs|h)(?:\s*\(?(?<z{n}>[a-z]{{1,4}})\)?)?",
    # 10:11, yesterday at 10:11
    r"(?:(?<dw{n}>today|yesterday|tomorrow),?\s+(?:at\s+)?)?" + _CLOCK,
    # Unix time in seconds or milliseconds
    r"(?<u{n}>\d{{13}}|\d{{10}})",
)

_PARTS = ("y", "mo", "d", "j", "w", "mn", "a", "b", "dw", "h", "mi", "s", "f", "ap", "o", "z", "u")


def _compiled() -> tuple[str, str]:
    """The alternation, and the replacement that lists its components."""
    numbered = [notation.format(n=n) for n, notation in enumerate(NOTATIONS)]
    # No part of a notation begins with a blank, so blanks are never given back and entries of any length are read in one pass.
    pattern = re.sub(r"\\s([*+])", r"\\s\1+", r"(?iU)^\s*(?:" + "|".join(numbered) + r")\s*\z")
    groups = ["".join(f"${{{p}{n}}}" for n, text in enumerate(numbered) if f"(?<{p}{n}>" in text) for p in _PARTS]
    return pattern, "\u0001" + "\u0002".join(groups) + "\u0001"


PATTERN, REPLACEMENT = _compiled()


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Day number since 1970-01-01 of a proleptic Gregorian date, in integers only."""
    years = y - F.when(m <= 2, F.lit(1)).otherwise(F.lit(0))
    era = F.floor(years / 400)
    of_era = years - era * 400
    of_year = F.floor((153 * (m + F.when(m > 2, F.lit(-3)).otherwise(F.lit(9))) + 2) / 5) + d - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468).cast("long")


def _leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _month_length(y: Column, m: Column) -> Column:
    return F.when(m == 2, F.when(_leap(y), F.lit(29)).otherwise(F.lit(28))).when(m.isin(4, 6, 9, 11), F.lit(30)).otherwise(F.lit(31))


def _offset(local_or_utc_us: Column, zone: Column) -> Column:
    """Microseconds east of UTC of ``zone`` at a UTC instant."""
    shifted = F.from_utc_timestamp(F.timestamp_micros(local_or_utc_us), zone)
    return F.unix_micros(shifted) - local_or_utc_us


def _letters() -> Column:
    """Map of ``country:letters`` to minutes east of UTC, as one literal."""
    flat = [x for c, zones in ZONE_LETTERS.items() for k, v in zones.items() for x in (F.lit(f"{c}:{k}"), F.lit(v))]
    return F.create_map(*flat)


def _country(zone: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ZONE_COUNTRY.items() for x in pair])[zone]


def utc_micros(df: DataFrame, entry: str, reference_date: str, time_zone: str, date_order: str, out: str = "utc_us") -> DataFrame:
    """Add ``out``: microseconds since 1970 (UTC) of the instant that ``entry`` fixes, else null.

    Entries of any length are read. Null entries, unknown notations, impossible dates or times, a wrong weekday,
    zone letters that the office's country does not use, and local times that
    occur twice or never give null. A null ``reference_date``, ``time_zone`` or
    ``date_order`` only matters to entries that need it.
    """
    own = set(df.columns)
    text = F.regexp_replace(F.col(entry), PATTERN, REPLACEMENT)
    df = df.withColumn("_c", F.when(text.startswith("\u0001") & ~F.col(entry).startswith("\u0001"), F.split(F.substring_index(F.substr(text, F.lit(2)), "\u0001", 1), "\u0002", -1)))
    part = {p: F.nullif(F.lower(F.col("_c")[i]), F.lit("")) for i, p in enumerate(_PARTS)}
    num = {p: F.expr("null").cast("int") if p is None else part[p].cast("int") for p in ("y", "mo", "d", "j", "a", "b", "h", "mi", "s")}
    reference = F.datediff(F.col(reference_date), F.lit("1970-01-01").cast("date")).cast("long")

    year = F.when(F.length(part["y"]) == 2, num["y"] + 2000).otherwise(num["y"])
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m[:3], i + 1)])
    dmy = F.col(date_order) == "DMY"
    mdy = F.col(date_order) == "MDY"
    month = F.coalesce(num["mo"], names[F.substring(part["mn"], 1, 3)], F.when(dmy, num["b"]).when(mdy, num["a"]))
    day = F.coalesce(num["d"], F.when(dmy, num["a"]).when(mdy, num["b"]))
    df = df.withColumns({"_y": year, "_mo": month, "_d": day})
    y, m, d = F.col("_y"), F.col("_mo"), F.col("_d")

    by_date = F.when(m.between(1, 12) & (d >= 1) & (d <= _month_length(y, m)) & (y >= 1), days_from_civil(y, m, d))
    of_year = F.when((num["j"] >= 1) & (num["j"] <= F.when(_leap(y), F.lit(366)).otherwise(F.lit(365))), days_from_civil(y, F.lit(1), F.lit(1)) + num["j"] - 1)
    words = F.create_map(*[F.lit(x) for pair in DAY_WORDS.items() for x in pair])
    dayless = reference + F.coalesce(words[part["dw"]], F.lit(0))
    weekdays = F.create_map(*[F.lit(x) for i, w in enumerate(WEEKDAYS) for x in (w[:3], i)])
    days = F.when(part["j"].isNotNull(), of_year).when(part["y"].isNotNull(), by_date).otherwise(dayless)
    df = df.withColumn("_days", days)
    days = F.col("_days")
    days = F.when(part["w"].isNull() | (F.pmod(days + 3, F.lit(7)) == weekdays[F.substring(part["w"], 1, 3)]), days)

    hour = (
        F.when(part["ap"].isNull(), F.when(num["h"] <= 23, num["h"]))
        .when(num["h"].between(1, 12), num["h"] % 12 + F.when(part["ap"] == "p", F.lit(12)).otherwise(F.lit(0)))
    )
    second = F.coalesce(num["s"], F.lit(0))
    seconds = F.when((num["mi"] <= 59) & (second <= 59), hour * 3600 + num["mi"] * 60 + second).cast("long")
    fraction = F.coalesce(F.rpad(F.substring(part["f"], 1, 6), 6, "0").cast("long"), F.lit(0).cast("long"))
    local = (days * 86400 + seconds) * 1_000_000 + fraction

    sign = F.when(part["o"].startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    digits = F.regexp_replace(part["o"], r"[^0-9]", "")
    off_h, off_m = F.substring(digits, 1, 2).cast("int"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).cast("int"), F.lit(0))
    numeric = F.when((off_h <= 14) & (off_m <= 59), sign * (off_h * 60 + off_m))
    letters = F.coalesce(_letters()[F.concat(F.lit(":"), part["z"])], _letters()[F.concat(_country(F.col(time_zone)), F.lit(":"), part["z"])])
    stated = F.when(part["o"].isNotNull(), numeric).otherwise(letters).cast("long") * 60_000_000

    unix = F.when(F.length(part["u"]) == 10, part["u"].cast("long") * 1_000_000).when(F.length(part["u"]) == 13, part["u"].cast("long") * 1000)
    df = df.withColumns({"_unix": unix, "_local": local, "_stated": stated, "_zoned": part["o"].isNotNull() | part["z"].isNotNull()})
    # Both sides of any change of the clock: a local time is real where exactly one offset gives it back.
    local, zone = F.col("_local"), F.col(time_zone)
    needs = F.col("_unix").isNull() & ~F.col("_zoned")
    df = df.withColumns({"_before": F.when(needs, local - _offset(local - 86_400_000_000, zone)), "_after": F.when(needs, local - _offset(local + 86_400_000_000, zone))})
    before, after = F.col("_before"), F.col("_after")
    real = lambda at: at + _offset(at, zone) == local
    placed = (
        F.when(before == after, before)
        .when(real(before) & real(after), F.lit(None))
        .when(real(before), before)
        .when(real(after), after)
    )
    value = F.when(F.col("_unix").isNotNull(), F.col("_unix")).when(F.col("_zoned"), local - F.col("_stated")).otherwise(placed)
    return df.withColumn(out, value).drop(*[c for c in ("_c", "_y", "_mo", "_d", "_days", "_unix", "_local", "_stated", "_zoned", "_before", "_after") if c not in own])


def iso_millis(us: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSZ`` of UTC microseconds, finer parts cut off; independent of the session's zone."""
    day = F.floor(us / 86_400_000_000)
    rest = us - day * 86_400_000_000
    pad = lambda c, n: F.lpad(F.floor(c).cast("string"), n, "0")
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string")
    return F.concat(date, F.lit("T"), pad(rest / 3_600_000_000, 2), F.lit(":"), pad(rest / 60_000_000 % 60, 2), F.lit(":"), pad(rest / 1_000_000 % 60, 2), F.lit("."), pad(rest / 1000 % 1000, 3), F.lit("Z"))


def normalize_timestamps(blocks: DataFrame, offices: DataFrame) -> DataFrame:
    """One row ``document_id, block_id, pos, utc`` per entry of ``raw_timestamps`` that fixes one instant.

    Null and empty arrays and null entries give no row, blocks of an unknown
    office only rows for entries with their own zone; rows delivered twice give
    one. Extra columns of either table are ignored. ``offices`` is the fixed
    table of offices; Spark broadcasts it by its size.
    """
    zones = offices.select("office_code", "time_zone", "date_order").dropDuplicates(["office_code"])
    entries = (
        blocks.where(F.size("raw_timestamps") > 0)
        .select("document_id", "block_id", "office_code", "reference_date", F.posexplode("raw_timestamps").alias("pos", "entry"))
        .where(F.col("entry").isNotNull())
        .join(zones, "office_code", "left")
    )
    found = utc_micros(entries, "entry", "reference_date", "time_zone", "date_order")
    # A filter on utc_us itself would be pushed through every projection above and written out in full, over and over; the generator stops that.
    return (
        found.select("document_id", "block_id", "pos", F.explode(F.array("utc_us")).alias("utc_us"))
        .where(F.col("utc_us").isNotNull())
        .select("document_id", "block_id", F.col("pos").cast("int").alias("pos"), iso_millis(F.col("utc_us")).alias("utc"))
        .distinct()
    )
