"""Mixed timestamp texts to one unambiguous instant (problem 5).

All formats stand in one regex alternation with named groups. One ``regexp_replace`` per value pulls every component
out at once, in the JVM; the calendar is checked on integers and the instant is put together by integer day arithmetic.
Only texts without zone meet the zone rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewright.session import epoch_seconds

# English month abbreviations in calendar order and zone names with their offset in minutes.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONES = {"z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180}

_ZONE = r"(?:{names}|[+-]\d{{2}}(?::?\d{{2}})?)".format(names="|".join(sorted(ZONES, key=len, reverse=True)))
_TIME = r"(?<h{i}>\d{{1,2}}):(?<n{i}>\d{{2}})(?::(?<s{i}>\d{{2}})(?:[.,]\d{{1,9}})?)?"
_PAD = r"[\s ﻿]*"


def _formats() -> list[str]:
    zone = lambda i: rf"(?: ?(?<z{i}>{_ZONE}))?"
    clock = lambda i: _TIME.format(i=i)
    return [
        # 2017-02-28T07:04:44.000+01:00 and its looser forms
        r"(?<y1>\d{4})[-/](?<m1>\d{1,2})[-/](?<d1>\d{1,2})(?:T| +)" + clock(1) + zone(1),
        # 20170301T123252+0100
        r"(?<y2>\d{4})(?<m2>\d{2})(?<d2>\d{2})T(?<h2>\d{2})(?<n2>\d{2})(?:(?<s2>\d{2})(?:[.,]\d{1,9})?)?" + zone(2),
        # 02/28/2017 1:22:12 PM: month first
        r"(?<m3>\d{1,2})[./-](?<d3>\d{1,2})[./-](?<y3>\d{4}),? +" + clock(3) + r" ?(?<a3>[ap])\.?m\.?" + zone(3),
        # 28.02.2017 06:44:52: day first
        r"(?<d4>\d{1,2})[./](?<m4>\d{1,2})[./](?<y4>\d{4})(?:T|,? +)" + clock(4) + zone(4),
        # 26-Mar-2017 05:24:32 CEST
        r"(?<d5>\d{1,2})[- ](?<b5>[a-z]{3})[a-z]*\.?[- ](?<y5>\d{4}),? +" + clock(5) + zone(5),
        # seconds, milliseconds since 1970
        r"(?<e6>\d{9,11})(?:\.\d+)?",
        r"(?<k7>\d{12,14})(?:\.\d+)?",
    ]


PATTERN = rf"(?is)^{_PAD}(?:" + "|".join(f"(?:{x})" for x in _formats()) + rf"){_PAD}$"
_MARK = "\u0001"
#: The components in the order in which the replacement writes them.
_PARTS = {
    "y": ["y1", "y2", "y3", "y4", "y5"], "mo": ["m1", "m2", "m3", "m4"], "d": ["d1", "d2", "d3", "d4", "d5"],
    "h": ["h1", "h2", "h3", "h4", "h5"], "mi": ["n1", "n2", "n3", "n4", "n5"], "s": ["s1", "s2", "s3", "s4", "s5"],
    "zone": ["z1", "z2", "z3", "z4", "z5"], "ampm": ["a3"], "month": ["b5"], "e": ["e6"], "k": ["k7"],
}
_REPLACEMENT = _MARK + "|".join("".join(f"${{{g}}}" for g in gs) for gs in _PARTS.values())


def days_from_civil(y: str, m: str, d: str) -> str:
    """SQL for the days since 1970-01-01 of a Gregorian date (years from 1), in integers only."""
    yy = f"({y} - CASE WHEN {m} <= 2 THEN 1 ELSE 0 END)"
    mm = f"({m} + CASE WHEN {m} > 2 THEN -3 ELSE 9 END)"
    return f"({yy} * 365 + {yy} div 4 - {yy} div 100 + {yy} div 400 + (153 * {mm} + 2) div 5 + {d} - 1 - 719468)"


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once. A one-row generator holds them, because filters pushed through a
    projection would copy its expressions at each use and outgrow the generated code."""
    made = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def _wall(u: Column, zone: str) -> Column:
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(u), zone))


def local_to_utc(df: DataFrame, local_s: str, zone: str, not_after: Column, p: str) -> tuple[DataFrame, Column]:
    """Seconds of UTC of a zone's wall clock. In a repeated hour: the later instant that is not after ``not_after``,
    the earlier one where that is null or before both. A wall-clock time that a clock change skips is null."""
    local = F.col(local_s)
    first, second = F.col(p + "first"), F.col(p + "second")
    df = bind(df, **{p + "first": F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone))})
    df = bind(df, **{p + "second": local - (_wall(first + 86400, zone) - first - 86400), p + "exists": _wall(first, zone) == local})
    later = (second > first) & (second <= not_after) & (_wall(second, zone) == local)
    return df, F.when(F.col(p + "exists"), F.when(later, second).otherwise(first))


def with_instant(df: DataFrame, text: str, out: str = "utc_s", zone: str = "Europe/Paris", received: str | None = None) -> DataFrame:
    """``df`` with the whole seconds since 1970 UTC that the text column tells.

    Null, blank, unreadable or impossible texts (month 13, 30 February, 25 o'clock, a skipped hour) give null. Texts
    without zone are wall-clock times of ``zone``; ``received`` (a timestamp column) settles the repeated autumn hour.
    Dates with slashes or dots are day first, with AM/PM month first; bare numbers of 9 to 11 digits are seconds, of 12
    to 14 milliseconds. Every row comes back once, with its own columns; a column named ``out`` is replaced.
    """
    limit = F.lit(None).cast("bigint") if received is None else epoch_seconds(df, received)
    p = "__gw_ts_"
    raw = F.regexp_replace(F.col(text).cast("string"), F.lit(PATTERN), F.lit(_REPLACEMENT))
    parts = df.withColumn(p + "p", F.split(F.when(raw.startswith(_MARK), F.substring(raw, 2, 200)), r"\|"))
    at = {k: F.col(p + "p")[i] for i, k in enumerate(_PARTS)}
    num = lambda k: at[k].try_cast("bigint")
    zone_text = F.lower(at["zone"])
    month = F.coalesce(num("mo"), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(at["month"])), F.lit(0)).cast("bigint"))
    named = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    digits = F.regexp_replace(zone_text, "[^0-9]", "")
    signed = F.when(zone_text.startswith("-"), -1).otherwise(1) * (
        F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    )
    hour = F.when(at["ampm"] == "", num("h")).when(
        num("h").between(1, 12), num("h") % 12 + F.when(F.lower(at["ampm"]) == "p", 12).otherwise(0)
    )
    fields = bind(
        parts,
        **{
            p + "y": num("y"), p + "m": month, p + "d": num("d"), p + "h": hour, p + "n": num("mi"), p + "s": F.coalesce(num("s"), F.lit(0).cast("bigint")),
            p + "z": F.when(zone_text != "", F.coalesce(named[zone_text], signed)), p + "local": zone_text == "",
            p + "e": F.coalesce(num("e"), F.floor(num("k") / 1000)), p + "limit": limit,
        },
    )
    y, m, d = p + "y", p + "m", p + "d"
    month_days = f"CASE WHEN {m} IN (4, 6, 9, 11) THEN 30 WHEN {m} <> 2 THEN 31 WHEN {y} % 4 = 0 AND ({y} % 100 <> 0 OR {y} % 400 = 0) THEN 29 ELSE 28 END"
    valid = F.expr(f"{y} >= 1 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND {month_days} AND {p}h <= 23 AND {p}n <= 59 AND {p}s <= 59 AND ({p}local OR abs({p}z) <= 18 * 60)")
    w = p + "w"
    wall = bind(fields, **{w: F.when(valid, F.expr(f"{days_from_civil(y, m, d)} * 86400 + {p}h * 3600 + {p}n * 60 + {p}s"))})
    local = F.col(p + "local")
    placed, here = local_to_utc(wall.withColumn(w + "l", F.when(local, F.col(w))), w + "l", zone, F.col(p + "limit"), p)
    instant = F.coalesce(F.col(p + "e"), F.when(local, here).otherwise(F.col(w) - F.col(p + "z") * 60))
    return placed.select(*[c for c in df.columns if c != out], instant.cast("bigint").alias(out))
