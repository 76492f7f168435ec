"""Dates, times and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


def date_trunc(unit: str, ts: Column, zone: str | None = None) -> Column:
    """Truncated to a unit (weeks start on Monday), in a zone if one is given; other units raise."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}")
    if zone is None:
        return F.date_trunc(unit, ts)
    return F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(ts, zone)), zone)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def date_bin(width: str, ts: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """The start of the bin that ts is in, for bins of a day-time interval (months and years raise) counted from
    origin to both sides."""
    number, unit = width.split()
    size = int(number) * {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 6 * 10**7, "hour": 36 * 10**8, "day": 864 * 10**8, "week": 6048 * 10**8}[unit.rstrip("s")]
    if size == 0:
        raise ValueError("the interval must not be zero")
    since = micros(ts) - micros(F.lit(origin).cast("timestamp_ntz"))
    return F.timestamp_micros(micros(ts) - F.pmod(since, F.lit(abs(size)))).cast("timestamp_ntz")


def extract(field: str, ts: Column) -> Column:
    """A field as an integer (epoch: double, seconds)."""
    f = field.lower()
    if f == "century":
        return F.ceil(F.year(ts) / 100).cast("int")
    if f in ("day_of_week", "dow"):
        return F.weekday(ts) + 1
    if f in ("day_of_year", "doy"):
        return F.dayofyear(ts)
    if f == "epoch":
        return micros(ts) / 1e6
    if f == "day_of_month":
        f = "day"
    return {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}[f](ts)


#: MySQL-style specifiers and Java's.
FORMATS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%h": "hh", "%I": "hh", "%k": "H", "%l": "h", "%i": "mm", "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%T": "HH:mm:ss", "%r": "hh:mm:ss a"}


def date_format(ts: Column, pattern: str = "%Y-%m-%dT%H:%i:%s.%fZ", zone: str | None = None) -> Column:
    """By MySQL-style specifiers."""
    import re

    ts = ts if zone is None else F.from_utc_timestamp(ts, zone)
    out = []
    for t in re.split("(%.)", pattern):
        out.append(FORMATS.get(t) or ("'" + t.replace("'", "''") + "'" if re.search("[A-Za-z']", t) else t.removeprefix("%") if t.startswith("%") else t))
    return F.date_format(ts, "".join(out))


def current_time() -> Column:
    """The time of day, in microseconds since midnight of the session's zone."""
    return micros(F.localtimestamp()) % 86_400_000_000


def timezone(zone: str, ts: Column, has_zone: bool) -> Column:
    """AT TIME ZONE: an instant to local time, or a local time to the instant."""
    return F.from_utc_timestamp(ts, zone) if has_zone else F.to_utc_timestamp(ts, zone)


def age(end: Column, start: Column) -> Column:
    """The calendar difference as struct<years, months, days, micros>, each with the sign of the whole."""
    swap = end < start
    a, b = F.when(swap, end).otherwise(start), F.when(swap, start).otherwise(end)
    months = F.floor(F.months_between(b, a)).cast("int")
    moved = F.add_months(a, months).cast("timestamp_ntz")
    rest = micros(b) - (micros(moved) + F.pmod(micros(a), F.lit(86_400_000_000)))
    sign = F.when(swap, -1).otherwise(1)
    months = F.when(rest < 0, months - 1).otherwise(months)
    moved = F.add_months(a, months).cast("timestamp_ntz")
    rest = micros(b) - (micros(moved) + F.pmod(micros(a), F.lit(86_400_000_000)))
    day = F.lit(86_400_000_000)
    parts = {"years": (months / 12).cast("int"), "months": months % 12, "days": F.floor(rest / day).cast("int"), "micros": rest % day}
    return F.struct(*[(v * sign).alias(k) for k, v in parts.items()])


def interval(months: int = 0, days: int = 0, seconds: float = 0) -> Column:
    """A mixed interval: struct<months, micros>, since Spark keeps its two interval families apart."""
    return F.struct(F.lit(months).alias("months"), F.lit(int(days * 86_400_000_000 + seconds * 1_000_000)).cast("long").alias("micros"))


def plus(ts: Column, by: Column, sign: int = 1) -> Column:
    """ts plus (or minus) a mixed interval: months first, then the exact part."""
    whole = F.add_months(ts, by["months"] * sign).cast("timestamp_ntz")
    clock = F.pmod(micros(ts), F.lit(86_400_000_000))
    return F.timestamp_micros(micros(whole) + clock + by["micros"] * sign).cast("timestamp_ntz")


def times_(by: Column, n: Column | int) -> Column:
    return F.struct((by["months"] * n).alias("months"), (by["micros"] * n).alias("micros"))


def add(a: Column, b: Column) -> Column:
    return F.struct((a["months"] + b["months"]).alias("months"), (a["micros"] + b["micros"]).alias("micros"))
