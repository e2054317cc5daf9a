"""Time of day as integer seconds since midnight (0 to 86399)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECONDS_PER_DAY = 86400

# The six parts of the day in display order, as (name, first hour, last hour).
# Night wraps around midnight.
TIME_BANDS = [
    ("EarlyMorning", 3, 6),
    ("Morning", 7, 10),
    ("Midday", 11, 14),
    ("Afternoon", 15, 18),
    ("Evening", 19, 21),
    ("Night", 22, 2),
]
BAND_NAMES = [name for name, _, _ in TIME_BANDS]


def seconds_of_text(text: Column) -> Column:
    """'HH:MM[:SS]' to seconds; anything else gives null."""
    trimmed = F.trim(text.cast("string"))
    parts = F.split(trimmed, ":")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit("0")).try_cast("double").cast("int")
    looks_right = trimmed.rlike(r"^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?$")
    return F.when(looks_right, part(0) * 3600 + part(1) * 60 + part(2))


def seconds_of_timestamp(ts: Column) -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int")


def at(clock: str) -> int:
    """Seconds of a clock literal such as '05:30:00'."""
    h, m, s = (int(x) for x in clock.split(":"))
    return h * 3600 + m * 60 + s


def hour_of(secs: Column) -> Column:
    return F.floor(secs / 3600).cast("int")


def minute_of(secs: Column) -> Column:
    return (F.floor(secs / 60) % 60).cast("int")


def second_of(secs: Column) -> Column:
    return (secs % 60).cast("int")


def clock_text(secs: Column) -> Column:
    """Seconds to 'HH:MM:SS'; what would round to the next day is the day's last second."""
    whole = F.rint(secs).cast("int")
    whole = F.when((secs < 86400) & (whole == 86400), F.lit(86399)).otherwise(whole)
    text = F.format_string("%02d:%02d:%02d", hour_of(whole), minute_of(whole), second_of(whole))
    return F.when(secs.isNotNull(), text)


def round_to_step(secs: Column, step: int = 2) -> Column:
    """Nearest multiple of ``step``, halves to the even multiple."""
    return (F.rint(secs / step) * step).cast("int")


def _band_of(hour: int) -> str:
    for name, first, last in TIME_BANDS:
        if first <= hour <= last or (first > last and (hour >= first or hour <= last)):
            return name
    raise ValueError(hour)


def time_band(hour: Column) -> Column:
    """Part of the day an hour falls in."""
    return F.get(F.array(*[F.lit(_band_of(h)) for h in range(24)]), hour)


def band_ordinal(name: Column) -> Column:
    """Display position of a band name, 1 for the earliest."""
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in BAND_NAMES]), name), F.lit(0)).cast("int")


def format_clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def parse_minute_stamp(text: Column) -> Column:
    """'yyyy/MM/dd HH:mm' to a timestamp without zone; null when it does not parse."""
    return F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm")).cast("timestamp_ntz")


def whole_minutes(ms: Column) -> Column:
    """Milliseconds to whole minutes, truncated on each row."""
    seconds = F.call_function("div", ms.cast("bigint"), F.lit(1000))
    return F.call_function("div", seconds, F.lit(60))


def minutes(ms: Column) -> Column:
    """Milliseconds to fractional minutes."""
    return ms / 1000 / 60
