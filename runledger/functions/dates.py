"""Date expressions. Timestamps are UTC wall-clock times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970, without going through the session time zone."""
    return F.timestamp_diff("SECOND", F.expr(EPOCH), ts)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.expr(EPOCH))


def epoch_in(ts: Column, unit_seconds: int) -> Column:
    """Time since 1970 in units of the given number of seconds, as a fraction."""
    return epoch_seconds(ts) / F.lit(float(unit_seconds))


def long_format(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd-HH:mm:ss")


def short_format(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd")


def parse_stamp(text: Column) -> Column:
    """Epoch seconds of a ``month/day/year`` profiler stamp; null when it does not parse."""
    return epoch_seconds(F.try_to_timestamp(text, F.lit("MM/dd/yy HH:mm:ss")).cast("timestamp_ntz"))


def file_stamp(ts: Column) -> Column:
    """Stamp that is safe in file names."""
    return F.date_format(ts, "yyyy_MM_dd-HH_mm_ss")


def human_interval(start: Column, end: Column) -> Column:
    """Whole days, else whole hours, else whole minutes; plural only above one."""
    seconds = F.timestamp_diff("SECOND", start, end)
    text = None
    for unit, size in (("day", 86400), ("hour", 3600), ("minute", 60)):
        n = F.floor(seconds / F.lit(size))
        label = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""))
        if unit == "minute":
            return text.otherwise(label)
        text = F.when(n != 0, label) if text is None else text.when(n != 0, label)


def quarter_day(ts: Column) -> Column:
    """Day with its quarter, such as ``2024-01-31-q1(00-05)h``."""
    quarter = F.floor(F.hour(ts) / F.lit(6))
    return F.format_string(
        "%s-q%d(%02d-%02d)h", F.date_format(ts, "yyyy-MM-dd"), quarter + 1, quarter * 6, quarter * 6 + 5
    )
