"""Time labels and spans of epoch seconds; none depends on the session's time zone."""

from __future__ import annotations

import datetime as dt
import math
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("daily", "weekly", "monthly", "total")


def local_time(seconds: Column, tz: str = "UTC") -> Column:
    """The wall-clock time of epoch seconds in tz, as a timestamp without zone; null seconds count as 0."""
    micros = F.floor(F.coalesce(seconds, F.lit(0.0)) * 1_000_000).cast("long")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1_000_000).cast("decimal(18,6)"))
    return utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def bucket_label(seconds: Column, granularity: str, tz: str = "UTC") -> Column:
    """Label of the day, ISO week or month of epoch seconds, or 'total'."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {', '.join(GRANULARITIES)}")
    if granularity == "total":
        return F.lit("total")
    day = local_time(seconds, tz).cast("date")
    if granularity == "weekly":
        return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return day.cast("string") if granularity == "daily" else F.substring(day.cast("string"), 1, 7)


def utc_day(seconds: Column) -> Column:
    return local_time(seconds).cast("date").cast("string")


def parse_when(text: str, end_of_day: bool = False, tz: str = "UTC", now: dt.datetime | None = None) -> float:
    """Epoch seconds of 'today', 'yesterday', '<n>d' (days ago) or a date, at the start of that day in tz, or its end; or of
    an ISO date with a time (in tz, if it names no offset), in whole seconds."""
    zone = ZoneInfo(tz)
    today = (now or dt.datetime.now(zone)).astimezone(zone).date()
    text = text.strip().lower()
    if text in ("today", "yesterday"):
        day = today - dt.timedelta(days=text == "yesterday")
    elif m := re.fullmatch(r"(\d+)d", text):
        day = today - dt.timedelta(days=int(m[1]))
    elif re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        day = dt.date.fromisoformat(text)
    else:
        try:
            moment = dt.datetime.fromisoformat(text.upper())
        except ValueError:
            raise ValueError(f"not a date: {text}") from None
        return math.floor((moment if moment.tzinfo else moment.replace(tzinfo=zone)).timestamp())
    return dt.datetime.combine(day, dt.time(), zone).timestamp() + (86399 if end_of_day else 0)


def iso_time(seconds: Column) -> Column:
    """ISO 8601 of epoch seconds, or of milliseconds from 1e12 on; null where not positive."""
    s = F.when(seconds < 1e12, seconds).otherwise(seconds / 1000)
    return F.when(seconds > 0, F.concat(F.date_format(local_time(F.round(s, 3)), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")))


def elapsed_ms(start: Column, stop: Column) -> Column:
    """Whole milliseconds from start to stop (epoch seconds); null unless start is positive and stop not before it."""
    return F.when((start > 0) & (stop >= start), F.floor((stop - start) * 1000 + 0.5).cast("long"))

