"""Times: the session zone is UTC; local days are those of the survey."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Kolkata"


def iso(ts: Column) -> Column:
    """UTC with milliseconds and Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse(raw: Column) -> Column:
    """ISO text, without a zone as UTC, null if unreadable."""
    return F.try_to_timestamp(F.regexp_replace(raw, "Z$", "+00:00"))


def day_end(ts: Column) -> Column:
    """Midnight after the day (D3)."""
    return F.date_add(F.to_date(ts), 1)


def local_day(ts: Column, zone: str = ZONE) -> Column:
    """Day of an instant in the survey's zone."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def season(ts: Column) -> Column:
    """Season by month."""
    m = F.month(ts)
    return F.when(m.between(6, 9), "monsoon").when(m.between(3, 5), "pre-monsoon").when(m.isin(10, 11), "post-monsoon").otherwise("winter")


def within(ts: Column, as_of: Column, hours: float) -> Column:
    """Whether an instant lies in the hours before as_of, which is passed in, never now()."""
    return (ts < as_of) & (ts >= as_of - F.make_dt_interval(hours=F.lit(int(hours))))
