"""Date resolution functions (F18, F19). Everything is UTC; timestamps are TIMESTAMP_NTZ."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date resolutions a date criterion may use.
RESOLUTIONS = ("year", "month", "day", "hour", "minute", "second", "millisecond")


def _unit(resolution: str) -> str:
    r = (resolution or "millisecond").lower()
    if r in ("ms", "milli", "millis"):
        r = "millisecond"
    if r not in RESOLUTIONS:
        raise ValueError(f"unknown date resolution {resolution!r}")
    return r


def date_truncate(col: Column | str, resolution: str) -> Column:
    """cut a timestamp column to the resolution (UTC)."""
    c = col if isinstance(col, Column) else F.col(col)
    return F.date_trunc(_unit(resolution), c).cast("timestamp_ntz")


def date_upper_bound(col: Column | str, resolution: str) -> Column:
    """truncated date plus one unit; milliseconds -> the same instant."""
    unit = _unit(resolution)
    t = date_truncate(col, unit)
    if unit == "millisecond":
        return t
    return t + F.expr(f"INTERVAL 1 {unit.upper()}")


def truncate_py(ts: _dt.datetime | _dt.date, resolution: str) -> _dt.datetime:
    """F18 for a query parameter (a single literal)."""
    unit = _unit(resolution)
    if not isinstance(ts, _dt.datetime):
        ts = _dt.datetime(ts.year, ts.month, ts.day)
    if ts.tzinfo is not None:
        ts = ts.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    if unit == "year":
        return ts.replace(month=1, day=1, hour=0, minute=0, second=0, microsecond=0)
    if unit == "month":
        return ts.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    if unit == "day":
        return ts.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "hour":
        return ts.replace(minute=0, second=0, microsecond=0)
    if unit == "minute":
        return ts.replace(second=0, microsecond=0)
    if unit == "second":
        return ts.replace(microsecond=0)
    return ts.replace(microsecond=ts.microsecond // 1000 * 1000)


def upper_bound_py(ts: _dt.datetime | _dt.date, resolution: str) -> _dt.datetime:
    """F19 for a query parameter."""
    unit = _unit(resolution)
    t = truncate_py(ts, unit)
    if unit == "year":
        return t.replace(year=t.year + 1)
    if unit == "month":
        return t.replace(year=t.year + (t.month == 12), month=t.month % 12 + 1)
    step = {"day": _dt.timedelta(days=1), "hour": _dt.timedelta(hours=1),
            "minute": _dt.timedelta(minutes=1), "second": _dt.timedelta(seconds=1)}
    return t + step.get(unit, _dt.timedelta(0))


def ts_literal(ts: _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal."""
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
