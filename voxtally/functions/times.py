"""Epochs, years and ages."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

MAX_EPOCH_S = 2147483647
_PER_SECOND = {"s": 1, "ms": 1000}


def valid_epoch(c: Column, unit: str = "s") -> Column:
    """True for epochs from 0 to the largest 32-bit second, both ends included."""
    scale = _PER_SECOND[unit]
    return c.between(0, MAX_EPOCH_S * scale + scale - 1)


def epoch_to_ts(c: Column, unit: str = "s") -> Column:
    return F.timestamp_seconds(c) if unit == "s" else F.timestamp_millis(c)


def in_year(ts: Column, year: int) -> Column:
    """Half-open range on the bare column, so that Parquet row groups are pruned."""
    start, end = (F.lit(f"{y:04d}-01-01").cast("timestamp_ntz") for y in (year, year + 1))
    return (ts >= start) & (ts < end)


def epoch_in_year(c: Column, year: int, unit: str = "s") -> Column:
    """The same range on the raw epoch column, so that the source scan is pruned."""
    start, end = (
        int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) * _PER_SECOND[unit]
        for y in (year, year + 1)
    )
    return (c >= start) & (c < end)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def age_micros(ts: Column, as_of: Column | None = None) -> Column:
    """Age of ``ts`` at ``as_of`` (now by default); a missing ``ts`` counts as now."""
    now = F.current_timestamp() if as_of is None else as_of
    return F.coalesce(epoch_micros(now) - epoch_micros(ts), F.lit(0))
