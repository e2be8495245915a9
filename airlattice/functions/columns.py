"""Time, place and binning as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(time: str) -> Column:
    """Seconds since the epoch, with micros, of a timestamp of either kind."""
    return F.unix_micros(F.col(time).cast("timestamp")) / 1e6


def clock(time: str) -> Column:
    """Minutes since midnight."""
    return F.hour(time) * 60 + F.minute(time)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in km."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def right_closed_bin(x: Column, edges: list[float]) -> Column:
    """Number of edges that lie strictly below x: bins (-inf, e0], (e0, e1], ..."""
    out = F.lit(0)
    for e in edges:
        out = out + (x > e).cast("int")
    return out


def violations(columns: list[str], highs: dict[str, Column]) -> Column:
    """How many of the columns lie above their bound; null and an unknown bound count as none."""
    out = F.lit(0)
    for c in columns:
        out = out + F.coalesce((F.col(c) > highs[c]).cast("int"), F.lit(0))
    return out
