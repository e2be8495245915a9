"""Predicates, masks, bins and calibrations on telemetry columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.functions.columns import right_closed_bin  # noqa: F401  beside the other bins

from . import segments

#: Calibration of raw pressure counts to bar, and wheel radius for speed from rpm (fixed values of the format).
PRESSURE_GAIN, PRESSURE_OFFSET = 3.6 / 3.3 * 0.000788, 2.3057
WHEEL_RADIUS = 0.46
#: A temperature constant that a faulty board repeats.
STUCK_VALUE, STUCK_TOLERANCE = 53.4641, 1e-4


def load_bin(load: Column, low: float = 2.0, high: float = 3.0) -> Column:
    """0 below ``low``, 2 above ``high``, 1 between (both ends inclusive); null stays null."""
    return F.when(load.isNull(), None).when(load < low, 0).when(load > high, 2).otherwise(1)


def in_scope(non_standard: Column, bad_start: Column, load: Column) -> Column:
    """The regime in which rates are compared; anything unknown is out of it."""
    return F.coalesce((non_standard == 0) & (bad_start == 0) & (load_bin(load) == 1), F.lit(False))


def calibrated_pressure(raw: Column) -> Column:
    return raw * PRESSURE_GAIN - PRESSURE_OFFSET


def speed_from_rpm(rpm: Column) -> Column:
    """km/h from wheel revolutions a minute."""
    return rpm / 60 * 2 * F.pi() * WHEEL_RADIUS * 3.6


def valid_fix(lat: Column, lon: Column) -> Column:
    """Both known and not at null island."""
    return F.coalesce(~((F.abs(lat) < 0.5) & (F.abs(lon) < 0.5)), F.lit(False))


def in_bounds(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6))


def without_stuck(x: Column, value: float = STUCK_VALUE, tolerance: float = STUCK_TOLERANCE) -> Column:
    return F.when(F.abs(x - value) < tolerance, None).otherwise(x)


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def safe_ratio(a: Column, b: Column) -> Column:
    """Null where a part is missing or the denominator is 0."""
    return F.try_divide(a, b)


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The whitelisted columns (name -> type) in order; missing ones are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the wanted columns that the table has, in the wanted order."""
    return df.select(*[c for c in columns if c in df.columns])


def binary_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose non-null values are 0 and 1 only, found in one pass."""
    sums = df.agg(*[F.sum((~F.col(c).isin(0, 1)).cast("int")).alias(c) for c in columns]).first()
    return [c for c in columns if not sums[c]]


def decimate(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """Every ``k``-th row of a series, the first included."""
    return segments.numbered(df, [key], order).where(F.col("i") % k == 0).drop("i", "n")


def without_labels(df: DataFrame, labels: list[str]) -> DataFrame:
    """Without columns that would tell a model the answer."""
    return df.drop(*[c for c in df.columns if c in labels])


def no_flag(flags: list[Column]) -> Column:
    """Whether no flag is up; an unknown flag is not up."""
    up = F.lit(False)
    for f in flags:
        up = up | F.coalesce(f, F.lit(False))
    return ~up


def named_like(df: DataFrame, parts: list[str]) -> list[str]:
    """Columns whose names hold one of the parts, in the table's order."""
    return [c for c in df.columns if any(p.lower() in c.lower() for p in parts)]


def truthy(x: Column, words: list[str]) -> Column:
    """Whether a text is one of the words for yes; null is no."""
    return F.coalesce(F.lower(F.trim(x)).isin(*words, "true", "1", "yes"), F.lit(False))


def role_rank(role: Column, order: list[str]) -> Column:
    """Place of a role in the given order; others come last."""
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(role == name, i).otherwise(out)
    return out
