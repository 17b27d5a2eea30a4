"""Decimal rounding of the exact binary value, ties to even, as Python's round() does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_exact(x: Column, digits: int) -> Column:
    """Round half-even on the exact binary value (F.round rounds the printed decimal).

    ``x * 10**digits`` can land on a tie only through its own rounding error, so that
    error is recovered exactly (Dekker product) and decides the tie. ``x`` is used several
    times: give a stored column, not a long expression.
    """
    scale = float(10**digits)
    scaled = x * F.lit(scale)
    whole = F.rint(scaled)
    off = scaled - whole
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    error = (high * F.lit(scale) - scaled) + (x - high) * F.lit(scale)
    step = F.when((off == 0.5) & (error > 0), F.lit(1.0)).when((off == -0.5) & (error < 0), F.lit(-1.0)).otherwise(F.lit(0.0))
    return (whole + step) / F.lit(scale)


def with_rounded(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Replace columns by their rounded values, digits per column name."""
    return df.withColumns({c: round_exact(F.col(c), digits) for c, digits in columns.items()})
