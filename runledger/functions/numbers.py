"""Numeric expressions of the chart output."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_even(value: Column, digits: int) -> Column:
    """Round half to even in binary floating point, as array libraries do; NaN becomes null."""
    scale = F.lit(float(10**digits))
    return F.when(~F.isnan(value), F.rint(value * scale) / scale)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is null where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def no_zero_cell(*columns: Column) -> Column:
    """True where no cell is zero; null cells pass."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & (c.isNull() | (c != 0))
    return keep


def logarithm(value: Column, base: float | None = None) -> Column:
    """Natural or other logarithm as floating point has it: minus infinity at zero, NaN below."""
    log = F.ln(value) if base is None else F.log2(value) if base == 2 else F.ln(value) / F.ln(F.lit(float(base)))
    return F.when(value == 0, F.lit(float("-inf"))).when(value < 0, F.lit(float("nan"))).otherwise(log)
