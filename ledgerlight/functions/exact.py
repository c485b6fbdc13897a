"""Exact amounts: integers of one millionth of a unit as DECIMAL(38,0), never floats, never ``div``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


def amount(c: Column) -> Column:
    """A decimal number of units as micro units."""
    return (c.cast("decimal(28,6)") * MICRO).cast("decimal(38,0)")


def whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def tolerance(actual_unit: Column, expected_unit: Column, terms: Column | int = 1) -> Column:
    """The coarser display unit, once for each rounded term."""
    n = F.greatest(F.lit(1), F.lit(terms) if isinstance(terms, int) else terms)
    return whole(F.greatest(whole(actual_unit), whole(expected_unit)) * n)


def compared(actual: Column, actual_unit: Column, expected: Column, expected_unit: Column, terms: Column | int = 1) -> Column:
    """Struct of status (match or mismatch), rounded, difference and tolerance."""
    difference, most = whole(whole(actual) - whole(expected)), tolerance(actual_unit, expected_unit, terms)
    within = F.abs(difference) <= most
    return F.struct(
        F.when(within, "match").otherwise("mismatch").alias("status"),
        ((difference != 0) & within).alias("rounded"),
        difference.alias("difference"),
        most.alias("tolerance"),
    )


def _quotient(a: Column, b: Column) -> Column:
    """Whole part of a / b for non-negative whole numbers."""
    return whole((whole(a) - (whole(a) % whole(b))) / whole(b))


def round_to(value: Column, unit: Column) -> Column:
    """Nearest multiple of ``unit``, halves away from zero; the value itself for a unit that is not positive."""
    u = F.greatest(whole(unit), whole(F.lit(1)))
    up = whole(F.abs(whole(value)) + _quotient(u, F.lit(2)))
    return F.when(unit <= 0, whole(value)).otherwise(whole((up - (up % u)) * F.signum(value).cast("int")))


def ratio_percent(numerator: Column, denominator: Column) -> Column:
    """Share in micro per cent, halves away from zero; null for a zero denominator."""
    a, b = F.abs(whole(numerator)) * F.lit(100 * MICRO).cast("decimal(18,0)"), F.abs(whole(denominator))
    q = _quotient(whole(whole(a) * 2 + b), whole(b * 2))
    sign = F.when((numerator < 0) != (denominator < 0), -1).otherwise(1)
    return F.when(denominator != 0, whole(q * sign))


def direction(before: Column, after: Column) -> Column:
    return F.when(after > before, "up").when(after < before, "down").otherwise("flat")


def formatted(value: Column, decimals: int, suffix: str = "") -> Column:
    """German notation with fixed decimals: points between thousands, a comma before the decimals."""
    unit = 10 ** (6 - min(6, decimals))
    steps = _quotient(round_to(F.abs(whole(value)), F.lit(unit).cast("decimal(38,0)")), F.lit(unit).cast("decimal(38,0)"))
    digits = F.lpad(steps.cast("string"), 40, "0")
    integer = F.regexp_replace(F.substring(digits, 1, 40 - decimals), "^0+(?=.)", "")
    grouped = F.reverse(F.regexp_replace(F.reverse(integer), "(\\d{3})(?=\\d)", "$1."))
    fraction = F.concat(F.lit(","), F.substring(digits, 41 - decimals, decimals)) if decimals else F.lit("")
    return F.concat(F.when(value < 0, "-").otherwise(""), grouped, fraction, F.lit(suffix))
