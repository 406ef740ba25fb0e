"""Column expressions for rank statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

P_CLIP = 0.005

# Acklam's rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    text = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
    return text


def inverse_normal_sql(p: str) -> str:
    """SQL text, the same in Spark and elsewhere, for 0 < p < 1."""
    q, r = f"({p} - CAST(0.5 AS DOUBLE))", f"(({p} - CAST(0.5 AS DOUBLE)) * ({p} - CAST(0.5 AS DOUBLE)))"
    low, high = f"sqrt(CAST(-2 AS DOUBLE) * ln({p}))", f"sqrt(CAST(-2 AS DOUBLE) * ln(CAST(1 AS DOUBLE) - {p}))"
    one = "CAST(1 AS DOUBLE)"
    tail = lambda t: f"({_horner(t, _C)} / ({_horner(t, _D)} * {t} + {one}))"
    centre = f"({_horner(r, _A)} * {q} / ({_horner(r, _B)} * {r} + {one}))"
    return f"CASE WHEN {p} < CAST(0.02425 AS DOUBLE) THEN {tail(low)} WHEN {p} > CAST(0.97575 AS DOUBLE) THEN -{tail(high)} ELSE {centre} END"


def inverse_normal(p: str) -> Column:
    """Of the column named p; null stays null."""
    return F.expr(inverse_normal_sql(p))


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(P_CLIP), F.least(F.lit(1 - P_CLIP), p))


def per_90(value: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, value / (minutes / 90.0))


def ratio_pct(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, 100.0 * numerator / denominator)


def age_at(reference: Column, born: Column) -> Column:
    return F.datediff(reference, born) / F.lit(365.25).cast("double")
