"""Guarded ratios. Window ratios are 0 on a zero denominator, event ratios NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit("NaN").cast("double")


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def ratio_or_nan(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(nan())


def fbeta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    """F-beta of counts; 0 without a true positive."""
    b2 = float(beta * beta)
    hits = F.lit(1 + b2) * tp
    return F.when(tp > 0, hits / (hits + F.lit(b2) * fn + fp)).otherwise(F.lit(0.0))


def number_or_null(c: Column) -> Column:
    """NaN becomes null, so that averages and sums skip it."""
    return F.when(~F.isnan(c), c)
