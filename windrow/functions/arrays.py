"""Temporal features of an array of samples as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def differences(x: Column) -> Column:
    n = F.size(x)
    return F.zip_with(
        F.slice(x, F.lit(2), n - 1), F.slice(x, F.lit(1), n - 1), lambda b, a: b - a
    )


def line_length(x: Column) -> Column:
    return _total(F.transform(differences(x), F.abs))


def variance(x: Column) -> Column:
    """Population variance in two passes."""
    mean = _total(x) / F.size(x)
    return _total(F.transform(x, lambda v: (v - mean) * (v - mean))) / F.size(x)


def decimate(x: Column, step: int) -> Column:
    """Every ``step``-th sample."""
    return F.filter(x, lambda v, i: i % step == 0)
