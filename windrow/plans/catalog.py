"""The query catalogue: each query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.plans.fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, digits: int = 6):
    """Register a function of ``Tables`` under its own name, doubles rounded for comparison."""

    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(Tables(spark, folder)), digits)

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return wrap


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles to ``digits`` decimals and NaN to null, so both engines print the same value."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c.cast("double")
            c = F.when(~F.isnan(c), F.round(c, digits)).alias(f.name)
        cols.append(c)
    return df.select(*cols)
