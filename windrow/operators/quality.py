"""Assertions and refusal rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, condition: Column, message: str | Column) -> DataFrame:
    """Rows unchanged; the query fails with ``message`` on a row that breaks the condition."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(
        F.when(condition, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    )


def single_source_columns(df: DataFrame) -> list[Column]:
    """Aggregates from which ``require_single_source`` checks a group of rows."""
    if "source" not in df.columns:
        raise ValueError("frame has no 'source' column; every derived table carries one")
    return [F.min("source").alias("__source_min"), F.max("source").alias("__source_max")]


def require_single_source(aggregated: DataFrame) -> DataFrame:
    """Fail on a metric over rows of no source or of several; keep it as ``source``."""
    a, b = F.col("__source_min"), F.col("__source_max")
    text = F.concat(
        F.lit("metrics need exactly one source, found: "),
        F.concat_ws(", ", F.array_distinct(F.array(a, b))),
    )
    checked = require(aggregated, a.isNotNull() & (a == b), text)
    return checked.withColumnRenamed("__source_min", "source").drop("__source_max")


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows repeat another one in ``columns``."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
        F.count(F.lit(1)).alias("n_distinct"),
    )


def require_deduplicated(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fails when evaluated if rows repeat in the feature columns."""
    if not columns:
        return duplicate_rows(df.limit(0), df.columns)
    counts = duplicate_rows(df, columns)
    text = F.concat(F.col("n_duplicates").cast("string"), F.lit(" rows repeat the features of another"))
    return require(counts, F.col("n_duplicates") == 0, text)


def refusal_reason(
    missing: Column, n_usable: Column, rate: Column, expected_rate: float, n_windows: Column,
    on_missing: str = "skip_file",
) -> Column:
    """Why a recording cannot be featurised, or null; the first rule that applies."""
    reason = F.when(
        F.lit(on_missing == "skip_file") & (F.size(missing) > 0),
        F.concat(F.lit("missing_channels:"), F.array_join(missing, ",")),
    )
    return (
        reason.when(n_usable == 0, F.lit("no_usable_channels"))
        .when(
            F.abs(rate - expected_rate) > 1e-6,
            F.concat(F.lit("unexpected_sample_rate:"), rate.cast("string")),
        )
        .when(n_windows == 0, F.lit("record_shorter_than_window"))
    )
