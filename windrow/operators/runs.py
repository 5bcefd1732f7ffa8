"""Alarm runs: contiguous positive windows, their masks and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.ranges import explode_range
from windrow.operators.scans import FAN, stitched, stitched_in_levels

CHUNK = 4096


def islands(
    rows: DataFrame,
    keys: list[str],
    idx: str = "window_idx",
    extra: list[Column] | None = None,
    merge: list[Column] | None = None,
    chunk: int = CHUNK,
    fan: int = FAN,
) -> DataFrame:
    """Maximal stretches of consecutive ``idx`` per key: ``first_idx``, ``last_idx``, ``n``.

    ``idx`` is unique per key. Stretches are found inside fixed chunks of the index, then
    those touching a chunk edge are stitched; so no task holds more than a chunk of one key
    plus two fragments per chunk, even where one key has most of the rows. ``extra`` are
    aggregates over rows, ``merge`` the aggregates that combine them over fragments.
    """
    extra, merge = extra or [], merge or []
    inside = Window.partitionBy(*keys, "__chunk").orderBy(idx)
    fragments = (
        rows.withColumn("__chunk", F.floor(F.col(idx) / chunk))
        .withColumn("__island", F.col(idx) - F.row_number().over(inside))
        .groupBy(*keys, "__chunk", "__island")
        .agg(F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"), *extra)
    )
    # a line without a key is stitched in levels; with keys, a record's fragments are two for each chunk
    if keys:
        joined = stitched(fragments.drop("__chunk", "__island"), keys, chunk, None, merge)
    else:
        joined = stitched_in_levels(fragments.drop("__chunk", "__island"), keys, chunk, merge, fan=fan)
    return joined.withColumn("n", F.col("last_idx") - F.col("first_idx") + 1)


def positive_runs(
    windows: DataFrame,
    k: int = 1,
    keys: list[str] | None = None,
    predicted: str = "pred",
    chunk: int = CHUNK,
    count_positives: bool = False,
) -> DataFrame:
    """Runs of at least ``k`` predicted windows per record, adjacent by window index."""
    keys = keys or []
    extra = [F.min("t_start_sec").alias("start_sec"), F.max("t_end_sec").alias("end_sec")]
    merge = [F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec")]
    if count_positives:
        extra.append(F.count_if(F.col("label") == 1).alias("n_pos"))
        merge.append(F.sum("n_pos").alias("n_pos"))
    runs = islands(
        windows.where(F.col(predicted).cast("boolean")),
        keys + ["record_id"],
        extra=extra,
        merge=merge,
        chunk=chunk,
    )
    return runs.withColumnRenamed("n", "n_windows").where(F.col("n_windows") >= k)


def longest_run(
    windows: DataFrame,
    runs: DataFrame,
    keys: list[str] | None = None,
    reach: int = 0,
) -> DataFrame:
    """Windows with ``run_len``: length of the longest run of their record they overlap in time.

    ``reach`` is how many neighbours a window overlaps (0 when stride >= length). Runs
    name the window indexes they can cover, so the time overlap becomes an equality join.
    """
    on = (keys or []) + ["record_id", "window_idx"]
    covered = explode_range(
        runs.select(*(keys or []), "record_id", "first_idx", "last_idx", "n_windows"),
        F.col("first_idx") - reach,
        F.col("last_idx") + reach,
        "window_idx",
    ).withColumn("window_idx", F.col("window_idx").cast("int"))
    if reach:
        covered = covered.groupBy(*on).agg(F.max("n_windows").alias("n_windows"))
    return windows.join(
        covered.select(*on, F.col("n_windows").alias("run_len")), on, "left"
    ).withColumn("run_len", F.coalesce("run_len", F.lit(0)))


def run_mask(
    windows: DataFrame,
    k: int,
    keys: list[str] | None = None,
    predicted: str = "pred",
    reach: int = 0,
) -> DataFrame:
    """Windows with ``in_run``: whether they time-overlap a surviving run of their record."""
    runs = positive_runs(windows, k, keys, predicted)
    return longest_run(windows, runs, keys, reach).withColumn(
        "in_run", F.col("run_len") > 0
    ).drop("run_len")


def clock(seconds: Column) -> Column:
    """mm:ss"""
    return F.format_string(
        "%02d:%02d", F.floor(seconds / 60), F.floor(F.pmod(seconds, F.lit(60.0)))
    )
