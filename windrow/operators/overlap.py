"""Interval overlap join on time bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.ranges import explode_range


def binned_sides(
    runs: DataFrame, truth: DataFrame, on: list[str], bin_sec: float
) -> DataFrame:
    """Runs and truth intervals side by side per time bin (full outer), with ``overlaps``.

    Each side is listed under the time bins it covers and joined by bin, which spreads a long
    or busy record over many keys. A side without partner in a bin stays, with nulls for the
    other. Any ``bin_sec`` is right; it sets only how fine the work is cut.
    """

    def bins(df, start, end):
        return explode_range(df, F.floor(start / bin_sec), F.floor(end / bin_sec), "__bin")

    a = bins(runs, F.col("start_sec"), F.col("end_sec"))
    b = truth.withColumnsRenamed({"start_sec": "truth_start", "end_sec": "truth_end"})
    b = bins(b, F.col("truth_start"), F.col("truth_end"))
    overlaps = (F.col("end_sec") > F.col("truth_start")) & (
        F.col("start_sec") < F.col("truth_end")
    )
    return a.join(b, on + ["__bin"], "full").withColumn(
        "overlaps", F.coalesce(overlaps, F.lit(False))
    )
