"""Exact percentiles of very large groups, by selection: no task holds a group's values.

The asked ranks are found by narrowing. First rows are counted in bins of about one percent of a value's size,
in order of the values; running counts tell the bin of each rank. Rows of those bins alone are written out
and counted again in even parts of the bin. Of the parts that hold a rank, the distinct values are counted and
ranked. Two scans, whatever the values; counts are combined before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.session import pinned

STEPS = 64  # bins in each doubling
PARTS = 4096  # parts of a bin
SHIFT = 1 << 17  # more than STEPS times the smallest exponent
LAST = 1 << 19  # the bin of NaN, which orders after all numbers


def bin_of(x: Column) -> Column:
    """A whole number that never falls as ``x`` rises."""
    size = F.floor(F.log2(F.abs(x)) * STEPS) + SHIFT
    infinite = F.lit(LAST - 1)
    number = F.when(F.abs(x) == float("inf"), infinite).otherwise(size)
    return F.when(F.isnan(x), F.lit(LAST)).when(x == 0, F.lit(0)).when(x > 0, number).otherwise(-number).cast("int")


def _located(counts: DataFrame, asked: DataFrame, by: list[str], order: str, more: list[str]) -> DataFrame:
    """Asked ranks with the bin they fall in; ``rank`` becomes the rank inside it.

    ``counts``: ``by``, ``order`` and ``n``, few rows per key. ``asked``: ``by``, ``i``, ``rank``.
    """
    along = Window.partitionBy(*by).orderBy(order)
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("before", before)
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    found = placed.join(asked, by).where(inside)
    return found.select(*by, order, *more, "i", (F.col("rank") - F.col("before")).alias("rank"))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """``p``: the percentiles per key, interpolated between neighbouring ranks. Nulls are left out."""
    x = F.col(value).cast("double")
    binned = rows.where(F.col(value).isNotNull()).select(*keys, x.alias("x"), bin_of(x).alias("bin"))
    counts = pinned(binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    at = lambda s: F.lit(float(s)) * (F.col("total") - 1)
    wanted = [F.struct(F.lit(2 * k + side).alias("i"), cut(at(s)).cast("long").alias("rank")) for k, s in enumerate(shares) for side, cut in enumerate((F.floor, F.ceil))]
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    asked = totals.select(*keys, F.inline(F.array(*wanted)))
    first = pinned(_located(counts, asked, keys, "bin", ["low", "high"]))
    spans = first.select(*keys, "bin", "low", "high").distinct()
    step = F.lit(float(PARTS)) / (F.col("high") - F.col("low"))
    even = (F.col("high") > F.col("low")) & (F.col("bin") < LAST - 1)
    part = F.when(even, F.least(F.floor((F.col("x") - F.col("low")) * step), F.lit(PARTS - 1))).otherwise(0).cast("int")
    near = pinned(binned.join(spans, keys + ["bin"]).select(*keys, "bin", part.alias("part"), "x"))
    on = keys + ["bin"]
    second = _located(near.groupBy(*on, "part").agg(F.count(F.lit(1)).alias("n")), first.select(*on, "i", "rank"), on, "part", [])
    second, on = pinned(second), on + ["part"]
    values = near.join(second.select(*on).distinct(), on, "left_semi").groupBy(*on, "x").agg(F.count(F.lit(1)).alias("n"))
    third = _located(values, second, on, "x", [])
    found = third.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("v")).join(totals, keys)
    a, b = (lambda k: F.col("v")[2 * k]), (lambda k: F.col("v")[2 * k + 1])
    between = [a(k) + (b(k) - a(k)) * (at(s) - F.floor(at(s))) for k, s in enumerate(shares)]
    same = [F.when(a(k) == b(k), a(k)).otherwise(x) for k, x in enumerate(between)]  # also where both are infinite
    return found.select(*keys, F.array(*same).alias("p"))
