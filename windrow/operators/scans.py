"""Running sums and stitching along one long line, in levels: no window holds more than a fan of blocks.

A line is cut into blocks; what a block passes on is one short summary (its sum, or the fragments at its two
ends). Summaries of neighbouring blocks are combined by blocks of blocks, level by level (``FAN`` to one), so
also a line without any key is spread over tasks. ``LEVELS`` levels span ``FAN ** LEVELS`` blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 1024
LEVELS = 3


def sums_before(blocks: DataFrame, at: str, value: str, out: str, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """``at, out``: for each block the sum of ``value`` over the blocks of smaller number. ``at`` is unique, from 0."""
    marked = blocks.select(at, value, F.floor(F.col(at) / fan).alias("__above"))
    inside = Window.partitionBy("__above").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    if levels == 1:
        beyond = F.when(F.col("__above") != 0, F.raise_error(F.lit("the line has more blocks than its levels span"))).otherwise(0)
        return marked.select(at, (own + beyond).alias(out))
    above = marked.groupBy(F.col("__above").alias("__unit")).agg(F.sum(value).alias(value))
    earlier = sums_before(above, "__unit", value, "__earlier", levels - 1, fan).withColumnRenamed("__unit", "__above")
    return marked.withColumn("__own", own).join(earlier, "__above").select(at, (F.col("__own") + F.col("__earlier")).alias(out))


def stitched(fragments: DataFrame, keys: list[str], block: int, wide: int | None, merge: list[Column]) -> DataFrame:
    """Fragments ``first_idx .. last_idx`` with those joined that meet inside blocks of ``wide`` (None: anywhere).

    Only fragments that touch an edge of ``block`` can meet others; the rest pass through by their block.
    """
    at_edge = (F.pmod("first_idx", F.lit(block)) == 0) | (F.pmod("last_idx", F.lit(block)) == block - 1)
    zone = F.floor(F.col("first_idx") / wide) if wide else F.lit(0).cast("long")
    marked = fragments.withColumn("__edge", at_edge).withColumn(
        "__zone", F.when(F.col("__edge"), zone).otherwise(F.floor(F.col("first_idx") / block))
    )
    along = Window.partitionBy(*keys, "__edge", "__zone").orderBy("first_idx")
    starts = F.coalesce(F.lag("last_idx").over(along) + 1 != F.col("first_idx"), F.lit(True))
    return (
        marked.withColumn("__starts", starts.cast("int"))
        .withColumn("__run", F.sum("__starts").over(along))
        .groupBy(*keys, "__edge", "__zone", "__run")
        .agg(F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"), *merge)
        .drop("__edge", "__zone", "__run")
    )


def stitched_in_levels(
    fragments: DataFrame, keys: list[str], block: int, merge: list[Column], levels: int = LEVELS, fan: int = FAN
) -> DataFrame:
    """All fragments joined, by blocks of blocks: a window holds the ends of at most ``fan`` blocks."""
    for _ in range(levels):
        fragments = stitched(fragments, keys, block, block * fan, merge)
        block *= fan
    return stitched(fragments, keys, block, None, merge)
