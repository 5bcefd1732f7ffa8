"""Integer ranges as rows, generated in bounded pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 4096


def explode_range(
    df: DataFrame,
    lo: Column,
    hi: Column,
    name: str,
    spread_by: list[str] | None = None,
    piece: int = PIECE,
) -> DataFrame:
    """One row per integer in [lo, hi].

    The range is cut into aligned pieces first, so no array holds more than ``piece``
    values, and with ``spread_by`` the pieces of one long range go to different tasks.
    """
    block = f"__{name}_piece"
    out = (
        df.withColumns({"__lo": lo.cast("long"), "__hi": hi.cast("long")})
        .where(F.col("__lo") <= F.col("__hi"))
        .withColumn(
            block,
            F.explode(
                F.sequence(F.floor(F.col("__lo") / piece), F.floor(F.col("__hi") / piece))
            ),
        )
    )
    if spread_by:
        out = out.repartition(*spread_by, block)
    first = F.greatest(F.col("__lo"), F.col(block) * piece)
    last = F.least(F.col("__hi"), F.col(block) * piece + (piece - 1))
    return out.withColumn(name, F.explode(F.sequence(first, last))).drop("__lo", "__hi", block)
