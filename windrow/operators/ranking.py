"""Running counts down a score ranking, exact under ties, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 65536


def score_cell(score: Column, cells: int = CELLS) -> Column:
    """A cell number that rises with the score.

    The fourth root spreads scores crowded near 0; values outside [0, 1] share the end cells,
    which keeps the order right whatever the range is. Never null, so that both uses of the
    blocks share one shuffle.
    """
    unit = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.floor(F.sqrt(F.sqrt(unit)) * cells), F.lit(-1).cast("long"))


def score_blocks(
    rows: DataFrame, keys: list[str], score: str = "score", label: str = "label"
) -> DataFrame:
    """One row per distinct score (a tie block) with its positives and negatives."""
    return (
        rows.select(*keys, F.col(score).alias("score"), (F.col(label) == 1).alias("__pos"))
        .withColumn("__cell", score_cell(F.col("score")))
        .groupBy(*keys, "__cell", "score")
        .agg(F.count_if("__pos").alias("pos"), F.count_if(~F.col("__pos")).alias("neg"))
    )


def ranked_blocks(
    rows: DataFrame, keys: list[str], score: str = "score", label: str = "label"
) -> DataFrame:
    """Tie blocks with cumulative counts from the top and the next lower score.

    Columns: ``score, pos, neg, tp, fp`` (inclusive), ``next_score`` (null at the bottom),
    ``total_pos, total_neg, n_scores``. Two levels: the cells of a key (at most ``CELLS``
    rows) give offsets, the blocks of one cell are ranked on their own.
    """
    blocks = score_blocks(rows, keys, score, label)
    down = Window.partitionBy(*keys).orderBy(F.col("__cell").desc())
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    cells = (
        blocks.groupBy(*keys, "__cell")
        .agg(
            F.sum("pos").alias("__pos"),
            F.sum("neg").alias("__neg"),
            F.count(F.lit(1)).alias("__n"),
            F.max("score").alias("__top"),
        )
        .select(
            *keys,
            "__cell",
            F.coalesce(F.sum("__pos").over(above), F.lit(0)).alias("__pos_above"),
            F.coalesce(F.sum("__neg").over(above), F.lit(0)).alias("__neg_above"),
            F.lead("__top").over(down).alias("__next_top"),
            F.sum("__pos").over(whole).alias("total_pos"),
            F.sum("__neg").over(whole).alias("total_neg"),
            F.sum("__n").over(whole).alias("n_scores"),
        )
    )
    inside = Window.partitionBy(*keys, "__cell").orderBy(F.col("score").desc())
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return blocks.join(cells, keys + ["__cell"]).select(
        *keys,
        "score",
        "pos",
        "neg",
        (F.col("__pos_above") + F.sum("pos").over(upto)).alias("tp"),
        (F.col("__neg_above") + F.sum("neg").over(upto)).alias("fp"),
        F.coalesce(F.lead("score").over(inside), F.col("__next_top")).alias("next_score"),
        "total_pos",
        "total_neg",
        "n_scores",
    )


def quantiles(
    rows: DataFrame, keys: list[str], lo: float, hi: float, n_grid: int, value: str = "score"
) -> DataFrame:
    """``n_grid`` evenly spaced quantiles per key as an array ``q`` (linear interpolation), and ``n``.

    Ranks come from the cumulative counts of the tie blocks: each block works out which grid
    points fall on ranks it holds, so only a few rows per key are gathered.
    """
    step = (hi - lo) / max(1, n_grid - 1)
    blocks = ranked_blocks(rows.withColumn("__one", F.lit(1)), keys, value, "__one")
    blocks = blocks.select(
        *keys,
        "score",
        F.col("total_pos").alias("n"),
        (F.col("total_pos") - F.col("tp")).alias("low"),
        (F.col("total_pos") - F.col("tp") + F.col("pos") - 1).alias("high"),
    )
    last = F.col("n") - 1
    near = lambda rank: (rank / F.greatest(last, F.lit(1)) - lo) / step
    first_i = F.greatest(F.floor(near(F.col("low") - 1)).cast("int"), F.lit(0))
    last_i = F.least(F.ceil(near(F.col("high") + 1)).cast("int"), F.lit(n_grid - 1))
    prob = F.when(F.col("i") == n_grid - 1, F.lit(float(hi))).otherwise(lo + F.col("i") * step)
    held = lambda rank: (rank >= F.col("low")) & (rank <= F.col("high"))
    picked = (
        blocks.where(first_i <= last_i)
        .withColumn("i", F.explode(F.sequence(first_i, last_i)))
        .withColumn("pt", prob * last)
        .withColumn("a", F.when(held(F.floor("pt")), F.col("score")))
        .withColumn("b", F.when(held(F.ceil("pt")), F.col("score")))
        .where("a IS NOT NULL OR b IS NOT NULL")
    )
    value_at = F.max("a") + (F.max("b") - F.max("a")) * (F.max("pt") - F.floor(F.max("pt")))
    per_point = picked.groupBy(*keys, "i").agg(F.max("n").alias("n"), value_at.alias("v"))
    return per_point.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("q"),
    )


def linspace(lo: float, hi: float, n: int) -> list[float]:
    """n evenly spaced values, both ends included."""
    if n == 1:
        return [lo]
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n - 1)] + [hi]


def cell_rank(
    rows: DataFrame,
    keys: list[str],
    cell: Column,
    order: list[str],
    out: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Rank 1..n per key in the order of (cell, order), without one task ranking a whole key.

    Cell counts give offsets and only the rows of a cell are sorted together. ``total`` names a
    column for the rows per key.
    """
    marked = rows.withColumn("__cell", cell)
    before = (
        Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    cells = (
        marked.groupBy(*keys, "__cell")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *keys,
            "__cell",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
            F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
        )
    )
    inside = Window.partitionBy(*keys, "__cell").orderBy(*order)
    return (
        marked.join(cells, keys + ["__cell"])
        .withColumn(out, F.col("__before") + F.row_number().over(inside))
        .withColumn(total or "__total", F.col("__total"))
        .drop("__cell", "__before", "__total")
    )


def hash_rank(
    rows: DataFrame,
    keys: list[str],
    seed: int,
    uid: str,
    out: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """A seeded pseudo-random rank 1..n per key, the same for any partitioning.

    Rows are ordered by md5(seed:uid), whose first three hex digits are 4096 even cells.
    ``uid`` is unique per key.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(uid).cast("string")))
    marked = rows.withColumn("__md5", digest)
    return cell_rank(marked, keys, F.substring("__md5", 1, 3), ["__md5", uid], out, total).drop("__md5")
