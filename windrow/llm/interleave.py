"""Sharding: proportional stratified interleaving, in DataFrame functions only.

Method: inside each source the rows are put in a seeded random order and ranked; a row's fractional
rank is (rank - u) / rows of the source, with a seeded u in [0, 1) per source; all rows sorted by that
fraction mix the sources in proportion everywhere, and cutting the sorted rows into equal runs gives
shards whose counts differ by one at most (law ``rows``) and whose mixture is that of the whole.

No source is ranked in one task: a row falls into one of ``rows / cell`` cells by its random number,
cell totals (aggregated before the shuffle) give the rank before the cell, and only a cell's own rows are
sorted. Cells of fractions do the same for the global order. Running totals go in two levels, so
no task holds more than the square root of the cells.

Defined cases: a null text has no bytes, a null source is a source of its own, rows that are equal in
id, source, size and checksum are interchangeable, an empty table gives no rows. Only ``doc_id``,
``text`` and ``source`` are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.llm.frames import stored
from windrow.llm.registry import query, table


@dataclass(frozen=True)
class Settings:
    shards: int = 24
    seed: int = 17
    cell: int = 2048  # rows sorted together


def fraction(*parts: Column) -> Column:
    """A seeded number in [0, 1) with 52 random bits."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") / float(1 << 52)


def totals_before(totals: DataFrame, keys: list[str], n_cells: int) -> DataFrame:
    """``keys, cell, n`` with ``before``, the sum of ``n`` over lower cells, in two levels."""
    span = max(1, math.isqrt(n_cells))
    rows = totals.withColumn("__span", F.expr(f"cell div {span}"))
    lower = Window.partitionBy(*keys, "__span").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*keys, "__span").agg(F.sum("n").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    rows = rows.withColumn("__own", F.coalesce(F.sum("n").over(lower), F.lit(0)))
    return rows.join(spans.drop("__n"), [*keys, "__span"]).select(
        *keys, "cell", (F.col("__own") + F.col("__before")).alias("before")
    )


def interleaved(documents: DataFrame, s: Settings | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, source`` of every document."""
    s = s or Settings()
    count = documents.count()
    n_cells = max(1, count // s.cell)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    source = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("stratum"), F.col("source").alias("source"),
        (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        fraction(F.lit(s.seed), F.col("doc_id"), F.col("source")).alias("draw"),
    ).withColumn("cell", F.floor(F.col("draw") * n_cells).cast("long"))
    cells = rows.groupBy("stratum", "cell").agg(F.count("*").alias("n")).repartition("stratum", "cell")
    sizes = cells.groupBy("stratum").agg(F.sum("n").alias("n_source"))
    offsets = totals_before(cells, ["stratum"], n_cells).join(sizes, "stratum")
    inside = Window.partitionBy("stratum", "cell").orderBy("draw", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(inside)).join(offsets, ["stratum", "cell"])
    placed = ranked.select(
        "doc_id", "source", "stratum", "size", "text_crc32", "draw",
        ((F.col("rank") + F.col("before") - fraction(F.lit(s.seed + 1), F.col("stratum"))) / F.col("n_source")).alias("share"),
    )
    placed = placed.withColumn("cell", F.least(F.floor(F.col("share") * n_cells), F.lit(n_cells - 1)).cast("long"))
    placed = stored(placed, "interleaved")
    order = Window.partitionBy("cell").orderBy("share", "stratum", "draw", "doc_id", "text_crc32", "size")
    before = totals_before(
        placed.groupBy("cell").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), ["all"], n_cells
    ).drop("all")
    position = (
        placed.withColumn("rank", F.row_number().over(order)).join(before, "cell")
        .withColumn("at", F.col("rank") + F.col("before") - 1)
        .withColumn("shard", F.expr(f"cast(at * {s.shards} div {max(1, count)} as int)"))
    )
    return position.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("at") - F.expr(f"(shard * {count}L + {s.shards - 1}) div {s.shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


@query()
def op4_interleave(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document, every shard with the mixture of the whole."""
    return interleaved(table(spark, folder, "documents"))
