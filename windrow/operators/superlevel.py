"""Runs at every threshold at once, as step functions of it.

A window is inside a run of at least ``k`` at threshold t if and only if its *opened* score reaches t: the
greatest, over the k-stretches of neighbours it is in, of the least score of the stretch. Among opened scores
the number of runs at t is the number of windows that reach t less the neighbouring pairs that both do; any
sum over runs splits in the same way, and runs that touch marked windows are the marked windows that reach t
less the pairs of successive marks joined at t, those between which no score is lower. So each window, pair
and mark adds one step to a sum, whatever the number of thresholds, and no row is repeated for any.

Only the order of scores against the candidate thresholds matters, and taking least and greatest keeps it.
So a score is replaced at once by its *level*, the number of candidates it reaches (0: none), and
everything after works on small integers.

Neighbours come from windows over (record, chunk of indexes); rows near a chunk's edge are also listed in the next
chunk. What lies between marks is reduced per chunk and then along the chunks and marks of a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.ranges import explode_range

CHUNK = 4096


def with_levels(windows: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Windows with ``level``: how many of their key's ascending ``candidates`` the score reaches."""
    reached = F.size(F.filter("candidates", lambda v: v <= F.col("score")))
    return windows.join(candidates, keys).withColumn("level", reached).drop("candidates")


def opened(rows: DataFrame, keys: list[str], ks: list[int], reach: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Rows with ``open_<k>``: the level up to which the window is in a run of at least ``k``.

    With ``reach`` a window that overlaps a run's window within so many indexes counts as covered by it;
    ``next_start`` and ``link_<k>`` tell the following window's start and the level up to which both are in one run.
    """
    halo = max(ks, default=1) + reach
    at = F.col("window_idx")
    listed = rows.withColumn("__chunk", F.explode(F.sequence(F.floor((at - halo) / chunk), F.floor((at + halo) / chunk))))
    along = Window.partitionBy(*keys, "record_id", "__chunk").orderBy("window_idx")
    following = (F.lead("window_idx").over(along) == at + 1)
    out = listed.withColumn("next_start", F.when(following, F.lead("t_start_sec").over(along)))
    for k in ks:
        ahead = along.rangeBetween(0, k - 1)
        stretch = F.when(F.count(F.lit(1)).over(ahead) == k, F.min("level").over(ahead)).otherwise(0)
        out = out.withColumn("__stretch", stretch).withColumn(f"open_{k}", F.max("__stretch").over(along.rangeBetween(-(k - 1), 0)))
        both = F.least(F.col(f"open_{k}"), F.lead(f"open_{k}").over(along))
        out = out.withColumn(f"link_{k}", F.when(F.col("next_start").isNotNull(), both).otherwise(0))
        if reach:
            out = out.withColumn(f"open_{k}", F.max(f"open_{k}").over(along.rangeBetween(-reach, reach)))
    return out.where(F.floor(at / chunk) == F.col("__chunk")).drop("__chunk", "__stretch")


def steps(rows: DataFrame, by: list[str], *parts: tuple[Column, dict[str, Column]]) -> DataFrame:
    """Sums per key and ``level``; each part gives a level and what it adds there."""
    names = list(dict.fromkeys(n for _, adds in parts for n in adds))
    zero = F.lit(0)
    cells = [F.struct(level.alias("level"), *[adds.get(n, zero).cast("double").alias(n) for n in names]) for level, adds in parts]
    flat = rows.select(*by, F.inline(F.array(*cells)))
    return flat.where(F.col("level") > 0).groupBy(*by, "level").agg(*[F.sum(n).alias(n) for n in names])


def at_candidates(candidates: DataFrame, sums: DataFrame, by: list[str], names: list[str], more: list[str] | None = None) -> DataFrame:
    """Each candidate threshold of each key with the sums of all steps at its level or above.

    ``candidates``: ``by`` and the ascending array ``candidates``; ``more`` are further keys it carries.
    """
    on = by + (more or [])
    grid = candidates.select(*on, F.posexplode("candidates").alias("__at", "threshold")).withColumn("level", F.col("__at") + 1)
    above = Window.partitionBy(*on).orderBy(F.desc("level"))
    joined = grid.join(sums, on + ["level"], "left")
    return joined.select(*on, "threshold", *[F.sum(F.coalesce(n, F.lit(0.0))).over(above).alias(n) for n in names])


def touched(rows: DataFrame, truth: DataFrame, level: str, link: str, bin_sec: float) -> tuple[DataFrame, DataFrame]:
    """Windows whose span meets an interval, and the level up to which each interval is met.

    A run meets an interval by a window or by the gap to the following one; both are looked up by time bin.
    """
    end = F.greatest("t_end_sec", F.coalesce("next_start", "t_end_sec"))
    spans = rows.select("record_id", "window_idx", "t_start_sec", "t_end_sec", "next_start", F.col(level).alias("o"), F.col(link).alias("l"))
    spans = explode_range(spans, F.floor(F.col("t_start_sec") / bin_sec), F.floor(end / bin_sec), "__bin")
    events = truth.select("record_id", "seizure_idx", F.col("start_sec").alias("a"), F.col("end_sec").alias("z"))
    events = explode_range(events, F.floor(F.col("a") / bin_sec), F.floor(F.col("z") / bin_sec), "__bin")
    by_window = (F.col("t_end_sec") > F.col("a")) & (F.col("t_start_sec") < F.col("z"))
    # an interval that meets no window but lies in the gap, or without length on the edge, is inside the run
    by_link = F.coalesce((F.col("next_start") >= F.col("a")) & (F.col("t_end_sec") <= F.col("z")), F.lit(False))
    met = spans.join(events, ["record_id", "__bin"]).withColumns({"w": by_window, "k": by_link}).where("w OR k")
    marks = met.groupBy("record_id", "window_idx").agg(F.max("w").alias("mark"), F.max("k").alias("link_mark"))
    best = F.greatest(F.when(F.col("w"), F.col("o")).otherwise(0), F.when(F.col("k"), F.col("l")).otherwise(0))
    return marks, met.groupBy("record_id", "seizure_idx").agg(F.max(best).alias("level"))


def mark_steps(rows: DataFrame, marks: DataFrame, level: str, link: str, chunk: int = CHUNK) -> DataFrame:
    """``record_id, level, matched``: steps whose sums count the runs that hold a mark."""
    spot = lambda at, v, m: F.struct(at.alias("at"), v.alias("v"), F.coalesce(m, F.lit(False)).alias("m"))
    two = F.col("window_idx").cast("long") * 2
    # only records with marks matter; a window and the link behind it are two places of one line
    held = rows.join(marks.select("record_id").distinct(), "record_id", "left_semi").join(marks, ["record_id", "window_idx"], "left")
    line = held.select("record_id", F.inline(F.array(spot(two, F.col(level), F.col("mark")), spot(two + 1, F.col(link), F.col("link_mark")))))
    line = line.withColumn("__chunk", F.floor(F.col("at") / (2 * chunk)))
    inside = Window.partitionBy("record_id", "__chunk").orderBy("at")
    part = line.withColumn("g", F.sum(F.col("m").cast("int")).over(inside)).groupBy("record_id", "__chunk", "g").agg(
        F.min("v").alias("low"), F.max(F.when(F.col("m"), F.col("v"))).alias("own"), F.min("at").alias("at")
    )
    along = Window.partitionBy("record_id").orderBy("at")
    part = part.withColumn("mark", F.sum((F.col("g") > 0).cast("int")).over(along)).where(F.col("mark") > 0)
    whole = part.groupBy("record_id", "mark").agg(F.min("low").alias("low"), F.max("own").alias("own"))
    pair = F.least("low", F.lead("own").over(Window.partitionBy("record_id").orderBy("mark")))
    joined = whole.withColumn("pair", F.when(F.lead("own").over(Window.partitionBy("record_id").orderBy("mark")).isNotNull(), pair).otherwise(0))
    return steps(joined, ["record_id"], (F.col("own"), {"matched": F.lit(1)}), (F.col("pair"), {"matched": F.lit(-1)}))
