"""Fixed windows over records and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.config import Windowing
from windrow.fixed_values import GUARD, ICTAL, INTERICTAL, OVERLAP_FRACTIONS
from windrow.functions.ranges import explode_range


def _bounds(idx: Column, spec: Windowing) -> tuple[Column, Column]:
    rate = F.lit(float(spec.sample_rate))
    first = idx * spec.stride_samples
    return first / rate, (first + spec.length_samples) / rate


def window_count(n_samples: Column, spec: Windowing) -> Column:
    """Whole windows in a record; a trailing partial window is dropped."""
    usable = n_samples - spec.length_samples
    return F.when(usable >= 0, F.floor(usable / spec.stride_samples) + 1).otherwise(0)


def _uid() -> Column:
    return F.format_string("%s_%06d", "record_id", "window_idx")


def cut_windows(records: DataFrame, spec: Windowing) -> DataFrame:
    """One row per window of each record (``record_id``, ``n_samples``, other columns kept)."""
    return _indexed(records, spec).withColumns(_times(spec)).withColumn("window_uid", _uid())


def _times(spec: Windowing) -> dict[str, Column]:
    t0, t1 = _bounds(F.col("window_idx"), spec)
    return {"t_start_sec": t0, "t_end_sec": t1}


def _indexed(records: DataFrame, spec: Windowing) -> DataFrame:
    rows = explode_range(
        records,
        F.lit(0),
        window_count(F.col("n_samples"), spec) - 1,
        "window_idx",
        spread_by=["record_id"],
    )
    return rows.withColumn("window_idx", F.col("window_idx").cast("int"))


def interval_hits(
    records: DataFrame,
    intervals: DataFrame,
    spec: Windowing,
    disputed: DataFrame | None = None,
) -> DataFrame:
    """Per touched window: overlap seconds, boundary proximity, disputed seconds.

    Windows lie on a grid, so each interval (widened by the guard) names the window indexes
    it can touch; the range join becomes an equality on (record, window index), whose keys
    stay small however long a record is or however many intervals it holds.
    """
    spans = intervals.select(
        "record_id", "start_sec", "end_sec", F.lit(False).alias("is_disputed")
    )
    if disputed is not None:
        spans = spans.unionByName(
            disputed.select(
                "record_id", "start_sec", "end_sec", F.lit(True).alias("is_disputed")
            )
        )
    sizes = records.select("record_id", window_count(F.col("n_samples"), spec).alias("__n"))
    guard, length, stride = spec.guard_sec, spec.length_sec, spec.stride_sec
    touched = explode_range(
        spans.join(sizes, "record_id"),
        F.greatest(F.lit(0), F.floor((F.col("start_sec") - guard - length) / stride)),
        F.least(F.col("__n") - 1, F.ceil((F.col("end_sec") + guard) / stride)),
        "window_idx",
    )
    a, b = F.col("start_sec"), F.col("end_sec")
    t0, t1 = _bounds(F.col("window_idx"), spec)
    inside = F.greatest(F.lit(0.0), F.least(t1, b) - F.greatest(t0, a))
    near = ((t1 > a - guard) & (t0 < a + guard)) | ((t1 > b - guard) & (t0 < b + guard))
    true_span = ~F.col("is_disputed")
    return touched.groupBy("record_id", F.col("window_idx").cast("int").alias("window_idx")).agg(
        F.sum(F.when(true_span, inside).otherwise(0.0)).alias("overlap_sec"),
        F.max(true_span & near).alias("near_boundary"),
        F.sum(F.when(true_span, 0.0).otherwise(inside)).alias("disputed_sec"),
    )


def label_windows(
    records: DataFrame,
    intervals: DataFrame,
    spec: Windowing,
    disputed: DataFrame | None = None,
) -> DataFrame:
    """Windows with ``overlap_frac`` and ``label``.

    Overlapping intervals count twice, so the fraction may exceed 1. Order of the rules:
    enough overlap, disputed span, partial overlap or a boundary nearby, otherwise 0.
    """
    hits = interval_hits(records, intervals, spec, disputed)
    # ids and times follow from the index and are added after the join
    rows = _indexed(records, spec).join(hits, ["record_id", "window_idx"], "left")
    rows = rows.withColumns(_times(spec))
    frac = F.coalesce(F.col("overlap_sec"), F.lit(0.0)) / (
        F.col("t_end_sec") - F.col("t_start_sec")
    )
    label = (
        F.when(F.col("overlap_frac") >= spec.min_overlap_frac, ICTAL)
        .when(F.col("disputed_sec") > 0, GUARD)
        .when((F.col("overlap_frac") > 0) | F.col("near_boundary"), GUARD)
        .otherwise(INTERICTAL)
    )
    return (
        rows.withColumn("overlap_frac", frac)
        .withColumn("label", label)
        .withColumn("window_uid", _uid())
        .drop("overlap_sec", "near_boundary", "disputed_sec")
    )


def resolve_intervals(intervals: DataFrame, overrides: DataFrame) -> DataFrame:
    """Records named in ``overrides`` take its intervals instead of their own."""
    kept = intervals.join(overrides.select("record_id").distinct(), "record_id", "left_anti")
    return kept.unionByName(overrides.select(*kept.columns))


def drop_guard(windows: DataFrame) -> DataFrame:
    return windows.where(F.col("label") != GUARD)


def relabel(windows: DataFrame, min_overlap_frac) -> DataFrame:
    """Labels at another overlap threshold; a guard row that fails it stays guard."""
    clears = F.col("overlap_frac") >= min_overlap_frac
    return windows.withColumn(
        "label",
        F.when(clears, ICTAL).when(F.col("label") == GUARD, GUARD).otherwise(INTERICTAL),
    )


def at_each_overlap(windows: DataFrame, fractions=OVERLAP_FRACTIONS) -> DataFrame:
    """Windows under each of the few overlap thresholds, relabelled; what stays guard is left out there."""
    every = windows.withColumn("min_overlap_frac", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    reached = F.col("overlap_frac") >= F.col("min_overlap_frac")
    kept = every.where((F.col("label") != GUARD) | reached)
    return kept.withColumn("label", F.when(reached, ICTAL).otherwise(INTERICTAL))


def overlap_sweep(windows: DataFrame, fractions=OVERLAP_FRACTIONS) -> DataFrame:
    """Class sizes at each overlap threshold, guard counted apart; one pass, no row copies."""
    ov, guard = F.col("overlap_frac"), F.col("label") == GUARD
    sums = []
    for i, f in enumerate(fractions):
        sums.append(F.count_if(ov >= f).alias(f"pos_{i}"))
        sums.append(F.count_if(guard & (ov < f)).alias(f"guard_{i}"))
    totals = windows.agg(F.count(F.lit(1)).alias("n"), *sums)
    per_frac = F.array(
        *[
            F.struct(
                F.lit(float(f)).alias("min_overlap_frac"),
                F.col(f"pos_{i}").alias("n_positive"),
                (F.col("n") - F.col(f"guard_{i}")).alias("n_windows"),
                F.col(f"guard_{i}").alias("n_guard"),
            )
            for i, f in enumerate(fractions)
        ]
    )
    rate = F.when(F.col("n_windows") > 0, F.col("n_positive") / F.col("n_windows")).otherwise(
        F.lit("NaN").cast("double")
    )
    return totals.select(F.inline(per_frac)).withColumn("positive_rate", rate)


def overlap_counts(windows: DataFrame, fractions=OVERLAP_FRACTIONS) -> DataFrame:
    """Positive counts at each overlap threshold over all windows, guard ignored."""
    totals = windows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("overlap_frac") >= f).alias(f"p{i}") for i, f in enumerate(fractions)],
    )
    per_frac = F.array(
        *[
            F.struct(
                F.lit(float(f)).alias("min_overlap_frac"),
                F.col(f"p{i}").alias("n_positive"),
                F.col("n").alias("n_windows"),
            )
            for i, f in enumerate(fractions)
        ]
    )
    return totals.select(F.inline(per_frac))


def label_counts(windows: DataFrame) -> DataFrame:
    """Label -> count map per record."""
    return (
        windows.groupBy("record_id", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("record_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"))
    )


def stamp_keys(
    records: DataFrame, registry: DataFrame, config_hash: str, source: str
) -> DataFrame:
    """Subject, configuration hash and source on records that know their case.

    Stamped before records become windows, so the join sees one row per record.
    """
    return records.join(registry.select("case_id", "subject_id"), "case_id", "left").withColumns(
        {"config_hash": F.lit(config_hash), "source": F.lit(source)}
    )
