"""Event-level metrics: alarm runs against annotated intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.ranges import explode_range
from windrow.functions.ratios import fbeta, nan, ratio_or_nan
from windrow.operators.overlap import binned_sides
from windrow.operators.quality import require_single_source, single_source_columns
from windrow.operators.runs import clock, positive_runs

BIN_SEC = 3600.0


def record_spans(
    windows: DataFrame, keys: list[str], durations: DataFrame | None = None
) -> DataFrame:
    """Per (key, record): duration with its fallback, and time excluded from evaluation.

    A missing or zero duration falls back to the span of the windows. Excluded time is the
    number of indexes missing up to the last window times the median window span.
    """
    span = F.col("t_end_sec") - F.col("t_start_sec")
    per = windows.groupBy(*keys, "record_id").agg(
        (F.max("t_end_sec") - F.min("t_start_sec")).alias("__span"),
        F.count(F.lit(1)).alias("__present"),
        (F.max("window_idx") + 1).alias("__expected"),
        F.percentile(span, 0.5).alias("__width"),
        *single_source_columns(windows),
    )
    if durations is None:
        per = per.withColumn("duration_sec", F.lit(None).cast("double"))
    else:
        per = per.join(durations.select("record_id", "duration_sec"), "record_id", "left")
    known = F.when(F.col("duration_sec") != 0, F.col("duration_sec"))
    return per.select(
        *keys,
        "record_id",
        F.coalesce(known, "__span").alias("total_sec"),
        known.isNull().cast("int").alias("is_fallback"),
        (
            F.greatest(F.lit(0), F.col("__expected") - F.col("__present")) * F.col("__width")
        ).alias("excluded_sec"),
        "__source_min",
        "__source_max",
    )


def match_events(
    runs: DataFrame, truth: DataFrame, keys: list[str], bin_sec: float = BIN_SEC
) -> DataFrame:
    """One row per run (``is_run``, ``matched``) and per truth interval (``run_start``).

    ``truth`` carries the keys already: a run counts against the intervals of its own key.
    Both sides come out of one grouping of the binned join, so runs are computed once.
    ``run_start`` is the start of the first run that overlaps the interval, null without one.
    """
    on = keys + ["record_id"]
    sides = binned_sides(
        runs.select(*on, "first_idx", "start_sec", "end_sec", "n_windows"),
        truth.select(*on, "seizure_idx", "start_sec", "end_sec"),
        on,
        bin_sec,
    )
    by_run, by_truth = on + ["first_idx"], on + ["seizure_idx"]
    is_run = F.col("is_run")
    return (
        sides.groupingSets([by_run, by_truth], *on, "first_idx", "seizure_idx")
        .agg(
            (F.grouping("first_idx") == 0).alias("is_run"),
            F.max("overlaps").alias("matched"),
            F.min(F.when(F.col("overlaps"), F.col("start_sec"))).alias("run_start"),
            F.max("start_sec").alias("__run_start"),
            F.max("end_sec").alias("__run_end"),
            F.max("n_windows").alias("n_windows"),
            F.max("truth_start").alias("__truth_start"),
            F.max("truth_end").alias("__truth_end"),
        )
        .where(F.when(is_run, F.col("first_idx")).otherwise(F.col("seizure_idx")).isNotNull())
        .select(
            *on,
            "is_run",
            "first_idx",
            "seizure_idx",
            F.when(is_run, F.col("__run_start")).otherwise(F.col("__truth_start")).alias("start_sec"),
            F.when(is_run, F.col("__run_end")).otherwise(F.col("__truth_end")).alias("end_sec"),
            "n_windows",
            "matched",
            "run_start",
        )
    )


def match_counts(matches: DataFrame, by: list[str]) -> DataFrame:
    """Counters, seconds and latency quartiles per group of matched runs and intervals."""
    run, truth = F.col("is_run"), ~F.col("is_run")
    missed = run & ~F.col("matched")
    length = F.col("end_sec") - F.col("start_sec")
    latency = F.when(truth, F.col("run_start") - F.col("start_sec"))
    return matches.groupBy(*by).agg(
        F.count_if(truth).alias("n_true_events"),
        F.count_if(truth & F.col("matched")).alias("n_detected"),
        F.sum(F.when(truth, length).otherwise(0.0)).alias("ictal_sec"),
        F.percentile(latency, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("latencies"),
        F.count_if(run).alias("n_runs"),
        F.count_if(missed).alias("false_alarms"),
        F.sum(F.when(run, length).otherwise(0.0)).alias("alarm_sec"),
        F.sum(F.when(missed, length).otherwise(0.0)).alias("false_alarm_sec"),
    )


def event_metrics(
    windows: DataFrame,
    truth: DataFrame,
    k: int = 1,
    keys: list[str] | None = None,
    durations: DataFrame | None = None,
    predicted: str = "pred",
    bin_sec: float = BIN_SEC,
) -> DataFrame:
    """One row per key with the event counters and the derived rates.

    ``windows``: keys, record_id, window_idx, t_start_sec, t_end_sec, source, predicted flag.
    ``truth``: record_id, seizure_idx, start_sec, end_sec; only records present in the frame
    count. Detection is any overlap with a run of at least ``k``; latency runs from the
    annotated onset to the first such run and may be negative.
    """
    runs = positive_runs(windows, k, keys, predicted)
    return event_metrics_of_runs(windows, runs, truth, keys, durations, bin_sec)


def event_metrics_of_runs(
    windows: DataFrame,
    runs: DataFrame,
    truth: DataFrame,
    keys: list[str] | None = None,
    durations: DataFrame | None = None,
    bin_sec: float = BIN_SEC,
) -> DataFrame:
    everything = not keys
    if everything:
        keys = ["__all"]
        windows = windows.withColumn("__all", F.lit(0))
        runs = runs.withColumn("__all", F.lit(0))
    spans = record_spans(windows, keys, durations)
    truth_in = truth.select("record_id", "seizure_idx", "start_sec", "end_sec").join(
        spans.select(*keys, "record_id"), "record_id"
    )
    totals = require_single_source(
        spans.groupBy(*keys).agg(
            F.sum("total_sec").alias("total_sec"),
            F.sum("excluded_sec").alias("excluded_sec"),
            F.sum("is_fallback").alias("n_fallback_duration"),
            F.min("__source_min").alias("__source_min"),
            F.max("__source_max").alias("__source_max"),
        )
    )
    matches = match_events(runs, truth_in, keys, bin_sec)
    joined = totals.join(match_counts(matches, keys), keys, "left")
    counts = ["n_true_events", "n_detected", "n_runs", "false_alarms"]
    seconds = ["ictal_sec", "alarm_sec", "false_alarm_sec"]
    joined = joined.fillna(0, counts).fillna(0.0, seconds)
    quiet = F.col("total_sec") - F.col("ictal_sec") - F.col("excluded_sec")
    at = lambda i: F.coalesce(F.col("latencies")[i], nan())
    out = joined.withColumns(
        {
            "interictal_hours": F.greatest(F.lit(0.0), quiet) / 3600.0,
            "excluded_hours": F.col("excluded_sec") / 3600.0,
            "evaluated_hours": F.greatest(
                F.lit(0.0), F.col("total_sec") - F.col("excluded_sec")
            )
            / 3600.0,
            "alarm_hours": F.col("alarm_sec") / 3600.0,
            "false_alarm_hours": F.col("false_alarm_sec") / 3600.0,
            "latency_p25_sec": at(0),
            "median_latency_sec": at(1),
            "latency_p75_sec": at(2),
        }
    )
    out = out.withColumns(
        {
            "event_sensitivity": ratio_or_nan(F.col("n_detected"), F.col("n_true_events")),
            "fa_per_hour": ratio_or_nan(F.col("false_alarms"), F.col("interictal_hours")),
            "time_in_alarm_frac": ratio_or_nan(F.col("alarm_hours"), F.col("evaluated_hours")),
        }
    ).drop("latencies", "total_sec", "excluded_sec", "ictal_sec", "alarm_sec", "false_alarm_sec")
    return out.drop("__all") if everything else out


def validation_event_score(events: DataFrame) -> DataFrame:
    """``event_f2``: F2 of detections against alarms, scaled by the share of time not in alarm.

    NaN without true events; without a time-in-alarm figure the plain F2.
    """
    n_det, n_true = F.col("n_detected"), F.col("n_true_events")
    f2 = fbeta(n_det, F.col("false_alarms"), n_true - n_det, 2)
    quiet = F.lit(1.0) - F.col("time_in_alarm_frac")
    scaled = F.when(F.isnan(quiet), f2).otherwise(f2 * F.greatest(F.lit(0.0), quiet))
    return events.withColumn("event_f2", F.when(n_true == 0, nan()).otherwise(scaled))


def flagged_segments(
    windows: DataFrame, runs: DataFrame, truth: DataFrame, bin_sec: float = BIN_SEC
) -> DataFrame:
    """Flagged segments of each record: times, windows, peak score, overlap with annotations.

    The peak is over the windows inside the run, found by window index.
    """
    segments = match_events(runs, truth, [], bin_sec).where("is_run")
    members = explode_range(
        runs.select("record_id", "first_idx", "last_idx"),
        F.col("first_idx"),
        F.col("last_idx"),
        "window_idx",
    )
    peaks = (
        members.join(windows.select("record_id", "window_idx", "score"), ["record_id", "window_idx"])
        .groupBy("record_id", "first_idx")
        .agg(F.max("score").alias("peak_score"))
    )
    return segments.join(peaks, ["record_id", "first_idx"], "left").select(
        "record_id",
        "first_idx",
        clock(F.col("start_sec")).alias("start_clock"),
        clock(F.col("end_sec")).alias("end_clock"),
        (F.col("end_sec") - F.col("start_sec")).alias("seconds"),
        "n_windows",
        "peak_score",
        F.when(F.col("matched"), "yes").otherwise("no").alias("overlaps_annotation"),
    )
