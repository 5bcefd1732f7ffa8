"""Queries: windows, labels, runs, events and operating points."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.operators import events as ev
from windrow.operators import runs as rn
from windrow.operators import windows as wn
from windrow.plans import fixtures as fx
from windrow.plans.catalog import query
from windrow.plans.fixtures import Tables, sql

EVENT_SQL = {
    "ex_span": """
        SELECT {key} AS key_id, w.record_id,
          coalesce(nullif(any_value(d.duration_sec), 0), max(t_end_sec) - min(t_start_sec)) AS total_sec,
          (coalesce(any_value(d.duration_sec), 0) = 0)::INTEGER AS fb,
          greatest(0, max(window_idx) + 1 - count(*)) * quantile_cont(t_end_sec - t_start_sec, 0.5) AS excl
        FROM {frame} w LEFT JOIN fx_duration d ON d.record_id = w.record_id GROUP BY 1, 2""",
    "ex_run": "SELECT {key} AS key_id, w.* FROM {runs} w WHERE n_windows >= {k}",
    "ex_truth": """
        SELECT s.key_id, i.record_id, i.seizure_idx, i.start_sec, i.end_sec, min(r.start_sec) AS run_start
        FROM fx_interval i JOIN ex_span s ON s.record_id = i.record_id
        LEFT JOIN ex_run r ON r.record_id = i.record_id AND r.key_id = s.key_id AND r.end_sec > i.start_sec AND r.start_sec < i.end_sec
        GROUP BY ALL""",
    "ex_alarm": """
        SELECT r.*, EXISTS (SELECT 1 FROM fx_interval i WHERE i.record_id = r.record_id
            AND r.end_sec > i.start_sec AND r.start_sec < i.end_sec) AS matched
        FROM ex_run r""",
    "ex_raw": """
        SELECT a.*, coalesce(n_true_events, 0) AS n_true_events, coalesce(n_detected, 0) AS n_detected,
          coalesce(ictal, 0) AS ictal, p25, p50, p75, coalesce(n_runs, 0) AS n_runs,
          coalesce(false_alarms, 0) AS false_alarms, coalesce(alarm, 0) AS alarm, coalesce(falarm, 0) AS falarm
        FROM (SELECT key_id, sum(total_sec) AS total, sum(excl) AS excl, sum(fb) AS fb FROM ex_span GROUP BY 1) a
        LEFT JOIN (SELECT key_id, count(*) AS n_true_events, count(run_start) AS n_detected,
            sum(end_sec - start_sec) AS ictal, quantile_cont(run_start - start_sec, 0.25) AS p25,
            quantile_cont(run_start - start_sec, 0.5) AS p50, quantile_cont(run_start - start_sec, 0.75) AS p75
          FROM ex_truth GROUP BY 1) b USING (key_id)
        LEFT JOIN (SELECT key_id, count(*) AS n_runs, count(*) FILTER (NOT matched) AS false_alarms,
            sum(end_sec - start_sec) AS alarm, coalesce(sum(end_sec - start_sec) FILTER (NOT matched), 0) AS falarm
          FROM ex_alarm GROUP BY 1) c USING (key_id)""",
    "ex_event": """
        SELECT key_id, 'events' AS source, n_true_events, n_detected, n_runs, false_alarms,
          fb AS n_fallback_duration, greatest(0, total - ictal - excl) / 3600 AS interictal_hours,
          excl / 3600 AS excluded_hours, greatest(0, total - excl) / 3600 AS evaluated_hours,
          alarm / 3600 AS alarm_hours, falarm / 3600 AS false_alarm_hours,
          p25 AS latency_p25_sec, p50 AS median_latency_sec, p75 AS latency_p75_sec,
          n_detected / nullif(n_true_events, 0) AS event_sensitivity,
          false_alarms / nullif(greatest(0, total - ictal - excl) / 3600, 0) AS fa_per_hour,
          alarm / nullif(greatest(0, total - excl), 0) AS time_in_alarm_frac
        FROM ex_raw""",
}
EVENT_DOUBLES = (
    "interictal_hours excluded_hours evaluated_hours alarm_hours false_alarm_hours "
    "latency_p25_sec median_latency_sec latency_p75_sec event_sensitivity fa_per_hour "
    "time_in_alarm_frac"
).split()
EVENT_INTS = "n_true_events n_detected n_runs false_alarms n_fallback_duration".split()


def event_sql(key: str, key_name: str | None, k: int, runs="fx_run1", frame="fx_eval", tail="") -> str:
    views = {
        n: v.replace("{key}", key).replace("{k}", str(k)).replace("{runs}", runs).replace("{frame}", frame)
        for n, v in EVENT_SQL.items()
    }
    cols = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in EVENT_DOUBLES)
    head = f"key_id AS {key_name}, " if key_name else ""
    return sql(
        f"SELECT {head}source, {', '.join(f'{c}::BIGINT AS {c}' for c in EVENT_INTS)}, {cols}{tail} FROM ex_event",
        **views,
    )


@query(sql("""
    SELECT user_id, record_id, case_id, subject_id, duration_sec, 2592000::BIGINT AS n_samples, window_idx,
      t_start_sec, t_end_sec, record_id || '_' || printf('%06d', window_idx) AS window_uid FROM fx_grid"""))
def cut_windows(t: Tables):
    """Fixed windows over each record, no trailing partial window."""
    return wn.cut_windows(fx.records(t), fx.SPEC)


@query(sql("""
    SELECT record_id, window_idx, t_start_sec, t_end_sec FROM fx_grid_overlap"""))
def cut_sliding_windows(t: Tables):
    """E1 with stride below length."""
    return wn.cut_windows(fx.records(t), fx.OVERLAPPING_SPEC).select(
        "record_id", "window_idx", "t_start_sec", "t_end_sec"
    )


@query(sql("""
    SELECT w.record_id, w.window_idx,
      sum(greatest(0.0, least(w.t_end_sec, i.end_sec) - greatest(w.t_start_sec, i.start_sec))) AS overlap_sec
    FROM fx_grid w JOIN fx_interval i ON i.record_id = w.record_id
     AND w.t_end_sec > i.start_sec AND w.t_start_sec < i.end_sec GROUP BY 1, 2"""))
def interval_overlap_seconds(t: Tables):
    """Seconds of each window inside intervals, overlapping intervals counted twice."""
    hits = wn.interval_hits(fx.records(t), fx.intervals(t), fx.SPEC)
    return hits.where("overlap_sec > 0").select("record_id", "window_idx", "overlap_sec")


@query(sql("""
    SELECT DISTINCT w.record_id, w.window_idx FROM fx_grid w JOIN fx_interval i ON i.record_id = w.record_id
    WHERE (w.t_end_sec > i.start_sec - 10800 AND w.t_start_sec < i.start_sec + 10800)
       OR (w.t_end_sec > i.end_sec - 10800 AND w.t_start_sec < i.end_sec + 10800)"""))
def windows_near_boundary(t: Tables):
    """Windows within the guard distance of an onset or offset."""
    hits = wn.interval_hits(fx.records(t), fx.intervals(t), fx.SPEC)
    return hits.where("near_boundary").select("record_id", "window_idx")


@query(sql("""
    SELECT record_id, case_id, subject_id, window_idx, t_start_sec, t_end_sec,
      round(overlap_frac, 6) AS overlap_frac, label FROM fx_window"""))
def window_labels(t: Tables):
    """Labelled windows."""
    return fx.windows(t).select(
        "record_id", "case_id", "subject_id", "window_idx", "t_start_sec", "t_end_sec",
        "overlap_frac", "label",
    )


@query(sql("""
    SELECT record_id, window_idx, round(overlap_frac, 6) AS overlap_frac, label FROM fx_window_overlap"""))
def sliding_window_labels(t: Tables):
    """C3 with stride below length."""
    return fx.windows(t, fx.OVERLAPPING_SPEC).select(
        "record_id", "window_idx", "overlap_frac", "label"
    )


DISPUTED = """
    SELECT record_id, start_sec - 20000 AS start_sec, start_sec AS end_sec FROM fx_interval
    WHERE seizure_idx = 2"""


@query(sql("""
    SELECT w.record_id, w.window_idx, CASE WHEN w.label = 1 THEN 1
        WHEN EXISTS (SELECT 1 FROM dx d WHERE d.record_id = w.record_id AND w.t_end_sec > d.start_sec
                     AND w.t_start_sec < d.end_sec) THEN -1 ELSE w.label END AS label
    FROM fx_window w""", dx=DISPUTED))
def disputed_window_labels(t: Tables):
    """Disputed spans become guard before the interictal decision."""
    disputed = fx.intervals(t).where("seizure_idx = 2").select(
        "record_id", (F.col("start_sec") - 20000).alias("start_sec"), F.col("start_sec").alias("end_sec")
    )
    return wn.label_windows(fx.records(t), fx.intervals(t), fx.SPEC, disputed).select(
        "record_id", "window_idx", "label"
    )


@query(sql("""
    SELECT record_id, start_sec, end_sec FROM fx_interval
    WHERE record_id NOT IN (SELECT record_id FROM fx_interval WHERE seizure_idx = 3)
    UNION ALL SELECT record_id, start_sec + 100, end_sec FROM fx_interval WHERE seizure_idx = 3"""))
def resolved_intervals(t: Tables):
    """Records with an override take its intervals instead of their own."""
    iv = fx.intervals(t)
    override = iv.where("seizure_idx = 3").withColumn("start_sec", F.col("start_sec") + 100)
    return wn.resolve_intervals(
        iv.select("record_id", "start_sec", "end_sec"), override
    )


@query(sql("""
    SELECT r.record_id, count(i.record_id) AS n_intervals,
      coalesce(sum(i.end_sec - i.start_sec), 0)::BIGINT AS interval_sec
    FROM fx_record r LEFT JOIN fx_interval i ON i.record_id = r.record_id GROUP BY 1"""))
def record_intervals(t: Tables):
    """C4: each record with its intervals, none by default."""
    per = fx.intervals(t).groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_intervals"),
        F.sum(F.col("end_sec") - F.col("start_sec")).alias("interval_sec"),
    )
    return fx.records(t).select("record_id").join(per, "record_id", "left").fillna(0)


@query(sql("""
    SELECT label, count(*) AS n, count(DISTINCT record_id) AS n_records FROM fx_window
    WHERE label <> -1 GROUP BY 1"""))
def guard_dropped(t: Tables):
    """Rows left after guard windows are dropped."""
    return wn.drop_guard(fx.windows(t)).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("n_records")
    )


@query(sql("""
    SELECT record_id, window_idx, CASE WHEN overlap_frac >= 0.25 THEN 1 WHEN label = -1 THEN -1 ELSE 0 END AS label
    FROM fx_window"""))
def relabelled_windows(t: Tables):
    """Labels at another overlap threshold from the stored fraction."""
    return wn.relabel(fx.windows(t), 0.25).select("record_id", "window_idx", "label")


@query(sql("""
    SELECT f::DOUBLE AS min_overlap_frac, count(*) FILTER (overlap_frac >= f) AS n_positive,
      count(*) FILTER (NOT (label = -1 AND overlap_frac < f)) AS n_windows,
      count(*) FILTER (label = -1 AND overlap_frac < f) AS n_guard,
      round(count(*) FILTER (overlap_frac >= f) / count(*) FILTER (NOT (label = -1 AND overlap_frac < f)), 6) AS positive_rate
    FROM fx_window, (VALUES (0.1), (0.25), (0.5), (0.75)) v(f) GROUP BY f"""))
def overlap_threshold_counts(t: Tables):
    """Class sizes at each overlap threshold."""
    return wn.overlap_sweep(fx.windows(t))


@query(sql("""
    SELECT f::DOUBLE AS min_overlap_frac, count(*) FILTER (overlap_frac >= f) AS n_positive, count(*) AS n_windows
    FROM fx_window, (VALUES (0.1), (0.25), (0.5), (0.75)) v(f) GROUP BY f"""))
def overlap_threshold_positives(t: Tables):
    """D17 without the guard."""
    return wn.overlap_counts(fx.windows(t))


@query(sql("""
    SELECT record_id, label, count(*) AS n FROM fx_window GROUP BY 1, 2"""))
def label_counts_by_record(t: Tables):
    """Label counts per record, held as a map."""
    counts = wn.label_counts(fx.windows(t))
    return counts.select("record_id", F.explode("label_counts").alias("label", "n"))


@query(sql("""
    SELECT record_id, window_idx, score >= 0.25 AS pred FROM fx_score"""))
def threshold_predictions(t: Tables):
    """Score at or above the threshold."""
    return fx.scored(t).select("record_id", "window_idx", "pred")


@query(sql("""
    SELECT record_id, first_idx, last_idx, start_sec, end_sec, n_windows::INTEGER AS n_windows
    FROM fx_run1 WHERE n_windows >= 2"""))
def alarm_runs(t: Tables):
    """Runs of two or more adjacent positive windows."""
    return rn.positive_runs(fx.evaluated(t), 2).select(
        "record_id", "first_idx", "last_idx", "start_sec", "end_sec", "n_windows"
    )


@query(sql("""
    SELECT record_id, first_idx, last_idx, start_sec, end_sec, n_windows::INTEGER AS n_windows
    FROM fx_run_overlap1 WHERE n_windows >= 3"""))
def alarm_runs_sliding(t: Tables):
    """E2 on windows that overlap their neighbours."""
    return rn.positive_runs(fx.evaluated(t, fx.OVERLAPPING_SPEC), 3).select(
        "record_id", "first_idx", "last_idx", "start_sec", "end_sec", "n_windows"
    )


@query(sql("""
    SELECT w.record_id, w.window_idx, EXISTS (SELECT 1 FROM fx_run1 r WHERE r.record_id = w.record_id
      AND r.n_windows >= 2 AND w.t_end_sec > r.start_sec AND w.t_start_sec < r.end_sec) AS in_run
    FROM fx_eval w"""))
def run_mask(t: Tables):
    """Windows that time-overlap a surviving run of their record."""
    return rn.run_mask(fx.evaluated(t), 2).select("record_id", "window_idx", "in_run")


@query(sql("""
    SELECT w.record_id, w.window_idx, EXISTS (SELECT 1 FROM fx_run_overlap1 r WHERE r.record_id = w.record_id
      AND r.n_windows >= 3 AND w.t_end_sec > r.start_sec AND w.t_start_sec < r.end_sec) AS in_run
    FROM fx_eval_overlap w"""))
def run_mask_sliding(t: Tables):
    """E4 where windows overlap: neighbours of a run are marked too."""
    spec = fx.OVERLAPPING_SPEC
    return rn.run_mask(fx.evaluated(t, spec), 3, reach=spec.reach).select(
        "record_id", "window_idx", "in_run"
    )


@query(event_sql("subject_id", "subject_id", 2))
def event_metrics_by_subject(t: Tables):
    """Event metrics per subject at k = 2."""
    return ev.event_metrics(
        fx.stored_evaluated(t), fx.intervals(t), 2, ["subject_id"], fx.durations(t), bin_sec=fx.BIN
    )


@query(event_sql("'all'", None, 1))
def event_metrics_overall(t: Tables):
    """D12-D15 over all records at k = 1."""
    return ev.event_metrics(
        fx.stored_evaluated(t), fx.intervals(t), 1, None, fx.durations(t), bin_sec=fx.BIN
    )


@query(event_sql("subject_id", "subject_id", 3, "fx_run_overlap1", "fx_eval_overlap"))
def event_metrics_sliding(t: Tables):
    """D12-D15 on overlapping windows at k = 3."""
    return ev.event_metrics(
        fx.stored_evaluated(t, fx.OVERLAPPING_SPEC), fx.intervals(t), 3, ["subject_id"],
        fx.durations(t), bin_sec=fx.BIN,
    )


@query(event_sql("w.record_id", "record_id", 1))
def recording_indicators(t: Tables):
    """The same figures for each single recording."""
    frame = fx.stored_evaluated(t).withColumn("recording", F.col("record_id"))
    out = ev.event_metrics(frame, fx.intervals(t), 1, ["recording"], fx.durations(t), bin_sec=fx.BIN)
    return out.withColumnRenamed("recording", "record_id")
