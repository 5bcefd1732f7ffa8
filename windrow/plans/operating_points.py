"""Queries: window metrics, exact thresholds, the k rule, sweeps, flagged segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.operators import events as ev
from windrow.operators import metrics as mt
from windrow.operators import ranking as rk
from windrow.operators import runs as rn
from windrow.operators import thresholds as th
from windrow.plans import fixtures as fx
from windrow.plans.catalog import query
from windrow.plans.fixtures import Tables, sql
from windrow.plans.windows_events import event_sql


def counts_sql(frame: str, key: str, pred: str) -> str:
    return f"""
        SELECT {key}, count(*) FILTER (label = 1 AND {pred}) AS tp,
          count(*) FILTER (label <> 1 AND {pred}) AS fp,
          count(*) FILTER (label = 1 AND NOT {pred}) AS fn,
          count(*) FILTER (label <> 1 AND NOT {pred}) AS tn FROM {frame} GROUP BY 1"""


def ratios_sql(suffix: str = "") -> str:
    return f"""
        round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision{suffix},
        round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall{suffix},
        round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1{suffix},
        round(coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0), 6) AS f2{suffix},
        round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy{suffix}"""


def ranking_views(frame: str, key: str) -> dict[str, str]:
    """Tie blocks with cumulative counts, as ``rk_block``; areas as ``rk_area``."""
    return {
        "rk_block": f"""
            SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
              sum(pos) OVER (PARTITION BY key_id) AS P, sum(neg) OVER (PARTITION BY key_id) AS N,
              count(*) OVER (PARTITION BY key_id) AS n_scores,
              lead(score) OVER (PARTITION BY key_id ORDER BY score DESC) AS next_score
            FROM (SELECT {key} AS key_id, score, count(*) FILTER (label = 1) AS pos,
                    count(*) FILTER (label <> 1) AS neg FROM {frame} GROUP BY 1, 2)
            WINDOW w AS (PARTITION BY key_id ORDER BY score DESC)""",
        "rk_area": """
            SELECT key_id, CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos / P * (tp / (tp + fp))) END AS pr_auc,
              CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(neg * (tp - pos / 2)) / (max(P) * max(N)) END AS roc_auc
            FROM rk_block GROUP BY 1""",
    }


def window_metrics_sql(frame: str, key: str, source: str, thr: float) -> str:
    return sql(f"""
        SELECT c.{key}, '{source}' AS source, {thr}::DOUBLE AS threshold, tp, fp, fn, tn,
          tp + fp + fn + tn AS n, tp + fn AS n_pos, round((tp + fn) / (tp + fp + fn + tn), 6) AS pos_rate,
          {ratios_sql()}, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc
        FROM ({counts_sql(frame, key, f"score >= {thr}")}) c JOIN rk_area a ON a.key_id = c.{key}""",
        **ranking_views(frame, key))


@query(window_metrics_sql("fx_eval", "subject_id", "events", 0.25))
def window_metrics_by_subject(t: Tables):
    """Confusion counts, ratios, average precision and ROC area."""
    return mt.window_metrics(fx.stored_evaluated(t), ["subject_id"], fx.THRESHOLD)


@query(window_metrics_sql("fx_scored_doc", "group_id", "documents", 0.1))
def window_metrics_documents(t: Tables):
    """D6-D10 on scores with ties."""
    return mt.window_metrics(fx.scored_documents(t), ["group_id"], 0.1)


@query(sql(f"""
    SELECT half, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn,
      sum(tp + fp + fn + tn)::BIGINT AS n,
      {ratios_sql('_pooled').replace('tp', 'sum(tp)').replace('fp', 'sum(fp)').replace('fn', 'sum(fn)').replace('tn', 'sum(tn)')}
    FROM (SELECT subject_id, CASE WHEN subject_id < 's12' THEN 'a' ELSE 'b' END AS half, tp, fp, fn, tn
      FROM ({counts_sql('fx_eval', 'subject_id', 'pred')})) GROUP BY 1"""))
def pooled_metrics(t: Tables):
    """Ratios from counts summed over folds."""
    per = fx.evaluated(t).groupBy("subject_id").agg(
        *mt.confusion_columns(F.col("label"), F.col("pred"))
    )
    half = F.when(F.col("subject_id") < "s12", "a").otherwise("b")
    return mt.pooled_window_metrics(per.withColumn("half", half), ["half"])


def threshold_sql(frame: str, key: str, b2: int) -> str:
    return sql(f"""
        SELECT key_id AS {key},
          round(CASE WHEN P > 0 AND n_scores > 1 THEN coalesce((score + next_score) / 2, score) ELSE 0.5 END, 6) AS threshold,
          round(CASE WHEN P > 0 AND n_scores > 1 THEN f ELSE 0 END, 6) AS achieved
        FROM (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY f DESC, score DESC) AS rn FROM (
          SELECT *, CASE WHEN tp > 0 THEN ({1 + b2} * tp) / ({1 + b2} * tp + {b2} * (P - tp) + fp) ELSE 0 END AS f FROM rk_block))
        WHERE rn = 1""", **ranking_views(frame, key))


@query(threshold_sql("fx_eval", "subject_id", 4))
def best_f2_threshold(t: Tables):
    """Exact F2 threshold per subject."""
    return th.pick_threshold(fx.evaluated(t), ["subject_id"])


@query(threshold_sql("fx_scored_doc", "group_id", 1))
def best_f1_threshold_documents(t: Tables):
    """E8 for F1 on scores with ties."""
    return th.pick_threshold(fx.scored_documents(t), ["group_id"], "f1")


def f2_of(tp: str, marked: str, pos: str) -> str:
    """F2 from true positives, marked windows and positives."""
    return (
        f"CASE WHEN {tp} > 0 THEN (5 * {tp}) / (5 * {tp} + 4 * ({pos} - {tp}) + {marked} - {tp}) ELSE 0 END"
    )


def pick_k_sql(frame: str, runs: str) -> str:
    return sql(f"""
        SELECT subject_id, k AS best_k, round(f2, 6) AS f2 FROM (
          SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY f2 DESC, k) AS rn FROM (
            SELECT subject_id, k, {f2_of('tp', 'marked', 'pos')} AS f2 FROM (
              SELECT subject_id, k, count(*) FILTER (label = 1) AS pos, count(*) FILTER (hit) AS marked,
                count(*) FILTER (hit AND label = 1) AS tp
              FROM (SELECT w.subject_id, w.label, k::INTEGER AS k, EXISTS (SELECT 1 FROM {runs} r
                      WHERE r.record_id = w.record_id AND r.n_windows >= k
                        AND w.t_end_sec > r.start_sec AND w.t_start_sec < r.end_sec) AS hit
                    FROM {frame} w, (VALUES (1), (2), (3)) v(k)) GROUP BY 1, 2)))
        WHERE rn = 1""")


@query(pick_k_sql("fx_eval", "fx_run1"))
def best_k(t: Tables):
    """K with the best F2 of the run mask at a fixed threshold."""
    return th.pick_k(fx.stored_evaluated(t), ["subject_id"], fx.THRESHOLD, [1, 2, 3])


@query(pick_k_sql("fx_eval_overlap", "fx_run_overlap1"))
def best_k_sliding(t: Tables):
    """E9 where windows overlap."""
    spec = fx.OVERLAPPING_SPEC
    return th.pick_k(
        fx.stored_evaluated(t, spec), ["subject_id"], fx.THRESHOLD, [1, 2, 3], spec.reach
    )


def quantile_views(frame: str, key: str, probs: list[float]) -> dict[str, str]:
    """Linear-interpolated quantiles from ranks, as ``qt_value (key_id, i, v, top)``."""
    listed = ", ".join(f"({i}, {p!r}::DOUBLE)" for i, p in enumerate(probs))
    return {
        "qt_rank": f"""
            SELECT {key} AS key_id, score, row_number() OVER (PARTITION BY {key} ORDER BY score) - 1 AS r,
              count(*) OVER (PARTITION BY {key}) AS n FROM {frame}""",
        "qt_value": f"""
            SELECT k.key_id, i, a.score + (b.score - a.score) * (pt - floor(pt)) AS v, top
            FROM (SELECT key_id, i, p * (n - 1) AS pt, top FROM
                   (SELECT key_id, max(n) AS n, max(score) AS top FROM qt_rank GROUP BY 1),
                   (VALUES {listed}) v(i, p)) k
            JOIN qt_rank a ON a.key_id = k.key_id AND a.r = floor(pt)
            JOIN qt_rank b ON b.key_id = k.key_id AND b.r = ceil(pt)""",
    }


GRID24 = rk.linspace(0.0, 1.0, 24)
GRID60 = rk.linspace(0.50, 0.9995, 60)


@query(sql("SELECT key_id AS subject_id, i, round(v, 6) AS v FROM qt_value",
           **quantile_views("fx_eval", "subject_id", GRID24)))
def score_quantiles(t: Tables):
    """The quantile grid of the scores."""
    q = rk.quantiles(fx.evaluated(t), ["subject_id"], 0.0, 1.0, 24)
    return q.select("subject_id", F.posexplode("q").alias("i", "v"))


JOINT_VIEWS = {
    **quantile_views("fx_eval", "subject_id", GRID24),
    "jt_cand": """
        SELECT DISTINCT key_id, v AS thr FROM qt_value q
        WHERE v < top OR (SELECT count(DISTINCT v) FROM qt_value o WHERE o.key_id = q.key_id) = 1""",
    "jt_run": """
        SELECT key_id, thr, record_id, count(*) AS len, count(*) FILTER (label = 1) AS pos FROM (
          SELECT key_id, thr, w.record_id, label, window_idx - row_number() OVER (
              PARTITION BY thr, w.record_id ORDER BY window_idx) AS g
          FROM fx_eval w JOIN jt_cand c ON c.key_id = w.subject_id AND w.score >= c.thr)
        GROUP BY key_id, thr, record_id, g""",
    "jt_class": """
        SELECT subject_id AS key_id, count(*) FILTER (label = 1) AS P, count(*) FILTER (label <> 1) AS N
        FROM fx_eval GROUP BY 1""",
    "jt_try": f"""
        SELECT key_id, thr, k, P, N, {f2_of('tp', 'marked', 'P')} AS f2 FROM (
          SELECT c.key_id, c.thr, k::INTEGER AS k, any_value(P) AS P, any_value(N) AS N,
            coalesce(sum(len) FILTER (len >= k), 0) AS marked, coalesce(sum(r.pos) FILTER (len >= k), 0) AS tp
          FROM jt_cand c JOIN jt_class p USING (key_id) CROSS JOIN (VALUES (1), (2), (3)) v(k)
          LEFT JOIN jt_run r ON r.key_id = c.key_id AND r.thr = c.thr GROUP BY 1, 2, 3)""",
}


@query(sql("""
    SELECT key_id AS subject_id,
      round(CASE WHEN P > 0 AND N > 0 THEN thr ELSE 0.5 END, 6) AS threshold,
      CASE WHEN P > 0 AND N > 0 THEN k ELSE 1 END AS best_k,
      round(CASE WHEN P > 0 AND N > 0 THEN f2 END, 6) AS f2
    FROM (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY f2 DESC, k, thr) AS rn FROM jt_try)
    WHERE rn = 1""", **JOINT_VIEWS))
def joint_threshold_and_k(t: Tables):
    """Threshold and k chosen together on the run mask."""
    return th.pick_threshold_and_k(fx.stored_evaluated(t), ["subject_id"], [1, 2, 3])


@query(event_sql("subject_id", "subject_id", 2, tail="""
    , round(CASE WHEN n_true_events > 0 THEN
        (CASE WHEN n_detected > 0 THEN 5 * n_detected / (5 * n_detected + 4 * (n_true_events - n_detected) + false_alarms) ELSE 0 END)
        * greatest(0, 1 - time_in_alarm_frac) END, 6) AS event_f2"""))
def validation_event_scores(t: Tables):
    """Event F2 scaled by the time not in alarm."""
    metrics = ev.event_metrics(
        fx.stored_evaluated(t), fx.intervals(t), 2, ["subject_id"], fx.durations(t), bin_sec=fx.BIN
    )
    return ev.validation_event_score(metrics)


SWEEP_VIEWS = {
    **quantile_views("fx_eval", "record_id", GRID60),
    "sw_cand": "SELECT DISTINCT key_id AS record_id, v AS thr FROM qt_value",
    "sw_run": """
        SELECT record_id, thr, min(t_start_sec) AS s, max(t_end_sec) AS e FROM (
          SELECT w.record_id, thr, t_start_sec, t_end_sec, window_idx - row_number() OVER (
              PARTITION BY thr, w.record_id ORDER BY window_idx) AS g
          FROM fx_eval w JOIN sw_cand c ON c.record_id = w.record_id AND w.score >= c.thr)
        GROUP BY record_id, thr, g HAVING count(*) >= 2""",
}


@query(sql("""
    SELECT c.record_id, round(c.thr, 6) AS threshold, coalesce(segments, 0) AS segments,
      round(coalesce(alarm, 0) / dur, 6) AS time_in_alarm, coalesce(detected, 0) AS detected,
      coalesce(fa, 0) AS false_alarms
    FROM sw_cand c JOIN (SELECT record_id, max(t_end_sec) AS dur FROM fx_eval GROUP BY 1) d USING (record_id)
    LEFT JOIN (SELECT record_id, thr, count(*) AS segments, sum(e - s) AS alarm, count(*) FILTER (NOT hit) AS fa
      FROM (SELECT *, EXISTS (SELECT 1 FROM fx_interval i WHERE i.record_id = r.record_id AND r.e > i.start_sec
              AND r.s < i.end_sec) AS hit FROM sw_run r) GROUP BY 1, 2) a
      ON a.record_id = c.record_id AND a.thr = c.thr
    LEFT JOIN (SELECT record_id, thr, count(DISTINCT seizure_idx) AS detected FROM sw_run r JOIN fx_interval i
        USING (record_id) WHERE r.e > i.start_sec AND r.s < i.end_sec GROUP BY 1, 2) h
      ON h.record_id = c.record_id AND h.thr = c.thr""", **SWEEP_VIEWS))
def threshold_sweep(t: Tables):
    """Segments, time in alarm, detections and false alarms along the score quantiles."""
    return th.threshold_sweep(fx.stored_evaluated(t), fx.intervals(t), 2, bin_sec=fx.BIN)


@query(sql("""
    SELECT d.record_id, k::INTEGER AS k,
      (SELECT count(*) FROM fx_run1 r WHERE r.record_id = d.record_id AND r.n_windows >= k) AS segments,
      round(coalesce((SELECT sum(end_sec - start_sec) FROM fx_run1 r WHERE r.record_id = d.record_id
        AND r.n_windows >= k), 0) / dur, 6) AS time_in_alarm,
      (SELECT count(DISTINCT seizure_idx) FROM fx_run1 r JOIN fx_interval i USING (record_id)
        WHERE r.record_id = d.record_id AND r.n_windows >= k AND r.end_sec > i.start_sec
          AND r.start_sec < i.end_sec) AS detected,
      (SELECT count(*) FROM fx_run1 r WHERE r.record_id = d.record_id AND r.n_windows >= k AND NOT EXISTS (
        SELECT 1 FROM fx_interval i WHERE i.record_id = r.record_id AND r.end_sec > i.start_sec
          AND r.start_sec < i.end_sec)) AS false_alarms
    FROM (SELECT record_id, max(t_end_sec) AS dur FROM fx_eval GROUP BY 1) d,
      (VALUES (1), (2), (3), (4), (5)) v(k)"""))
def k_sweep(t: Tables):
    """The same figures for k = 1..5 at the fixed threshold."""
    return th.k_sweep(fx.stored_evaluated(t), fx.intervals(t), fx.THRESHOLD, bin_sec=fx.BIN)


@query(sql("""
    SELECT r.record_id, r.first_idx,
      printf('%02d:%02d', (r.start_sec // 60)::BIGINT, (r.start_sec % 60)::BIGINT) AS start_clock,
      printf('%02d:%02d', (r.end_sec // 60)::BIGINT, (r.end_sec % 60)::BIGINT) AS end_clock,
      r.end_sec - r.start_sec AS seconds, r.n_windows::INTEGER AS n_windows,
      round((SELECT max(score) FROM fx_eval w WHERE w.record_id = r.record_id
        AND w.window_idx BETWEEN r.first_idx AND r.last_idx), 6) AS peak_score,
      CASE WHEN EXISTS (SELECT 1 FROM fx_interval i WHERE i.record_id = r.record_id AND r.end_sec > i.start_sec
        AND r.start_sec < i.end_sec) THEN 'yes' ELSE 'no' END AS overlaps_annotation
    FROM fx_run1 r WHERE r.n_windows >= 2"""))
def flagged_segments(t: Tables):
    """F8: flagged segments with clock times, peak score and overlap with annotations."""
    frame = fx.stored_evaluated(t)
    return ev.flagged_segments(frame, rn.positive_runs(frame, 2), fx.intervals(t), fx.BIN)
