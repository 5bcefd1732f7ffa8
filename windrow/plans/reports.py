"""Queries: report tables over scored windows of several models.

The scores come from the tables by rule, so that every table has an exact SQL twin: ``peak`` is
the window score, ``root`` its square root, ``dummy`` always 0.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.operators import events as ev
from windrow.operators import metrics as mt
from windrow.operators import report as rp
from windrow.operators import thresholds as th
from windrow.operators import windows as wn
from windrow.plans import fixtures as fx
from windrow.plans.catalog import query
from windrow.plans.fixtures import CTES, Tables, sql
from windrow.plans.operating_points import JOINT_VIEWS, counts_sql, ranking_views, ratios_sql
from windrow.plans.windows_events import EVENT_SQL

MODELS = "(VALUES ('peak'), ('root'), ('dummy')) v(model)"
SCORE_OF = "CASE model WHEN 'peak' THEN score WHEN 'root' THEN sqrt(score) ELSE 0 END"
CTES["fx_model"] = f"""
    SELECT * REPLACE ({SCORE_OF} AS score, {SCORE_OF} >= 0.25 AS pred), model || '|' || subject_id AS mk
    FROM fx_eval, {MODELS}"""
CTES["fx_model_overlap"] = CTES["fx_model"].replace("fx_eval", "fx_eval_overlap")
for _name in ("fx_model", "fx_model_overlap"):
    CTES[f"{_name}_run"] = f"""
        SELECT mk, record_id, min(window_idx) AS first_idx, min(t_start_sec) AS start_sec,
          max(t_end_sec) AS end_sec, count(*) AS n_windows
        FROM (SELECT *, window_idx - row_number() OVER (PARTITION BY mk, record_id ORDER BY window_idx) AS g
              FROM {_name} WHERE pred) GROUP BY mk, record_id, g"""


def by_model(frame):
    """Each window once per scoring rule."""
    s = F.col("score")
    rules = F.array(
        F.struct(F.lit("peak").alias("model"), s.alias("s")),
        F.struct(F.lit("root").alias("model"), F.sqrt(s).alias("s")),
        F.struct(F.lit("dummy").alias("model"), F.lit(0.0).alias("s")),
    )
    out = frame.select("*", F.inline(rules)).drop("score", "pred").withColumnRenamed("s", "score")
    return out.withColumn("pred", F.col("score") >= fx.THRESHOLD)


KEYS = ["model", "subject_id"]


def detail(t: Tables, spec=fx.SPEC):
    """Fold detail: a subject's windows under each rule are the test rows of its fold."""
    frame = by_model(fx.stored_evaluated(t, spec))
    windows = mt.window_metrics(frame, KEYS, fx.THRESHOLD)
    events = ev.event_metrics(frame, fx.intervals(t), 2, KEYS, fx.durations(t), bin_sec=fx.BIN)
    return rp.fold_detail(windows, events, KEYS).withColumn("test_subject", F.col("subject_id"))


def detail_views(frame: str = "fx_model", prefix: str = "") -> dict[str, str]:
    """Views ending in ``dt``: the fold detail in SQL."""
    views = {
        n: v.replace("{key}", "mk").replace("{k}", "2").replace("{runs}", f"{frame}_run").replace("{frame}", frame)
        for n, v in EVENT_SQL.items()
    }
    views.update(ranking_views(frame, "mk"))
    views["dt"] = f"""
        SELECT split_part(c.mk, '|', 1) AS model, split_part(c.mk, '|', 2) AS test_subject, 0.25::DOUBLE AS threshold,
          c.*, tp + fp + fn + tn AS n, tp + fn AS n_pos, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
          coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0) AS f2,
          (tp + tn) / (tp + fp + fn + tn) AS accuracy, pr_auc, roc_auc, e.* EXCLUDE (key_id)
        FROM ({counts_sql(frame, 'mk', 'pred')}) c JOIN rk_area a ON a.key_id = c.mk JOIN ex_event e ON e.key_id = c.mk"""
    if not prefix:
        return views
    import re

    names = "|".join(views)
    return {prefix + n: re.sub(rf"\b({names})\b", prefix + r"\1", v) for n, v in views.items()}


DETAIL = detail_views()
TABLE_SQL = f"""
    SELECT model, folds, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(precision, 6) AS precision,
      round(recall, 6) AS recall, round(f2, 6) AS f2, round(accuracy, 6) AS accuracy, tp, fp, fn, tn,
      n_detected, n_true_events, false_alarms, round(interictal_hours, 6) AS interictal_hours,
      round(alarm_hours, 6) AS alarm_hours, round(evaluated_hours, 6) AS evaluated_hours,
      round(median_latency_sec, 6) AS median_latency_sec, threshold_min, threshold_max,
      {ratios_sql('_pooled')},
      round(n_detected / nullif(n_true_events, 0), 6) AS event_sensitivity,
      round(false_alarms / nullif(interictal_hours, 0), 6) AS fa_per_hour,
      round(alarm_hours / nullif(evaluated_hours, 0), 6) AS time_in_alarm_frac
    FROM (SELECT model, count(*) AS folds, avg(pr_auc) AS pr_auc, avg(roc_auc) AS roc_auc, avg(precision) AS precision,
        avg(recall) AS recall, avg(f2) AS f2, avg(accuracy) AS accuracy, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp,
        sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, sum(n_detected)::BIGINT AS n_detected,
        sum(n_true_events)::BIGINT AS n_true_events, sum(false_alarms)::BIGINT AS false_alarms,
        sum(interictal_hours) AS interictal_hours, sum(alarm_hours) AS alarm_hours,
        sum(evaluated_hours) AS evaluated_hours, median(median_latency_sec) AS median_latency_sec,
        min(threshold) AS threshold_min, max(threshold) AS threshold_max FROM dt GROUP BY 1)"""


@query(sql(TABLE_SQL, **DETAIL))
def model_table(t: Tables):
    """Fold means beside pooled ratios, per model."""
    return rp.model_table(detail(t))


@query(sql("""
    SELECT model, subject_id, window_idx_sum, n_runs FROM (SELECT model, subject_id, sum(window_idx)::BIGINT AS window_idx_sum, mk FROM fx_model GROUP BY ALL)
    JOIN (SELECT mk, count(*) AS n_runs FROM fx_model_run WHERE n_windows >= 2 GROUP BY 1) USING (mk)"""))
def runs_by_model_and_subject(t: Tables):
    """Runs keyed by model and subject in one pass."""
    from windrow.operators.runs import positive_runs

    frame = by_model(fx.stored_evaluated(t))
    runs = positive_runs(frame, 2, KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_runs"))
    return frame.groupBy(*KEYS).agg(F.sum("window_idx").alias("window_idx_sum")).join(runs, KEYS)


@query(sql("""
    SELECT 'peak' AS model, 'designated' AS basis, TRUE AS is_designated,
      (SELECT arg_max(model, v) FROM (SELECT model, avg(f2) AS v FROM dt GROUP BY 1)) AS auto_choice""", **DETAIL))
def headline_model(t: Tables):
    """the model reported first; a designation overrides the validation choice."""
    table = rp.model_table(detail(t)).withColumn("val_score", F.col("f2"))
    return rp.headline(table, "peak")


@query(sql("""
    SELECT test_subject, n, n_pos, round(pr_auc, 6) AS pr_auc, round(recall, 6) AS recall, round(precision, 6) AS precision,
      round(event_sensitivity, 6) AS event_sensitivity, round(fa_per_hour, 6) AS fa_per_hour
    FROM dt WHERE model = 'peak' ORDER BY pr_auc""", **DETAIL))
def subjects_worst_first(t: Tables):
    """subjects of the headline model, lowest PR-AUC first."""
    return rp.per_subject(detail(t), "peak")


@query(sql("""
    SELECT model, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn
    FROM dt WHERE model = 'peak' GROUP BY 1""", **DETAIL))
def confusion_matrix(t: Tables):
    """Pooled confusion matrix of one model."""
    frame = by_model(fx.stored_evaluated(t))
    counts = frame.groupBy(*KEYS).agg(*mt.confusion_columns(F.col("label"), F.col("pred")))
    return rp.confusion(counts, "peak")


@query(sql("SELECT model, round(avg(accuracy), 6) AS accuracy FROM dt WHERE model = 'dummy' GROUP BY 1", **DETAIL))
def majority_accuracy(t: Tables):
    """Accuracy of always predicting the majority class."""
    frame = by_model(fx.stored_evaluated(t)).where("model = 'dummy'")
    counts = frame.groupBy(*KEYS).agg(*mt.confusion_columns(F.col("label"), F.col("pred")))
    return mt.add_window_ratios(counts).groupBy("model").agg(F.avg("accuracy").alias("accuracy"))


def overall(t: Tables, spec=fx.SPEC):
    """The same rows as one set, as a split that ignores subjects sees them."""
    return mt.window_metrics(by_model(fx.stored_evaluated(t, spec)), ["model"], fx.THRESHOLD)


def overall_views(frame: str, prefix: str) -> dict[str, str]:
    views = ranking_views(frame, "model")
    names = {n: prefix + n for n in views}
    out = {}
    for n, v in views.items():
        for old, new in names.items():
            v = v.replace(old, new)
        out[names[n]] = v
    out[f"{prefix}all"] = f"""
        SELECT c.model, pr_auc, coalesce(tp / nullif(tp + fn, 0), 0) AS recall
        FROM ({counts_sql(frame, 'model', 'pred')}) c JOIN {prefix}rk_area a ON a.key_id = c.model"""
    out[f"{prefix}contrast"] = f"""
        SELECT g.model, g.pr AS grouped_pr, g.rec AS grouped_recall, r.pr_auc AS random_pr, r.recall AS random_recall,
          r.pr_auc - g.pr AS delta_pr
        FROM (SELECT model, avg(pr_auc) AS pr, avg(recall) AS rec FROM {{dt}} GROUP BY 1) g JOIN {prefix}all r USING (model)"""
    return out


A_VIEWS = {n: v.replace("{dt}", "dt") for n, v in overall_views("fx_model", "a_").items()}
B_DETAIL = detail_views("fx_model_overlap", "b_")
B_VIEWS = {n: v.replace("{dt}", "b_dt") for n, v in overall_views("fx_model_overlap", "b0_").items()}
ROUND_ALL = "model, round(grouped_pr, 6) AS grouped_pr, round(grouped_recall, 6) AS grouped_recall, round(random_pr, 6) AS random_pr, round(random_recall, 6) AS random_recall, round(delta_pr, 6) + 0.0 AS delta_pr"


@query(sql(f"SELECT {ROUND_ALL} FROM a_contrast", **DETAIL, **A_VIEWS))
def protocol_contrast(t: Tables):
    """C17: grouped means against a split that ignores subjects, by model."""
    return rp.protocol_contrast(detail(t), overall(t))


@query(sql("""
    SELECT p.model, round(x.pr, 6) AS agg_pr, round(y.pr, 6) AS pch_pr, round(p.delta_pr, 6) + 0.0 AS agg_delta,
      round(q.delta_pr, 6) + 0.0 AS pch_delta, CASE WHEN y.pr > x.pr THEN 'per_channel' ELSE 'aggregated' END AS winner
    FROM (SELECT model, avg(pr_auc) AS pr FROM dt GROUP BY 1) x
    JOIN (SELECT model, avg(pr_auc) AS pr FROM b_dt GROUP BY 1) y USING (model)
    JOIN a_contrast p USING (model) JOIN b0_contrast q USING (model) WHERE p.model <> 'dummy'""",
    **DETAIL, **B_DETAIL, **A_VIEWS, **B_VIEWS))
def view_comparison(t: Tables):
    """Two views compared by model (here tumbling and sliding windows)."""
    parts = []
    for view, spec in (("aggregated", fx.SPEC), ("per_channel", fx.OVERLAPPING_SPEC)):
        grouped, everything = detail(t, spec), overall(t, spec)
        tag = lambda df, v=view: df.withColumn("view", F.lit(v))
        means = grouped.groupBy("model").agg(rp.mean("pr_auc").alias("pr_auc"))
        parts.append((tag(means), tag(rp.protocol_contrast(grouped, everything))))
    (a, ca), (b, cb) = parts
    return rp.view_comparison(a.unionByName(b), ca.unionByName(cb))


LEAK_VIEWS = {
    "lk_row": """
        SELECT d.doc_id, d.source AS group_id, l.quality AS label, d.n_chars / 20000.0 AS score,
          row_number() OVER (PARTITION BY md5(d.text) ORDER BY d.doc_id) > 1 AS is_repeat
        FROM documents d JOIN labels l USING (doc_id)""",
    "lk_all": "SELECT group_id, label, score, 'with_duplicates' AS part FROM lk_row UNION ALL SELECT group_id, label, score, 'deduplicated' FROM lk_row WHERE NOT is_repeat",
    "lk_key": "SELECT *, part AS pk, part || '|' || group_id AS gk FROM lk_all",
}
_r, _g = ranking_views("lk_key", "pk"), ranking_views("lk_key", "gk")
LEAK_VIEWS.update({n.replace("rk", "rr"): v.replace("rk_", "rr_") for n, v in _r.items()})
LEAK_VIEWS.update({n.replace("rk", "rg"): v.replace("rk_", "rg_") for n, v in _g.items()})
LEAK_VIEWS["lk_pr"] = """
    SELECT 'random_' || key_id AS protocol, pr_auc FROM rr_area
    UNION ALL SELECT 'grouped_' || split_part(key_id, '|', 1), avg(pr_auc) FROM rg_area GROUP BY 1"""
_of = "(SELECT pr_auc FROM lk_pr WHERE protocol = '{}')".format


@query(sql(f"""
    SELECT 'length' AS model, round(a, 9) AS pr_dup_random, round(b, 9) AS pr_dup_grouped, round(c, 9) AS pr_dedup_random,
      round(d, 9) AS pr_dedup_grouped, round(a - c, 9) + 0.0 AS dedup_effect_random, round(b - d, 9) + 0.0 AS dedup_effect_grouped,
      round(a - b, 9) + 0.0 AS grouping_effect_with_dups, round(c - d, 9) + 0.0 AS grouping_effect_deduped
    FROM (SELECT {_of('random_with_duplicates')} AS a, {_of('grouped_with_duplicates')} AS b,
      {_of('random_deduplicated')} AS c, {_of('grouped_deduplicated')} AS d)""", **LEAK_VIEWS), digits=9)
def leakage_decomposition(t: Tables):
    """Four protocols side by side and what each change costs."""
    from windrow.operators.splits import mark_repeats

    rows = fx.scored_documents(t).join(t.documents.select("doc_id", F.md5("text").alias("row_hash")), "doc_id")
    rows = mark_repeats(rows.withColumnRenamed("doc_id", "row_index"))
    parts = F.array_compact(
        F.array(F.lit("with_duplicates"), F.when(~F.col("is_repeat"), F.lit("deduplicated")))
    )
    rows = rows.withColumn("part", F.explode(parts))
    random = mt.ranking_metrics(rows, ["part"]).select(
        F.concat(F.lit("random_"), "part").alias("protocol"), "pr_auc"
    )
    grouped = (
        mt.ranking_metrics(rows, ["part", "group_id"]).groupBy("part").agg(rp.mean("pr_auc").alias("pr_auc"))
        .select(F.concat(F.lit("grouped_"), "part").alias("protocol"), "pr_auc")
    )
    return rp.leakage_decomposition(random.unionByName(grouped).withColumn("model", F.lit("length")))


OP_VIEWS = {
    **JOINT_VIEWS,
    "op_pick": """
        SELECT key_id, CASE WHEN P > 0 AND N > 0 THEN thr ELSE 0.5 END AS thr, CASE WHEN P > 0 AND N > 0 THEN k ELSE 1 END AS k
        FROM (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY f2 DESC, k, thr) AS rn FROM jt_try) WHERE rn = 1""",
}


@query(sql("""
    SELECT 'peak' AS model, round(median(thr), 6) AS threshold,
      (SELECT k FROM op_pick GROUP BY k ORDER BY count(*) DESC, k LIMIT 1) AS k,
      round(min(thr), 6) AS threshold_min, round(max(thr), 6) AS threshold_max, count(*) AS n_subjects FROM op_pick""",
    **OP_VIEWS))
def operating_point(t: Tables):
    """Median threshold and modal k over folds."""
    frame = fx.stored_evaluated(t)
    picked = th.pick_threshold_and_k(frame, ["subject_id"], [1, 2, 3]).select(
        F.lit("peak").alias("model"), F.col("subject_id").alias("test_subject"), "threshold", F.col("best_k").alias("k"),
        F.lit(0.0).alias("pr_auc"), F.lit(0).alias("n_detected"), F.lit(0).alias("n_true_events"),
        F.lit(0).alias("false_alarms"), F.lit(0.0).alias("interictal_hours"),
    )
    return rp.operating_point(picked, "peak").select(
        "model", "threshold", "k", "threshold_min", "threshold_max", "n_subjects"
    )


@query(sql("""
    SELECT model, sum(n_detected)::BIGINT AS seizures_detected, sum(n_true_events)::BIGINT AS seizures_total,
      round(sum(n_detected) / sum(n_true_events), 6) AS event_sensitivity,
      round(sum(false_alarms) / sum(interictal_hours), 6) AS fa_per_hour, round(avg(pr_auc), 6) AS pr_auc_mean,
      count(*) FILTER (n_detected = 0 AND n_true_events > 0) AS subjects_with_zero_detections
    FROM dt WHERE model = 'root' GROUP BY 1""", **DETAIL))
def held_out_expectation(t: Tables):
    """What the folds say about the model that ships."""
    rows = detail(t).withColumn("k", F.lit(2))
    return rp.operating_point(rows, "root").select(
        "model", "seizures_detected", "seizures_total", "event_sensitivity", "fa_per_hour", "pr_auc_mean",
        "subjects_with_zero_detections",
    )


@query(sql("""
    SELECT model, count(*) AS folds, round(avg(pr_auc), 6) AS pr_auc, round(avg(recall), 6) AS recall,
      round(avg(precision), 6) AS precision, round(sum(n_detected) / sum(n_true_events), 6) AS event_sensitivity
    FROM dt GROUP BY 1""", **DETAIL))
def sweep_summary(t: Tables):
    """NaN-skipping means over folds with pooled event sensitivity, per setting."""
    return rp.sweep_summary(detail(t), "model")


OVERLAP_VIEWS = {
    "ov_row": """
        SELECT f::DOUBLE AS f, (overlap_frac >= f)::INTEGER AS label, score
        FROM fx_score, (VALUES (0.1), (0.25), (0.5), (0.75)) x(f) WHERE label <> -1 OR overlap_frac >= f""",
    **ranking_views("ov_row", "f"),
}


def overlap_scores(t: Tables):
    """Average precision of the same scores under each overlap threshold's labels."""
    frame = wn.at_each_overlap(fx.scored(t))
    return mt.ranking_metrics(frame, ["min_overlap_frac"]).select("min_overlap_frac", "pr_auc")


@query(sql("SELECT key_id AS min_overlap_frac, round(pr_auc, 6) AS pr_auc FROM rk_area", **OVERLAP_VIEWS))
def overlap_precision(t: Tables):
    """Average precision of real scores at each overlap threshold."""
    return overlap_scores(t)


@query(sql("SELECT arg_max(key_id, pr_auc) AS min_overlap_frac FROM rk_area", **OVERLAP_VIEWS))
def best_overlap_threshold(t: Tables):
    """the overlap threshold with the best average precision."""
    return rp.best_setting(overlap_scores(t), "min_overlap_frac")


METRICS = ["precision", "recall", "f2", "pr_auc", "n_detected", "event_sensitivity", "fa_per_hour"]


@query(sql(" UNION ALL ".join(
    f"SELECT model, test_subject, '{m}' AS metric_name, round({m}::DOUBLE, 6) AS metric_value FROM dt WHERE {m} IS NOT NULL"
    for m in METRICS), **DETAIL))
def run_log(t: Tables):
    """Long metric rows without undefined values."""
    return mt.long_form(detail(t), ["model", "test_subject"], METRICS)


@query(sql("SELECT case_id, label, count(*) AS n FROM fx_window GROUP BY 1, 2"))
def windows_by_case_and_label(t: Tables):
    """Windows by case and label."""
    return fx.windows(t).groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT DISTINCT 'abc' AS config_hash, subject_id FROM fx_grid"))
def distinct_config_hashes(t: Tables):
    """Distinct configuration hashes of a stamped table."""
    registry = fx.records(t).select("case_id", "subject_id").distinct()
    records = fx.records(t).select("record_id", "case_id", "n_samples")
    return wn.cut_windows(wn.stamp_keys(records, registry, "abc", "events"), fx.SPEC).select("config_hash", "subject_id").distinct()


@query(sql("""
    SELECT record_id, window_idx, label FROM fx_window WHERE record_id IN (SELECT record_id FROM fx_interval)
    UNION ALL SELECT record_id, window_idx, label FROM fx_window WHERE record_id NOT IN (SELECT record_id FROM fx_interval)
    ORDER BY record_id, window_idx"""))
def concatenated_windows(t: Tables):
    """F1, G1: frames of several sources put together and sorted."""
    w, iv = fx.windows(t).select("record_id", "window_idx", "label"), fx.intervals(t).select("record_id")
    both = w.join(iv, "record_id", "left_semi").unionByName(w.join(iv, "record_id", "left_anti"))
    return both.orderBy("record_id", "window_idx")
