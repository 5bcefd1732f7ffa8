"""Queries: models and evaluation protocols. Fits have no SQL twin; the rows are checked."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from windrow.config import Settings, Splits, Training, Windowing
from windrow.fixed_values import OVERLAP_FRACTIONS
from windrow.operators import models as md
from windrow.operators import runs as rn
from windrow.operators import splits as sp
from windrow.plans import fixtures as fx
from windrow.plans.catalog import query
from windrow.plans.fixtures import Tables, sql
from windrow.plans.splits_ledger import ring_views

COLUMNS = [f"f{i}" for i in range(fx.VALUES)]
SETTINGS = Settings(
    windowing=Windowing(10.0, 10.0, 0.5, 30.0, sample_rate=1),
    splits=Splits(n_val_subjects=3),
    training=Training(),
)


def rows(t: Tables):
    """Learning rows as consecutive windows of one record per group, with an overlap fraction."""
    idx = F.floor(F.col("vec_id") / 12).cast("int")
    return fx.learning_rows(t).withColumns(
        {
            "record_id": F.col("subject_id"),
            "window_idx": idx,
            "t_start_sec": idx * 10.0,
            "t_end_sec": idx * 10.0 + 10.0,
            "overlap_frac": F.abs("f0"),
        }
    )


def distinct_rows(t: Tables):
    """Learning rows without exact repeats of a vector, which the protocols refuse."""
    marked = sp.mark_repeats(rows(t).withColumns({"row_index": F.col("vec_id"), "row_hash": vector_hash()}))
    return marked.where(~F.col("is_repeat")).drop("row_index", "row_hash", "is_repeat")


def vector_hash():
    return F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in COLUMNS]))


def truth(t: Tables):
    """Intervals: the stretches of positive rows."""
    from windrow.operators.labels import enumerate_intervals

    found = rn.positive_runs(rows(t).withColumn("pred", F.col("label") == 1), 1)
    return enumerate_intervals(found.select("record_id", "start_sec", "end_sec"))


@query(sql("""
    SELECT fold_idx, vec_id, CASE WHEN 2 * (tp - coalesce(hp, 0)) > tn - coalesce(hn, 0) + tp - coalesce(hp, 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS score
    FROM held JOIN fx_ml m ON m.subject_id = held.g AND held.role = 'test',
      (SELECT count(*) FILTER (label = 1) AS tp, count(*) AS tn FROM fx_ml) JOIN
      (SELECT fold_idx AS f, count(*) FILTER (label = 1) AS hp, count(*) AS hn FROM held h JOIN fx_ml x ON x.subject_id = h.g GROUP BY 1) q ON TRUE
    WHERE q.f = fold_idx""".replace("tn - coalesce(hn, 0) + tp - coalesce(hp, 0)", "tn - coalesce(hn, 0)"),
    **ring_views("fx_ml", "subject_id", 3)))
def majority_model(t: Tables):
    """Majority-class scores of each fold's test rows."""
    frame = rows(t)
    folds = sp.held_out(frame, "subject_id", 3, 42)
    one = replace(SETTINGS, training=replace(SETTINGS.training, models=("dummy",), negative_downsample_ratio=None))
    return md.score_folds(frame, COLUMNS, one, folds).where("role = 'test'").select("fold_idx", "vec_id", "score")


@query()
def logistic_scores(t: Tables):
    """Logistic regression scores."""
    frame = rows(t)
    return md.in_sample_scores("logreg", frame, COLUMNS, 42).select("vec_id", "label", "score")


@query()
def forest_scores(t: Tables):
    """Random forest scores."""
    frame = rows(t)
    return md.in_sample_scores("rf", frame, COLUMNS, 42).select("vec_id", "label", "score")


@query()
def boosted_scores(t: Tables):
    """Gradient boosting scores."""
    frame = rows(t)
    return md.in_sample_scores("hgb", frame, COLUMNS, 42).select("vec_id", "label", "score")


@query()
def grid_search(t: Tables):
    """The best regularisation by grouped inner folds."""
    params, score = md.search("logreg", rows(t), COLUMNS)
    return t.spark.createDataFrame([("logreg", float(params["C"]), float(score))], "model string, C double, score double")


@query()
def grouped_evaluation(t: Tables):
    """Leave-one-subject-out evaluation."""
    return md.grouped_evaluation(distinct_rows(t), COLUMNS, SETTINGS, truth(t))


@query()
def event_selected_evaluation(t: Tables):
    """The same with fold scores by event F2 instead of window F2."""
    tr = replace(SETTINGS.training, models=("dummy", "logreg"), select_on="event_f2")
    return md.grouped_evaluation(distinct_rows(t), COLUMNS, replace(SETTINGS, training=tr), truth(t))


@query()
def random_window_evaluation(t: Tables):
    """The contrast that ignores subjects."""
    return md.random_window_evaluation(distinct_rows(t), COLUMNS, SETTINGS)


@query()
def exported_scores(t: Tables):
    """Held-out scores of two subjects with their operating points."""
    return md.export_scores(rows(t), COLUMNS, SETTINGS, ["g03", "g07"], "logreg")


@query(sql("""
    SELECT 'logreg' AS model, 12::BIGINT AS n_subjects, count(*) AS n_rows_available,
      count(*) FILTER (label = 1) + least(count(*) FILTER (label = 0), 3 * count(*) FILTER (label = 1)) AS n_rows_fitted,
      64 AS n_features FROM fx_ml"""))
def final_model(t: Tables):
    """Metadata of the model fitted on every subject."""
    three = replace(SETTINGS, training=replace(SETTINGS.training, negative_downsample_ratio=3))
    _, meta = md.final_fit(rows(t), COLUMNS, three, "logreg")
    return meta.select("model", "n_subjects", "n_rows_available", "n_rows_fitted", "n_features")


@query()
def overlap_model_sweep(t: Tables):
    """One model at every overlap threshold."""
    return md.overlap_model_sweep(distinct_rows(t), COLUMNS, SETTINGS, truth(t), OVERLAP_FRACTIONS, "logreg")


@query()
def leakage_study(t: Tables):
    """Four protocols of out-of-fold scores."""
    frame = rows(t).withColumns({"row_index": F.col("vec_id"), "row_hash": vector_hash()})
    frame = sp.pseudo_records(sp.mark_repeats(frame))
    return md.leakage_study(frame, COLUMNS, list(SETTINGS.training.models), 42)
