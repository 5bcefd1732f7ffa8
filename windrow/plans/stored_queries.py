"""Queries: results and models written to tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from windrow.operators import metrics as mt
from windrow.operators import shipped as sh
from windrow.operators import thresholds as th
from windrow.plans import fixtures as fx
from windrow.plans.catalog import ORACLES, query
from windrow.plans.fixtures import Tables, sql
from windrow.plans.learning import COLUMNS, rows
from windrow.plans.reports import DETAIL, METRICS, detail
from windrow.session import shared_folder
from windrow.sources import sinks


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/windrow-{name}-{uuid.uuid4().hex}"


@query(ORACLES["threshold_sweep"])
def stored_sweep(t: Tables):
    """The threshold sweep as a result table, read back."""
    path = _folder(t, "sweep")
    sinks.write_table(th.threshold_sweep(fx.stored_evaluated(t), fx.intervals(t), 2, bin_sec=fx.BIN), path)
    return t.spark.read.parquet(path)


@query(sql("SELECT record_id, window_idx, label, round(score, 6) AS score FROM fx_eval"))
def stored_window_scores(t: Tables):
    """Window scores as a table by case, read back."""
    path = _folder(t, "scores")
    sinks.overwrite_parts(fx.evaluated(t).select("record_id", "window_idx", "label", "score", "case_id"), path, ["case_id"])
    return sinks.read_features(t.spark, path).select("record_id", "window_idx", "label", "score")


@query(sql(" UNION ALL ".join(
    f"SELECT model, substr(test_subject, 2)::INTEGER AS fold_idx, '{m}' AS metric_name, round({m}::DOUBLE, 6) AS metric_value FROM dt WHERE {m} IS NOT NULL"
    for m in METRICS), **DETAIL))
def stored_run_log(t: Tables):
    """Metric rows of a run by fold; a fold logged again replaces its rows, undefined values are left out."""
    path = _folder(t, "runs")
    found = t.keep("detail", lambda: detail(t)).withColumn("fold_idx", F.substring("test_subject", 2, 9).cast("int"))
    long = mt.long_form(found, ["model", "fold_idx"], METRICS)
    sinks.log_metrics(long.withColumn("metric_value", F.lit(-1.0)), path, "r1")
    sinks.log_metrics(long, path, "r1")
    return sinks.read_run(t.spark, path, "r1").select("model", "fold_idx", "metric_name", "metric_value")


#: A stored model of two small trees, by hand: (at, root, feature, cut, absent_left, left, value).
TREES = [
    (0, True, 0, 0.05, True, 1, 0.0), (1, False, 3, -0.02, False, 3, 0.0), (2, False, -1, None, False, -1, 0.4),
    (3, False, -1, None, False, -1, -0.7), (4, False, -1, None, False, -1, 0.15),
    (5, True, 63, 0.0, False, 6, 0.0), (6, False, -1, None, False, -1, -0.25), (7, False, -1, None, False, -1, 0.3),
]


@query(sql("""
    SELECT vec_id, label, round(1 / (1 + exp(-(-1.5 + CASE WHEN f0 IS NULL OR f0 <= 0.05
        THEN CASE WHEN f3 <= -0.02 THEN -0.7 ELSE 0.15 END ELSE 0.4 END + CASE WHEN f63 <= 0 THEN -0.25 ELSE 0.3 END))), 6) AS score
    FROM (SELECT * REPLACE (CASE WHEN vec_id % 11 = 0 THEN NULL ELSE f0 END AS f0) FROM fx_ml)"""))
def stored_model_scores(t: Tables):
    """A stored tree model as a column expression over rows with absent values."""
    path = _folder(t, "model")
    t.spark.createDataFrame(TREES, sh.NODES).write.parquet(f"{path}/nodes")
    facts = [(sh.VERSION, "hgb", -1.5, 2, COLUMNS, [0.0] * len(COLUMNS), "abc", 0)]
    t.spark.createDataFrame(facts, sh.FACTS).write.parquet(f"{path}/facts")
    gaps = rows(t).withColumn("f0", F.when(F.col("vec_id") % 11 != 0, F.col("f0"))).select("vec_id", "label", *COLUMNS)
    return sh.score_with(gaps, path, "abc")
