"""Stored models as column expressions against the fits they come from."""

import pytest
from pyspark.sql import functions as F

from test_fold_fits import COLUMNS, rows, scores  # noqa: F401
from windrow.operators import fold_fits as ff
from windrow.operators import shipped as sh


@pytest.mark.parametrize("name,params", [
    ("hgb", {"rounds": 4, "max_leaf_nodes": 7}), ("rf", {"trees": 30, "max_depth": 5}), ("logreg", {"C": 0.3}), ("dummy", {}),
])
def test_stored_model_scores_as_it_was_fitted(spark, rows, tmp_path, name, params):  # noqa: F811
    every = F.array(F.lit(True)), F.array(F.lit(1).cast("tinyint"))
    fit = ff.Fit(0, name, tuple(params.items()))
    want = {r["window_uid"]: r["score"] for r in ff.fold_scores(rows, COLUMNS, *every, 1, [fit], 5).collect()}
    sh.ship(rows, COLUMNS, name, 5, "abc", str(tmp_path), params=params)
    out = sh.score_with(rows, str(tmp_path), "abc")
    got = {r["window_uid"]: r["score"] for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and not set(COLUMNS) & set(out.columns)


def test_a_model_of_other_features_is_refused(spark, rows, tmp_path):  # noqa: F811
    sh.ship(rows, COLUMNS, "logreg", 5, "abc", str(tmp_path))
    with pytest.raises(ValueError, match="extraction_mismatch"):
        sh.score_with(rows, str(tmp_path), "abd")
    with pytest.raises(ValueError, match="schema_mismatch"):
        sh.score_with(rows.drop("f1"), str(tmp_path), "abc")
