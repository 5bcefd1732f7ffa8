"""Folds with the same training rows share their fits, and pieces of work score what they have grown."""

from pyspark.sql import functions as F

from test_fold_fits import COLUMNS, rows  # noqa: F401
from windrow.operators import fold_fits as ff


def test_folds_with_equal_training_rows_are_fitted_once(rows, monkeypatch):  # noqa: F811
    """Folds 0 and 2 train on the same rows and hold out others; a forest's draws are those of the first."""
    own = [F.col("g") == g for g in ("g0", "g1", "g0")]
    train = F.array(*[~o for o in own])
    held = F.array(*[F.lit(1).cast("tinyint")] * 3)
    fits = [ff.Fit(i, *f) for f in (("rf", (("trees", 3),)), ("hgb", (("rounds", 2),)), ("logreg",)) for i in range(3)]
    seen = []
    real = ff.shared_fits
    monkeypatch.setattr(ff, "shared_fits", lambda facts, fits: seen.append(real(facts, fits)) or seen[-1])
    for size in (None, 70):
        found = ff.fold_scores(rows, COLUMNS, train, held, 3, fits, 7, size=size)
        got = {(r["fit"], r["window_uid"]): (r["fold"], r["score"]) for r in found.collect()}
        assert len(got) == 240 * 9
        for (fit, uid), (fold, score) in got.items():
            assert fold == fit % 3
            if fold == 2:
                assert score == got[fit - 2, uid][1]
        assert any(got[0, u][1] != got[1, u][1] for f, u in got if f == 0)
    assert seen == [{k: [k, k + 2] if k % 3 == 0 else [k] for k in range(9) if k % 3 < 2}] * 2
