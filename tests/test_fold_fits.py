"""Fits of all folds at once: one block against many, plain boosting, Spark's own regression."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from test_histogram_trees import plain_leaves
from windrow.operators import fold_fits as ff
from windrow.operators import histogram_trees as ht
from windrow.operators import models as md


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for k in range(240):
        y = int(rng.random() < 0.3)
        x = [float(rng.normal() + y), float(rng.normal()), float(rng.integers(0, 4))]
        if rng.random() < 0.15:
            x[0] = None
        if rng.random() < 0.1:
            x[2] = float("nan")
        out.append((f"w{k:04d}", f"g{k % 4}", y, *x, "s"))
    return spark.createDataFrame(out, "window_uid string, g string, label int, f0 double, f1 double, f2 double, source string").persist()


COLUMNS = ["f0", "f1", "f2"]


def arrays(n=4):
    own = [F.col("g") == f"g{i}" for i in range(n)]
    return F.array(*[~o for o in own]), F.array(*[o.cast("tinyint") for o in own])


def scores(rows, fits, size=None, folds=4):
    found = ff.fold_scores(rows, COLUMNS, *arrays(folds), folds, fits, 7, size=size)
    return {(r["fit"], r["window_uid"]): r["score"] for r in found.collect()}


FITS = [
    *[ff.Fit(i, "hgb", (("rounds", 3), ("max_leaf_nodes", 6))) for i in range(4)], *[ff.Fit(i, "rf", (("trees", 3), ("max_depth", 4))) for i in range(2)],
    *[ff.Fit(i, "logreg", (("C", c),)) for i in range(4) for c in (0.1, 10.0)], ff.Fit(1, "dummy"),
]


def test_many_blocks_give_the_scores_of_one(rows):
    one, many = scores(rows, FITS), scores(rows, FITS, size=70)
    assert one.keys() == many.keys() and len(one) == 60 * len(FITS)
    for key, value in one.items():
        assert many[key] == pytest.approx(value, abs=1e-12 if FITS[key[0]].name != "logreg" else 1e-7)


def test_boosting_equals_a_plain_booster(rows):
    """Three rounds by rows and all splits, from the block's own bins."""
    fit = ff.Fit(0, "hgb", (("rounds", 3), ("max_leaf_nodes", 6)))
    got = scores(rows, [fit])
    pdf = rows.toPandas()
    x = pdf[COLUMNS].to_numpy(float)
    edges, _, _ = ff.quantile_edges(rows, COLUMNS)
    bins = np.column_stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)])
    bins[np.isnan(x)] = ff.BINS
    train, y = (pdf["g"] != "g0").to_numpy(), pdf["label"].to_numpy()
    p = ht.Growth(ff.BINS, max_leaves=6, min_rows=20)
    share = y[train].mean()
    raw = np.full(len(y), np.log(share / (1 - share)))
    inside, outside = np.flatnonzero(train), np.flatnonzero(~train)
    for _ in range(3):
        prob = 1 / (1 + np.exp(-raw))
        g, h = np.round((y - prob) * ht.ONE), np.round(prob * (1 - prob) * ht.ONE)
        t = ht.grow(ht.Rows(bins, np.stack([train.astype(float), g * train, h * train])[None], p), 1, 3, p)
        leaves = plain_leaves(bins[inside], g[inside], h[inside], p)
        at = t.step(np.zeros(len(y), int), np.arange(len(y)), bins, p.bins)
        assert {tuple(np.flatnonzero(at[inside] == k)) for k in np.unique(at[inside])} == leaves
        raw = raw + (0.1 * t.stats[:, 1] / np.maximum(t.stats[:, 2], 1e-300))[at]
    for k in outside:
        assert got[0, pdf["window_uid"][k]] == pytest.approx(1 / (1 + np.exp(-raw[k])), abs=1e-12)


def test_absent_values_decide_a_fold(spark):
    """The label is whether f0 is there; boosting finds it, so its scores part the classes."""
    made = [(f"w{k}", f"g{k % 2}", k % 3 == 0, None if k % 3 == 0 else float(k % 7), float(k % 5)) for k in range(300)]
    rows = spark.createDataFrame(made, "window_uid string, g string, y boolean, f0 double, f1 double").withColumn("label", F.col("y").cast("int"))
    found = ff.fold_scores(rows, ["f0", "f1"], *arrays(2), 2, [ff.Fit(i, "hgb", (("rounds", 20),)) for i in range(2)], 1).collect()
    low, high = max(r["score"] for r in found if not r["label"]), min(r["score"] for r in found if r["label"])
    assert low < 0.2 < 0.6 < high


def test_a_tree_balances_its_own_draws():
    rng = np.random.default_rng(0)
    n = 500
    facts = ff.Facts(1, np.array([n]), np.array([60]), np.zeros((1, 1)), [np.zeros(1)], np.zeros(1), 9)
    labels = (rng.random(n) < 0.12).astype(np.int8)
    row = {"block": 0, "hashes": rng.integers(0, 1 << 62, n).astype("<u8").tobytes(), "labels": labels.tobytes(),
           "values": np.zeros(n).tobytes(), "bins": np.zeros(n, np.uint8).tobytes(), "train": np.ones(n, np.uint8).tobytes(),
           "held": np.zeros(n, np.uint8).tobytes(), "raw": None}
    b = ff.Block(row, facts)
    drawn = ff.drawn_classes(b, 0, range(5))
    assert len(set(map(tuple, drawn))) > 1
    for tree in range(5):
        _, positive, weight = ff.forest_stats(b, 0, tree, drawn[tree])
        assert positive.sum() == pytest.approx(weight.sum() / 2, rel=1e-5)


def test_logistic_optimum_is_that_of_spark(rows):
    full = rows.fillna(0.25, COLUMNS).replace(float("nan"), 0.25, COLUMNS)
    every = F.array(F.lit(True)), F.array(F.lit(1).cast("tinyint"))
    got = {r["window_uid"]: r["score"] for r in ff.fold_scores(full, COLUMNS, *every, 1, [ff.Fit(0, "logreg", (("C", 0.5),))], 1).collect()}
    n, n_pos = md.class_sizes(full)
    pipe = md.estimator("logreg", COLUMNS, n, 1, {"C": 0.5})
    spark_lr = [s for s in pipe.getStages() if isinstance(s, LogisticRegression)][0]
    spark_lr.setTol(1e-14)
    model = pipe.fit(full.withColumn("weight", md.balanced_weight(n, n_pos)))
    for r in md.with_scores(model, full).collect():
        assert got[r["window_uid"]] == pytest.approx(r["score"], abs=1e-6)


def test_jobs_of_a_search_do_not_depend_on_grid_and_folds(spark, rows):
    """Logistic steps over many blocks: as many Spark jobs for two fits as for sixteen (within a step or two)."""
    def jobs(fits, folds):
        name = f"jobs-{len(fits)}"
        spark.sparkContext.setJobGroup(name, name)
        scores(rows, fits, size=70, folds=folds)
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    few = jobs([ff.Fit(i, "logreg") for i in range(2)], 2)
    many = jobs([ff.Fit(i, "logreg", (("C", c),)) for i in range(4) for c in (0.01, 0.1, 1.0, 10.0)], 4)
    assert many <= few * 1.5


def test_folds_of_one_class_or_without_rows(spark):
    rows = spark.createDataFrame([(f"w{k}", f"g{k % 2}", k % 2, float(k)) for k in range(20)], "window_uid string, g string, label int, f0 double")
    for name in ("hgb", "rf", "logreg", "dummy"):
        found = ff.fold_scores(rows, ["f0"], *arrays(2), 2, [ff.Fit(i, name, (("trees", 2), ("rounds", 2))) for i in range(2)], 1).collect()
        assert {(r["g"], r["score"]) for r in found} == {("g0", 1.0), ("g1", 0.0)}
    none = rows.where("label = 7")
    assert ff.fold_scores(none, ["f0"], *arrays(2), 2, [ff.Fit(0, "hgb")], 1).count() == 0


def test_wide_tables_are_refused_for_logistic_fits(rows):
    with pytest.raises(ValueError, match="fewer than"):
        ff.fold_scores(rows, [f"c{k}" for k in range(ff.CURVED)], *arrays(), 4, [ff.Fit(0, "logreg")], 1)
