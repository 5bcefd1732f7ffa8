"""Ranking metrics and operating points against plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import metrics as mt
from windrow.operators import ranking as rk
from windrow.operators import thresholds as th


def frame(spark, y, s, key="k"):
    rows = [(key, int(a), float(b), "s") for a, b in zip(y, s)]
    return spark.createDataFrame(rows, "k string, label int, score double, source string")


def average_precision(y, s):
    total, prev, out = y.sum(), 0.0, 0.0
    for v in sorted(set(s), reverse=True):
        hit = s >= v
        rec, prec = y[hit].sum() / total, y[hit].mean()
        out += (rec - prev) * prec
        prev = rec
    return out


def roc(y, s):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))


@pytest.mark.parametrize("seed", range(4))
def test_ranking_metrics_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    y = (rng.random(300) < 0.2).astype(int)
    s = np.round(rng.random(300) ** 3, 2 if seed % 2 else 6)
    got = mt.ranking_metrics(frame(spark, y, s), ["k"]).head()
    assert got["pr_auc"] == pytest.approx(average_precision(y, s))
    assert got["roc_auc"] == pytest.approx(roc(y, s))


def test_one_class_gives_nan(spark):
    got = mt.window_metrics(frame(spark, [0, 0], [0.1, 0.2]), ["k"], 0.15).head()
    assert math.isnan(got["pr_auc"]) and math.isnan(got["roc_auc"])
    assert got["precision"] == 0.0 and got["recall"] == 0.0 and got["fp"] == 1


@pytest.mark.parametrize("seed", range(4))
def test_threshold_is_exact_and_realisable(spark, seed):
    rng = np.random.default_rng(seed)
    y = (rng.random(200) < 0.3).astype(int)
    s = np.round(np.clip(rng.normal(0.3, 0.3, 200), 0, 1), 2)
    got = th.pick_threshold(frame(spark, y, s), ["k"]).head()

    def f2(thr):
        p = s >= thr
        tp, fp, fn = (y & p).sum(), ((1 - y) & p).sum(), (y & ~p).sum()
        return 5 * tp / (5 * tp + 4 * fn + fp) if tp else 0.0

    assert got["achieved"] == pytest.approx(max(f2(v) for v in set(s)))
    assert f2(got["threshold"]) == pytest.approx(got["achieved"])


def test_threshold_fallbacks(spark):
    for y, s in (([0, 0], [0.1, 0.9]), ([1, 0], [0.5, 0.5])):
        got = th.pick_threshold(frame(spark, y, s), ["k"]).head()
        assert (got["threshold"], got["achieved"]) == (0.5, 0.0)


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    s = np.round(rng.random(n), 1 if n == 100 else 5)
    for lo, hi, m in ((0.0, 1.0, 24), (0.5, 0.9995, 60)):
        got = rk.quantiles(frame(spark, [0] * n, s), ["k"], lo, hi, m).head()
        assert got["n"] == n
        assert np.allclose(got["q"], np.quantile(s, np.linspace(lo, hi, m)), atol=1e-12)


def test_scores_outside_the_unit_interval_keep_their_order(spark):
    s = np.array([-3.0, -1.0, 0.2, 0.9, 5.0, 7.0])
    y = np.array([0, 0, 1, 0, 1, 1])
    got = mt.ranking_metrics(frame(spark, y, s), ["k"]).head()
    assert got["pr_auc"] == pytest.approx(average_precision(y, s))


def test_hash_rank_is_a_permutation_for_any_partitioning(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 2)
    seen = set()
    for parts in (1, 4, 64):
        got = rk.hash_rank(df.repartition(parts), ["g"], 7, "id").collect()
        seen.add(tuple(sorted((r["g"], r["rank"], r["id"]) for r in got)))
    assert len(seen) == 1
    assert sorted(r for g, r, _ in seen.pop() if g == 0) == list(range(1, 251))


def mask_f2(marks, label, k):
    run, mask = 0, [False] * len(marks)
    for i in range(len(marks) + 1):
        if i < len(marks) and marks[i]:
            run += 1
            continue
        if run >= k:
            mask[i - run : i] = [True] * run
        run = 0
    m, y = np.array(mask), np.array(label)
    tp, fp, fn = (y & m).sum(), ((1 - y) & m).sum(), (y & ~m).sum()
    return 5 * tp / (5 * tp + 4 * fn + fp) if tp else 0.0


def test_joint_choice_matches_an_exhaustive_search(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(120), 3)
    y = (np.convolve(s, np.ones(3) / 3, "same") > 0.6).astype(int)
    rows = [("k", "r", i, i * 10.0, i * 10.0 + 10, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    df = spark.createDataFrame(
        rows, "g string, record_id string, window_idx int, t_start_sec double, t_end_sec double, label int, score double"
    )
    cands = np.unique(np.quantile(s, np.linspace(0, 1, 24)))
    cands = cands[cands < s.max()]
    best = (0.5, 1, -1.0)
    for k in (1, 2, 3):
        for t in cands:
            f = mask_f2(s >= t, y, k)
            if f > best[2] + 1e-15:
                best = (t, k, f)
    for reach in (0, 1):
        if reach:
            # a wider reach marks neighbours too; it must still run on the same frame
            assert th.pick_threshold_and_k(df, ["g"], [1, 2, 3], reach=1).count() == 1
            continue
        got = th.pick_threshold_and_k(df, ["g"], [1, 2, 3]).head()
        assert got["f2"] == pytest.approx(best[2])
        assert got["threshold"] == pytest.approx(best[0]) and got["best_k"] == best[1]


def test_constant_score_always_alarms_in_the_joint_choice(spark, windows):
    w = windows({"a": "0000"}, labels={"a": "0110"}).withColumn("g", F.lit("g"))
    got = th.pick_threshold_and_k(w, ["g"], [1, 2, 3]).head()
    assert got["threshold"] == 0.0 and got["best_k"] == 1
    one_class = windows({"a": "0101"}, labels={"a": "0000"}).withColumn("g", F.lit("g"))
    got = th.pick_threshold_and_k(one_class, ["g"], [2, 3]).head()
    assert got["threshold"] == 0.5 and got["best_k"] == 2 and math.isnan(got["f2"])


def test_pooled_ratios_come_from_summed_counts(spark):
    df = spark.createDataFrame(
        [("m", 1, 0, 0, 9), ("m", 1, 99, 9, 0)], "model string, tp int, fp int, fn int, tn int"
    )
    got = mt.pooled_window_metrics(df, ["model"]).head()
    assert got["precision_pooled"] == pytest.approx(2 / 101)
    assert got["recall_pooled"] == pytest.approx(2 / 11)
