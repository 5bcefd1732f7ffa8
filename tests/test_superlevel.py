"""Runs as step functions of the threshold against runs found at each threshold."""

import random

import pytest
from pyspark.sql import functions as F

from windrow.operators import superlevel as sl
from windrow.operators import thresholds as th


def plain_runs(wins, t, k):
    """(start, end, indexes) of the runs of at least ``k`` at threshold ``t``."""
    out = []
    for i, a, z, s in wins:
        if s < t:
            continue
        if out and out[-1][2][-1] == i - 1:
            out[-1] = (out[-1][0], max(out[-1][1], z), out[-1][2] + [i])
        else:
            out.append((a, z, [i]))
    return [r for r in out if len(r[2]) >= k]


def made(seed, length, stride):
    r = random.Random(seed)
    wins, truth = {}, {}
    for rec in ("a", "b", "c"):
        wins[rec] = [
            (i, i * stride, i * stride + length, round(r.random() ** (1 + (i % 17 < 6)), 2)) for i in range(160) if r.random() > 0.06
        ]
        if rec != "c":
            starts = sorted(r.sample(range(0, int(160 * stride)), 6))
            truth[rec] = [(j, s, s + r.choice([0, 1, 7, 55])) for j, s in enumerate(starts, 1)]
    return wins, truth


@pytest.mark.parametrize("length,stride,k,chunk", [(10.0, 10.0, 1, 4096), (10.0, 10.0, 2, 16), (10.0, 5.0, 3, 8), (4.0, 9.0, 2, 16)])
def test_sweep_equals_runs_at_each_threshold(spark, monkeypatch, length, stride, k, chunk):
    monkeypatch.setattr(sl.opened, "__defaults__", (0, chunk))
    monkeypatch.setattr(sl.mark_steps, "__defaults__", (chunk,))
    wins, truth = made(int(length + stride + k), length, stride)
    w = spark.createDataFrame([(rec, *x) for rec, xs in wins.items() for x in xs], "record_id string, window_idx int, t_start_sec double, t_end_sec double, score double")
    e = spark.createDataFrame([(rec, *x) for rec, xs in truth.items() for x in xs], "record_id string, seizure_idx long, start_sec long, end_sec long")
    got = th.threshold_sweep(w, e, k, n_grid=12, lo=0.3, hi=0.99, bin_sec=40.0).collect()
    assert {r["record_id"] for r in got} == set(wins) and len(got) > 20
    for r in got:
        runs = plain_runs(wins[r["record_id"]], r["threshold"], k)
        events = truth.get(r["record_id"], [])
        hit = lambda run, ev: run[1] > ev[1] and run[0] < ev[2]
        assert r["segments"] == len(runs)
        assert r["time_in_alarm"] == pytest.approx(sum(z - a for a, z, _ in runs) / max(x[2] for x in wins[r["record_id"]]))
        assert r["detected"] == sum(any(hit(run, ev) for run in runs) for ev in events)
        assert r["false_alarms"] == sum(not any(hit(run, ev) for ev in events) for run in runs)


@pytest.mark.parametrize("reach", [0, 1, 2])
def test_opened_levels_equal_the_mask_at_each_threshold(spark, reach):
    wins, _ = made(5, 10.0, 10.0 / (reach + 1))
    w = spark.createDataFrame([(rec, *x) for rec, xs in wins.items() for x in xs], "record_id string, window_idx int, t_start_sec double, t_end_sec double, score double")
    cuts = [0.1, 0.3, 0.6, 0.9]
    cands = w.select("record_id").distinct().withColumn("candidates", F.array(*[F.lit(c) for c in cuts]))
    rows = sl.opened(sl.with_levels(w, cands, ["record_id"]), [], [1, 3], reach, chunk=16).collect()
    for r in rows:
        for k in (1, 3):
            for j, t in enumerate(cuts, 1):
                runs = plain_runs(wins[r["record_id"]], t, k)
                inside = any(min(x[2]) - reach <= r["window_idx"] <= max(x[2]) + reach for x in runs)
                assert (r[f"open_{k}"] >= j) == inside


def test_no_row_is_repeated_per_threshold(spark):
    """The plan explodes candidates only on the side of the candidate table."""
    wins, truth = made(1, 10.0, 10.0)
    w = spark.createDataFrame([(rec, *x) for rec, xs in wins.items() for x in xs], "record_id string, window_idx int, t_start_sec double, t_end_sec double, score double")
    cands = w.groupBy("record_id").agg(F.array(*[F.lit(k / 50) for k in range(50)]).alias("candidates"))
    assert sl.opened(sl.with_levels(w, cands, ["record_id"]), [], [1, 2, 3]).count() == sum(map(len, wins.values()))
