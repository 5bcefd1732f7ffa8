"""Windows, labels, runs and event metrics on small frames with known answers."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from windrow.config import Windowing
from windrow.operators import events as ev
from windrow.operators import runs as rn
from windrow.operators import windows as wn

SPEC = Windowing(10.0, 10.0, 0.5, 30.0, sample_rate=1)


def records(spark, **n):
    return spark.createDataFrame(list(n.items()), "record_id string, n_samples long")


def labels(spark, spans, n=200, spec=SPEC, disputed=None):
    iv = spark.createDataFrame([("a", s, e) for s, e in spans], "record_id string, start_sec long, end_sec long")
    if disputed:
        disputed = spark.createDataFrame([("a", s, e) for s, e in disputed], iv.schema)
    out = wn.label_windows(records(spark, a=n), iv, spec, disputed).orderBy("window_idx").collect()
    return [r["label"] for r in out], [r["overlap_frac"] for r in out]


def test_trailing_partial_window_is_dropped(spark):
    got = wn.cut_windows(records(spark, a=25, b=9, c=10), SPEC).orderBy("record_id", "window_idx").collect()
    assert [(r["record_id"], r["window_idx"], r["t_end_sec"]) for r in got] == [
        ("a", 0, 10.0), ("a", 1, 20.0), ("c", 0, 10.0),
    ]
    assert got[0]["window_uid"] == "a_000000"


def test_long_record_is_cut_in_pieces(spark):
    spec = Windowing(1.0, 1.0, 0.5, 0.0, sample_rate=1)
    got = wn.cut_windows(records(spark, a=10_001), spec)
    assert got.count() == 10_001 and got.agg(F.max("window_idx")).head()[0] == 10_000


def test_bad_window_sizes_are_refused():
    with pytest.raises(ValueError):
        Windowing(0.0, 10.0)
    with pytest.raises(ValueError):
        Windowing(10.0, 0.0)


def test_label_at_exactly_half_and_guard_edges(spark):
    got, frac = labels(spark, [(105, 115)])
    assert got[10] == 1 and frac[10] == 0.5 and got[11] == 1
    # strict: a window that ends where the guard begins stays 0
    assert got[6] == 0 and got[7] == -1 and got[14] == -1 and got[15] == 0


def test_overlapping_intervals_count_twice(spark):
    _, frac = labels(spark, [(100, 110), (100, 110)])
    assert frac[10] == 2.0


def test_disputed_span_is_guard_but_ictal_wins(spark):
    got, _ = labels(spark, [(100, 110)], disputed=[(0, 20), (100, 110)])
    assert got[0] == -1 and got[1] == -1 and got[2] == 0 and got[10] == 1


def test_sweep_keeps_failing_guard(spark):
    spec = Windowing(10.0, 10.0, 0.5, 0.0, sample_rate=1)
    iv = spark.createDataFrame([("a", 107, 117)], "record_id string, start_sec long, end_sec long")
    w = wn.label_windows(records(spark, a=200), iv, spec)
    got = {r["min_overlap_frac"]: r for r in wn.overlap_sweep(w).collect()}
    # 0.3 of one window (guard) and 0.7 of the next (ictal)
    assert [got[f]["n_positive"] for f in (0.1, 0.25, 0.5, 0.75)] == [2, 2, 1, 0]
    assert [got[f]["n_guard"] for f in (0.1, 0.25, 0.5, 0.75)] == [0, 0, 1, 1]
    assert got[0.75]["n_windows"] == 19


@pytest.mark.parametrize("chunk", [2, 3, 4096])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_runs_match_a_plain_scan(windows, chunk, k):
    marks = {"a": "0110111011110001", "b": "1111111111", "c": "0000", "d": "1010101"}
    got = rn.positive_runs(windows(marks), k, chunk=chunk).collect()
    want = set()
    for rid, s in marks.items():
        i = 0
        while i < len(s):
            j = i
            while j < len(s) and s[j] == "1":
                j += 1
            if j - i >= k and j > i:
                want.add((rid, i, j - 1, i * 10.0, j * 10.0, j - i))
            i = max(j, i + 1)
    assert {(r["record_id"], r["first_idx"], r["last_idx"], r["start_sec"], r["end_sec"], r["n_windows"]) for r in got} == want


def test_missing_window_breaks_a_run(windows):
    got = rn.positive_runs(windows({"a": "1111"}, skip={("a", 2)}), 1).collect()
    assert sorted((r["first_idx"], r["last_idx"]) for r in got) == [(0, 1), (3, 3)]


def test_mask_marks_time_overlap_for_sliding_windows(windows):
    spec = Windowing(10.0, 5.0, sample_rate=1)
    assert spec.reach == 1
    w = windows({"a": "0011000", "b": "0000000"}, stride=5.0)
    got = rn.run_mask(w, 2, reach=spec.reach).where("in_run").collect()
    assert sorted(r["window_idx"] for r in got) == [1, 2, 3, 4]
    assert {r["record_id"] for r in got} == {"a"}


def one(df):
    return df.head().asDict()


def test_event_detection_latency_and_false_alarm(windows, truth):
    w = windows({"a": "0011000110"})
    got = one(ev.event_metrics(w, truth({"a": [(25, 35)]}), 2))
    assert (got["n_true_events"], got["n_detected"], got["false_alarms"]) == (1, 1, 1)
    assert got["median_latency_sec"] == -5.0
    assert got["alarm_hours"] == pytest.approx(40 / 3600)


def test_several_runs_on_one_event_and_one_run_on_two_events(windows, truth):
    w = windows({"a": "1101100000"})
    got = one(ev.event_metrics(w, truth({"a": [(0, 50)]}), 2))
    assert (got["n_detected"], got["false_alarms"]) == (1, 0)
    w = windows({"a": "1111100000"})
    got = one(ev.event_metrics(w, truth({"a": [(0, 10), (30, 40)]}), 2))
    assert (got["n_detected"], got["false_alarms"]) == (2, 0)


def test_touching_is_not_overlap(windows, truth):
    got = one(ev.event_metrics(windows({"a": "1100"}), truth({"a": [(20, 30)]}), 1))
    assert (got["n_detected"], got["false_alarms"]) == (0, 1)


def test_truth_of_absent_records_does_not_count(windows, truth):
    got = one(ev.event_metrics(windows({"a": "0000"}), truth({"a": [(0, 5)], "zz": [(0, 5)]}), 1))
    assert got["n_true_events"] == 1 and math.isnan(got["median_latency_sec"])


def test_durations_fall_back_per_record(spark, windows, truth):
    d = spark.createDataFrame([("a", 7200.0), ("b", 0.0)], "record_id string, duration_sec double")
    got = one(ev.event_metrics(windows({"a": "0000", "b": "0000", "c": "00"}), truth({"x": [(0, 1)]}), 1, durations=d))
    assert got["n_fallback_duration"] == 2
    assert got["interictal_hours"] == pytest.approx((7200 + 40 + 20) / 3600)
    assert math.isnan(got["event_sensitivity"])


def test_excluded_time_uses_the_window_span(windows, truth):
    w = windows({"a": "000000"}, stride=5.0, skip={("a", 1), ("a", 2)})
    got = one(ev.event_metrics(w, truth({"x": [(0, 1)]}), 1))
    assert got["excluded_hours"] == pytest.approx(2 * 10 / 3600)


def test_detector_that_always_alarms_shows_in_time_in_alarm(windows, truth):
    w = windows({"a": "1" * 60, "b": "1" * 60})
    got = one(ev.validation_event_score(ev.event_metrics(w, truth({"a": [(100, 140)]}), 3)))
    assert got["n_detected"] == 1 and got["time_in_alarm_frac"] == 1.0 and got["event_f2"] == 0.0


def test_mixed_or_missing_source_is_refused(windows, truth):
    both = windows({"a": "01"}).unionByName(windows({"b": "01"}, source="t"))
    with pytest.raises(PySparkException, match="one source"):
        ev.event_metrics(both, truth({"a": [(0, 5)]}), 1).collect()
    with pytest.raises(ValueError, match="source"):
        ev.event_metrics(both.drop("source"), truth({"a": [(0, 5)]}), 1)


def test_bin_width_and_partitioning_do_not_matter(windows, truth):
    marks = {f"r{i}": "0110111011110001" * 3 for i in range(6)}
    t = truth({f"r{i}": [(i * 10, i * 10 + 35), (200, 290), (230, 240)] for i in range(6)})
    seen = set()
    for parts in (1, 4, 64):
        for width in (7.0, 60.0, 1e6):
            got = ev.event_metrics(windows(marks).repartition(parts), t, 2, ["subject_id"], bin_sec=width)
            seen.add(tuple(sorted(str(r) for r in got.collect())))
    assert len(seen) == 1


def test_one_record_with_most_rows(windows, truth):
    w = windows({"big": "0111" * 2000, "small": "01"})
    runs = rn.positive_runs(w, 2, chunk=64)
    assert runs.where("record_id = 'big'").count() == 2000
    got = one(ev.event_metrics(w, truth({"big": [(i * 400, i * 400 + 15) for i in range(100)]}), 2, bin_sec=300.0))
    assert got["n_true_events"] == 100 and got["n_detected"] == 100
