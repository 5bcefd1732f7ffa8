"""Kernels on signals with known answers, block reading, filters, views, wide CSV."""

from dataclasses import replace

import numpy as np
import pytest

from recording_files import recording
from windrow import fixed_values as fv
from windrow.config import Features, Settings, Signal, Windowing
from windrow.functions import kernels as kn
from windrow.operators import extract as ex
from windrow.operators import features as ft
from windrow.operators.labels import case_registry
from windrow.sources import recordings as rec

FS, N = 256, 2560
T = np.arange(N) / FS
NAMES = Features().names


def vector(x):
    return dict(zip(NAMES, kn.features(np.asarray(x)[None], FS, fv.BANDS)[0]))


@pytest.mark.parametrize("hz,band", [(2, "delta"), (10, "alpha"), (40, "gamma")])
def test_sine_lands_in_its_band(hz, band):
    got = vector(np.sin(2 * np.pi * hz * T))
    assert max(fv.BANDS, key=lambda b: got[f"bp_{b}_rel"]) == band
    assert sum(got[f"bp_{b}_rel"] for b in fv.BANDS) == pytest.approx(1, abs=0.05)
    assert got["hjorth_complexity"] == pytest.approx(1, abs=0.01)


def test_sine_power_is_half():
    got = vector(np.sin(2 * np.pi * 10 * T))
    assert got["bp_alpha_log"] == pytest.approx(np.log1p(0.5), abs=0.01)


def test_ramp_noise_and_zeros():
    assert vector(3 * np.arange(N))["line_length"] == pytest.approx(3 * (N - 1))
    noise = np.random.default_rng(0).normal(size=N)
    got = vector(noise)
    assert got["variance"] == pytest.approx(noise.var(), rel=1e-5)
    assert got["hjorth_mobility"] == pytest.approx(np.sqrt(2), abs=0.1)
    assert all(v == 0 for v in vector(np.zeros(N)).values())
    assert all(v == 0 for k, v in vector(np.full(N, np.nan)).items() if k != "hjorth_mobility")


def test_scaling_changes_only_amplitude_features():
    x = np.random.default_rng(1).normal(size=N)
    a, b = vector(x), vector(7 * x)
    for name in NAMES:
        same = any(m in name for m in fv.AMPLITUDE_INVARIANT_MARKERS)
        assert (a[name] == pytest.approx(b[name], rel=1e-4)) == same


def test_welch_against_a_direct_transform():
    x = np.random.default_rng(2).normal(size=96)
    f, p = kn.welch(x, 64, 32, 16)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
    total = np.zeros(17)
    for s in range(0, 65, 16):
        seg = (x[s : s + 32] - x[s : s + 32].mean()) * window
        for k in range(17):
            z = sum(seg[n] * np.exp(-2j * np.pi * k * n / 32) for n in range(32))
            total[k] += abs(z) ** 2 * (1 if k in (0, 16) else 2)
    assert np.allclose(p, total / 5 / (64 * (window**2).sum()))


def plain_recursion(x, b, a, state):
    """Sample by sample, from a given state."""
    z, y = list(state), np.zeros_like(x)
    for n, v in enumerate(x):
        y[n] = b[0] * v + z[0]
        z = [b[1] * v - a[1] * y[n] + z[1], b[2] * v - a[2] * y[n]]
    return y


def plain_both_ways(x, sections, edge):
    x = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -2 - edge : -1]])
    for _ in range(2):
        level = x[0]
        for b, a in sections:
            # the state that a constant input leaves as it is
            z1 = b[2] - a[2] * b.sum() / a.sum()
            z0 = b[1] - a[1] * b.sum() / a.sum() + z1
            x = plain_recursion(x, b, a, (level * z0, level * z1))
            level *= b.sum() / a.sum()
        x = x[::-1]
    return x[edge:-edge]


@pytest.mark.parametrize("n", [40, 257, 1999])
@pytest.mark.parametrize("block", [None, 1, 7, 5000])
def test_filter_equals_recursion_both_ways_with_its_ends(n, block):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(2, n)) + 3
    want = np.array([plain_both_ways(plain_both_ways(r, [kn.notch_section(60.0, FS)], 9), kn.bandpass_sections(0.5, 80.0, FS), 27) for r in x])
    got = kn.zero_phase(x, FS, (60.0, 300.0), (0.5, 80.0), block)
    assert np.abs(got - want).max() < 1e-9


def test_sections_have_the_gains_of_the_method():
    w = 2 * np.pi * np.array([0.3, 0.5, 5.0, 40.0, 60.0, 80.0, 110.0]) / FS
    z = np.exp(-1j * w)
    gain = lambda parts: np.prod([np.abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)) ** 2 for b, a in parts], axis=0)
    assert np.allclose(gain(kn.bandpass_sections(0.5, 80.0, FS)), kn.bandpass_gain(w, 0.5, 80.0, FS), atol=1e-9)
    assert np.allclose(gain([kn.notch_section(60.0, FS)]), kn.notch_gain(w, 60.0, FS), atol=1e-12)


def test_a_constant_passes_a_notch_unchanged_to_its_ends():
    x = np.full((1, 500), 4.25)
    assert np.abs(kn.zero_phase(x, FS, (60.0,), None) - x).max() < 1e-9


def test_short_signals_are_filtered():
    for n in (1, 2, 5, 20):
        assert np.isfinite(kn.zero_phase(np.arange(float(n))[None], FS, (60.0,), (0.5, 80.0))).all()


def test_bandpass_gain_has_half_power_at_its_edges():
    for f in (0.5, 80.0):
        assert kn.bandpass_gain(np.array([2 * np.pi * f / FS]), 0.5, 80.0, FS)[0] == pytest.approx(0.5, abs=1e-9)
    inside = kn.bandpass_gain(2 * np.pi * np.array([5.0, 20.0]) / FS, 0.5, 80.0, FS)
    outside = kn.bandpass_gain(2 * np.pi * np.array([0.05, 120.0]) / FS, 0.5, 80.0, FS)
    assert (inside > 0.999).all() and (outside < 1e-4).all()


def test_line_noise_ratio_falls_after_the_notch(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=FS * 20) + 5 * np.sin(2 * np.pi * 60 * np.arange(FS * 20) / FS)
    clean = kn.zero_phase(x[None], FS, (60.0, 120.0), None)[0]
    df = spark.createDataFrame([("raw", x.tolist()), ("clean", clean.tolist())], "k string, samples array<double>")
    got = {r["k"]: r["line_noise_ratio"] for r in ft.line_noise_ratio(df, ["k"], FS, FS * 20).collect()}
    assert got["raw"] > 100 and got["clean"] < 2


LABELS = ["FP1-F7", "ECG", "f7 - t7", "FZ-CZ", "FZ-CZ"]
SMALL = Settings(
    signal=Signal(sample_rate=64, notch_hz=(20.0,), bandpass=(1.0, 28.0), canonical_channels=("FZ-CZ", "FP1-F7", "F7-T7")),
    windowing=Windowing(2.0, 1.0, 0.5, 1.0, sample_rate=64),
    features=Features(bands={"low": (1.0, 8.0), "high": (8.0, 28.0)}, welch_nperseg=64, welch_noverlap=32),
)


def write(folder, name, data, **kw):
    p = folder / "chb01"
    p.mkdir(exist_ok=True)
    (p / f"{name}.edf").write_bytes(recording(kw.pop("labels", LABELS), 64, data.shape[1] // 64, data, **kw))


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(5)
    data = np.round(rng.normal(scale=50, size=(5, 64 * 100)), 1)
    write(tmp_path, "chb01_01", data)
    write(tmp_path, "chb01_02", data[:1, : 64 * 50], labels=["FZ-CZ"])
    write(tmp_path, "chb01_03", data, cut=5)
    write(tmp_path, "chb01_04", data[:, :64])
    (tmp_path / "chb01" / "chb01_05.edf").write_bytes(b"short")
    return tmp_path, data


def test_header_scan_reports_each_file(spark, folder):
    root, _ = folder
    plan = rec.BlockPlan(SMALL.signal.canonical_channels, "skip_file", 10.0, 20.0)
    states = ex.record_states(rec.recording_headers(spark, str(root), plan), SMALL)
    got = {r["record_id"]: r for r in states.collect()}
    assert got["chb01_01"]["state"] == "extracted" and got["chb01_01"]["n_windows"] == 99
    assert got["chb01_02"]["reason"] == "missing_channels:FP1-F7,F7-T7"
    assert got["chb01_03"]["state"] == "failed" and "samples end" in got["chb01_03"]["error"]
    assert got["chb01_04"]["reason"] == "record_shorter_than_window"
    assert got["chb01_05"]["state"] == "failed"


def test_blocks_hold_volts_in_canonical_order_first_duplicate_wins(spark, folder):
    root, data = folder
    plan = rec.BlockPlan(SMALL.signal.canonical_channels, "skip_file", 10.0, 3.0)
    headers = rec.recording_headers(spark, str(root), plan).where("record_id = 'chb01_01'")
    rows = rec.read_recordings(headers, plan).orderBy("block_idx").collect()
    assert len(rows) == 10 and rows[0]["channels"] == ["FZ-CZ", "FP1-F7", "F7-T7"]
    cores = [np.array(r["samples"])[:, r["halo_left"] : r["halo_left"] + r["block_len"]] for r in rows]
    assert np.allclose(np.concatenate(cores, axis=1) * 1e6, data[[3, 0, 2]], atol=1e-6)


def test_features_do_not_depend_on_the_block_size(spark, folder):
    root, data = folder
    found = []
    for block_sec in (10.0, 37.0, 1000.0):
        plan = rec.BlockPlan(SMALL.signal.canonical_channels, "skip_file", block_sec, 20.0)
        headers = rec.recording_headers(spark, str(root), plan).where("record_id = 'chb01_01'")
        rows = ex.features_of_files(headers, plan, SMALL).orderBy("window_idx").collect()
        assert [r["window_idx"] for r in rows] == list(range(99))
        found.append(np.array([r["features"] for r in rows]))
    assert np.allclose(found[0], found[2], rtol=1e-4, atol=1e-9)
    assert np.allclose(found[1], found[2], rtol=1e-4, atol=1e-9)


def test_extracted_table_has_both_views_and_labels(spark, folder):
    root, _ = folder
    iv = spark.createDataFrame([("chb01_01", 30.0, 40.0)], "record_id string, start_sec double, end_sec double")
    agg = ex.extract_files(spark, str(root), SMALL, iv, case_registry(spark), "aggregated")
    pch = ex.extract_files(spark, str(root), SMALL, iv, case_registry(spark), "per_channel")
    names = SMALL.features.names
    assert set(ft.aggregated_names(names)) <= set(agg.columns)
    assert set(ft.per_channel_names(["FZ-CZ", "FP1-F7", "F7-T7"], names)) <= set(pch.columns)
    rows = agg.orderBy("window_idx").collect()
    assert len(rows) == 99 and {r["subject_id"] for r in rows} == {"sub01"}
    assert [r["window_idx"] for r in rows if r["label"] == 1] == list(range(29, 40))
    wide = pch.where("window_idx = 5").head()
    one = agg.where("window_idx = 5").head()
    got = [wide[f"{c}__variance"] for c in ("FZ-CZ", "FP1-F7", "F7-T7")]
    assert one["variance__mean"] == pytest.approx(np.mean(got), rel=1e-5)
    assert one["variance__median"] == pytest.approx(np.median(got), rel=1e-5)


def test_fill_nan_keeps_the_layout_and_zeroes_features(spark, folder):
    root, _ = folder
    filled = replace(SMALL, data=replace(SMALL.data, on_missing_channel="fill_nan"))
    plan = rec.BlockPlan(filled.signal.canonical_channels, "fill_nan", 1000.0, 20.0)
    headers = rec.recording_headers(spark, str(root), plan).where("record_id = 'chb01_02'")
    row = ex.features_of_files(headers, plan, filled).where("window_idx = 3").head()
    assert row["channels"] == ["FZ-CZ", "FP1-F7", "F7-T7"]
    assert any(row["features"][0]) and not any(row["features"][1])


def test_views_select_by_label_whatever_the_row_order(spark):
    rows = [("w", c, [float(i), float(i * 10)]) for i, c in enumerate(["B", "A", "C"])]
    a = spark.createDataFrame(rows, "w string, channel string, features array<float>")
    b = spark.createDataFrame(rows[::-1], a.schema)
    for make in (
        lambda d: ft.per_channel_view(d, ["w"], ["A", "B"], ["x", "y"]),
        lambda d: ft.aggregated_view(d, ["w"], ["x", "y"]),
    ):
        assert make(a).collect() == make(b).collect()
    assert ft.per_channel_view(a, ["w"], ["A", "B"], ["x", "y"]).head().asDict() == {
        "w": "w", "A__x": 1.0, "A__y": 10.0, "B__x": 0.0, "B__y": 0.0,
    }


def test_channel_stats_use_population_std_and_linear_percentiles(spark):
    x = [1.0, 2.0, 3.0, 4.0, 10.0]
    df = spark.createDataFrame([("c", x)], "channel string, samples array<double>")
    got = ft.channel_stats(df, ["channel"]).head()
    assert got["std"] == pytest.approx(np.std(x)) and got["p95"] == pytest.approx(np.percentile(x, 95))


def test_wide_csv_numbers_rows_across_splits(spark, tmp_path):
    from windrow.sources.wide_csv import csv_features, read_wide_csv

    rng = np.random.default_rng(6)
    n, data = 500, rng.normal(size=(500, 2 * 32)).astype(np.float32)
    data[7] = data[3]
    labels = [int(i % 50 < 10) for i in range(n)]
    labels[7] = labels[3]
    lines = [",".join([f"f{i}" for i in range(64)] + ["target"])]
    lines += [",".join([repr(float(v)) for v in row] + [str(y)]) for row, y in zip(data, labels)]
    path = tmp_path / "wide.csv"
    path.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_wide_csv(spark, str(path), 2, 32).orderBy("row_index").collect()
        assert [r["row_index"] for r in rows] == list(range(n))
        assert [r["label"] for r in rows] == labels
        assert np.allclose(np.array([r["samples"] for r in rows]).reshape(n, -1), data)
        spec = Settings(
            signal=Signal(sample_rate=32, notch_hz=(8.0,), bandpass=(1.0, 12.0)),
            features=Features(bands={"a": (1.0, 6.0), "b": (6.0, 12.0)}, welch_nperseg=32, welch_noverlap=16),
        )
        table = csv_features(read_wide_csv(spark, str(path), 2, 32), spec, fs=32.0)
        assert [r["row_index"] for r in table.where("is_repeat").collect()] == [7]
        assert table.count() == n and "a" not in table.columns and "bp_a_rel__mean" in table.columns
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError, match="names 64 features where 96"):
        read_wide_csv(spark, str(path), 3, 32)


def test_inventory_and_manifest_from_files(spark, folder):
    from windrow.sources import headers as hd

    root, _ = folder
    files = hd.recording_files(spark, str(root))
    sizes = {r["path"].rsplit("/", 1)[-1]: r["length"] for r in files.select("path", "length").collect()}
    assert set(sizes) == {f"chb01_0{i}.edf" for i in range(1, 6)} and sizes["chb01_05.edf"] == 5
    got = {r["record_id"]: r for r in hd.manifest(files, f"file:{root}").collect()}
    assert got["chb01_01"]["rel"] == "chb01/chb01_01.edf" and got["chb01_01"]["case_id"] == "chb01"
    assert got["chb01_01"]["size_matches_header"] and not got["chb01_03"]["size_matches_header"]
    assert got["chb01_01"]["dropped_duplicate"] == ["FZ-CZ"] and got["chb01_01"]["dropped_non_eeg"] == ["ECG"]
    assert "fixed part" in got["chb01_05"]["error"]
