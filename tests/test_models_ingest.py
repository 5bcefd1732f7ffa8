"""Models on small frames, streaming ingest against batch, sinks, and rules about the code."""

import re
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recording_files import recording
from test_signals import LABELS, SMALL
from windrow.config import Settings, Splits, Training, Windowing
from windrow.operators import ledger as lg
from windrow.operators import models as md
from windrow.operators import report as rp
from windrow.operators.labels import case_registry
from windrow.sources import sinks
from windrow.streaming import ingest as ig


@pytest.fixture(scope="module")
def learn(spark):
    """Four subjects; the second feature tells the label, in stretches of three windows."""
    rng = np.random.default_rng(0)
    rows = []
    for s in range(4):
        for i in range(60):
            y = int(i % 20 in (5, 6, 7))
            rows.append((f"s{s}_{i:06d}", f"s{s}", f"r{s}", i, i * 10.0, i * 10.0 + 10, y,
                         float(rng.normal()), float(rng.normal(scale=0.3) + 3 * y), "src"))
    return spark.createDataFrame(
        rows, "window_uid string, subject_id string, record_id string, window_idx int, t_start_sec double, "
        "t_end_sec double, label int, f0 double, f1 double, source string",
    ).persist()


@pytest.fixture(scope="module")
def spans(spark):
    rows = [(f"r{s}", j + 1, j * 200 + 50, j * 200 + 80) for s in range(4) for j in range(3)]
    return spark.createDataFrame(rows, "record_id string, seizure_idx long, start_sec long, end_sec long")


SET = Settings(
    windowing=Windowing(10.0, 10.0, 0.5, 0.0, sample_rate=1), splits=Splits(n_val_subjects=1),
    training=Training(models=("dummy", "logreg"), negative_downsample_ratio=5),
)


def test_grouped_evaluation_finds_the_signal(learn, spans):
    detail = md.grouped_evaluation(learn, ["f0", "f1"], SET, spans)
    got = {(r["fold_idx"], r["model"]): r for r in detail.collect()}
    assert len(got) == 8
    for fold in range(4):
        good, dull = got[fold, "logreg"], got[fold, "dummy"]
        assert good["n_detected"] == 3 == good["n_true_events"] and good["pr_auc"] > 0.9
        # a constant score always alarms under the joint choice
        assert dull["threshold"] == 0.0 and dull["time_in_alarm_frac"] == 1.0 and dull["val_event_f2"] == 0.0
        assert good["n"] == 60 and good["n_val"] == 60 and good["test_subject"] == dull["test_subject"]
    assert {got[fold, "logreg"]["test_subject"] for fold in range(4)} == {f"s{s}" for s in range(4)}
    table = {r["model"]: r for r in rp.model_table(detail).collect()}
    assert table["logreg"]["n_detected"] == 12 and rp.markdown(rp.model_table(detail)).count() == rp.model_table(detail).count() + 2


def test_logistic_regression_matches_its_objective(learn):
    """The fitted point is a minimum of the balanced, L2-penalised loss on standardised features."""
    cols = ["f0", "f1"]
    model = md.fit("logreg", learn, cols, 1)
    lr = model.stages[-1]
    pdf = learn.toPandas()
    x = pdf[cols].to_numpy()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    y = pdf["label"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))

    def loss(beta):
        m = z @ beta[:2] + beta[2]
        return 0.5 * (beta[:2] ** 2).sum() + (w * np.logaddexp(0, np.where(y == 1, -m, m))).sum()

    best = np.append(lr.coefficients.toArray(), lr.intercept)
    for d in np.eye(3):
        assert loss(best) <= loss(best + 1e-2 * d) + 1e-6 and loss(best) <= loss(best - 1e-2 * d) + 1e-6


def test_search_rules_and_random_contrast(learn):
    assert md.search("dummy", learn, ["f0"]) == ({}, pytest.approx(float("nan"), nan_ok=True))
    assert md.search("logreg", learn.where("subject_id = 's0'"), ["f1"])[0] == {}
    params, score = md.search("logreg", learn, ["f0", "f1"])
    assert params["C"] in (0.01, 0.1, 1.0, 10.0) and score > 0.9
    got = {r["model"]: r for r in md.random_window_evaluation(learn, ["f0", "f1"], SET).collect()}
    assert got["logreg"]["n"] == 48 and got["logreg"]["protocol"] == "random_window"


def test_export_final_fit_and_reload(spark, learn, tmp_path):
    out = md.export_scores(learn, ["f0", "f1"], SET, ["s2"], "logreg")
    assert out.count() == 60 and {r[0] for r in out.select("subject_id").distinct().collect()} == {"s2"}
    model, meta = md.final_fit(learn, ["f0", "f1"], SET, "logreg")
    row = meta.head()
    assert row["n_subjects"] == 4 and row["n_rows_available"] == 240 and row["n_rows_fitted"] == 36 + 180
    sinks.write_model(model, meta, str(tmp_path / "m"))
    again, facts = sinks.read_model(spark, str(tmp_path / "m"))
    a = {r["window_uid"]: r["score"] for r in md.score_recordings(model, learn, ["f0", "f1"]).collect()}
    b = {r["window_uid"]: r["score"] for r in md.score_recordings(again, learn, ["f0", "f1"]).collect()}
    assert a == b and facts.head()["feature_columns"] == ["f0", "f1"]
    with pytest.raises(ValueError, match="schema_mismatch"):
        md.score_recordings(model, learn.drop("f1"), ["f0", "f1"])


def test_run_log_replaces_a_fold_and_drops_nan(spark, tmp_path):
    schema = "fold_idx int, model string, metric_name string, metric_value double"
    path = str(tmp_path / "runs")
    sinks.log_metrics(spark.createDataFrame([(0, "m", "a", 1.0), (0, "m", "b", float("nan"))], schema), path, "r1")
    sinks.log_metrics(spark.createDataFrame([(1, "m", "a", 2.0)], schema), path, "r1")
    sinks.log_metrics(spark.createDataFrame([(0, "m", "a", 3.0)], schema), path, "r1")
    got = {(r["fold_idx"], r["metric_name"]): r["metric_value"] for r in sinks.read_run(spark, path, "r1").collect()}
    assert got == {(0, "a"): 3.0, (1, "a"): 2.0}


def files(folder, names, seed=0):
    rng = np.random.default_rng(seed)
    (folder / "chb01").mkdir(exist_ok=True, parents=True)
    for n in names:
        data = np.round(rng.normal(scale=50, size=(5, 64 * 20)), 1)
        (folder / "chb01" / f"{n}.edf").write_bytes(recording(LABELS, 64, 20, data))


def job(spark, out, folder, sums):
    iv = spark.createDataFrame([("chb01_01", 5.0, 9.0)], "record_id string, start_sec double, end_sec double")
    return ig.Ingest(str(out), SMALL, iv, case_registry(spark), sums, halo_sec=8.0, block_sec=6.0)


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    import hashlib

    src = tmp_path / "src"
    files(src, ["chb01_01", "chb01_02"], 1)
    (src / "chb01" / "chb01_09.edf").write_bytes(b"not a recording")
    digest = lambda n: hashlib.sha256((src / "chb01" / f"{n}.edf").read_bytes()).hexdigest()
    sums = spark.createDataFrame(
        [("chb01/chb01_01.edf", digest("chb01_01")), ("chb01/chb01_02.edf", "0" * 64)], "rel string, sha256 string"
    )
    streamed = job(spark, tmp_path / "a", src, sums)
    run = lambda: ig.ingest_stream(
        ig.recording_stream(spark, str(src), 1), streamed, str(tmp_path / "check")
    ).awaitTermination()
    run()
    files(src, ["chb01_03"], 2)
    run()
    state = {r["record_id"]: r for r in lg.latest(streamed.ledger()).collect()}
    assert {k: v["state"] for k, v in state.items()} == {
        "chb01_01": "extracted", "chb01_02": "failed", "chb01_03": "extracted", "chb01_09": "failed",
    }
    assert state["chb01_01"]["checksum_verified"] and state["chb01_02"]["reason"] == "checksum_mismatch"
    assert state["chb01_01"]["label_counts"][1] == 5 and set(state["chb01_01"]["channel_stats"]) == {"FZ-CZ", "FP1-F7", "F7-T7"}
    present = job(spark, tmp_path / "b", src, sums)
    batch = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(src))
    tally = {r["state"]: r["n"] for r in ig.ingest_present(batch, present).collect()}
    assert tally == {"extracted": 2, "failed": 2}
    for view in ("aggregated", "per_channel"):
        a = spark.read.parquet(f"{tmp_path}/a/{view}").drop("batch")
        b = spark.read.parquet(f"{tmp_path}/b/{view}").drop("batch").select(*a.columns)
        assert a.count() == b.count() == 2 * 19 and a.exceptAll(b).count() == 0
    # a repeated batch leaves the same tables
    present.process(batch.select("path", "content"), 0)
    assert spark.read.parquet(f"{tmp_path}/b/aggregated").count() == 38


def test_work_list_and_manifest_sinks(spark, tmp_path):
    work = spark.createDataFrame([(1, "a/b.edf", 5, "u", "")], "batch int, rel string, size_bytes long, url string, sha256 string")
    sinks.write_work_list(work, str(tmp_path / "w"))
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).head()["rel"] == "a/b.edf"
    man = spark.createDataFrame([("a", 1, ["x"], ["y"])], "rel string, n_signals int, labels_raw array<string>, dropped_duplicate array<string>")
    sinks.write_manifest(man, spark.createDataFrame([("x", 1)], "label string, n_files int"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/file_manifest")).columns == ["rel", "n_signals"]
    assert spark.read.json(str(tmp_path / "m/file_manifest_full")).head()["labels_raw"] == ["x"]


def test_preparation_drops_guard_relabels_and_refuses_repeats(learn):
    marked = learn.withColumns({
        "label": F.when(F.col("window_idx") % 20 == 4, -1).otherwise(F.col("label")),
        "overlap_frac": F.when(F.col("label") == 1, F.when(F.col("window_idx") % 20 == 5, 0.2).otherwise(0.9)).otherwise(0.0),
    })
    rows, columns = md.prepared(marked, ["f0", "f1"], replace(SET, training=replace(SET.training, relabel_overlap_min=0.5)))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    assert columns == ["f0", "f1"] and counts == {1: 4 * 3 * 2, 0: 4 * 60 - 4 * 3 * 2 - 4 * 3}
    with pytest.raises(PySparkException, match="repeat the features"):
        md.prepared(learn.unionByName(learn.limit(1)), ["f0", "f1"], SET)
    off = replace(SET, data=replace(SET.data, dedupe=False))
    assert md.prepared(learn.unionByName(learn.limit(1)), ["f0", "f1"], off)[0].count() == 241


def test_hashes_separate_extraction_from_training():
    a = Settings()
    b = replace(a, training=replace(a.training, models=("rf",)))
    assert a.extraction_hash == b.extraction_hash and a.full_hash != b.full_hash
    assert len(a.extraction_hash) == 12
    with pytest.raises(ValueError):
        replace(a.signal, notch_hz=())


def test_no_low_level_apis_in_the_package():
    root = Path(__file__).parent.parent / "windrow"
    banned = re.compile(r"\.rdd\b|parallelize|sparkContext|localCheckpoint|crossJoin|broadcast\(")
    # models of a proven size are sent to tasks in the text operators, which have tests of their own
    hits = [p.name for p in root.rglob("*.py") if "llm" not in p.parts and banned.search(p.read_text())]
    assert not hits


def test_every_query_has_a_note_and_oracles_belong_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(f.__doc__ for f in e.queries().values())


def test_queries_fit_all_models():
    from windrow.fixed_values import MODELS
    from windrow.plans.learning import SETTINGS

    assert set(SETTINGS.training.models) == set(MODELS) == {"dummy", "logreg", "rf", "hgb"}
