"""Text and binary sources, channels, registry, splits, ledger."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from windrow.functions import text as tx
from windrow.operators import channels as ch
from windrow.operators import labels as lb
from windrow.operators import ledger as lg
from windrow.operators import quality as ql
from windrow.operators import splits as sp
from windrow.sources import annotations as an
from windrow.sources import headers as hd
from windrow.sources import recordings as rec
from windrow.sources import textual as tt


def lines(spark, *texts):
    rows = [("f", i, x) for t in texts for i, x in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no int, line string")


SUMMARY = """Data Sampling Rate: 256 Hz
Channel 1: FP1-F7

File Name: chb09_06.edf
File Start Time: 25:01:02
Number of Seizures in File: 1
Seizure Start Time: 12231 seconds
Seizure End Time: 12295 seconds
File Name: chb09_08.edf
Number of Seizures in File: 2
Seizure 1 Start Time: 2951 seconds
Seizure 1 End Time: 3030 seconds
Seizure 2 Start Time: 9196 seconds
Seizure 1 End Time: 9267 seconds
Channels changed:
File Name: chb17a_03.EDF
Number of Seizures in File: 0"""


def test_summary_variants(spark):
    got = tt.summary_intervals(lines(spark, SUMMARY)).orderBy("record_id", "seizure_idx").collect()
    assert [(r["record_id"], r["start_sec"], r["end_sec"]) for r in got] == [
        ("chb09_06", 12231, 12295), ("chb09_08", 2951, 3030), ("chb09_08", 9196, 9267),
    ]
    blocks = {r["record_id"]: r for r in tt.summary_blocks(lines(spark, SUMMARY)).collect()}
    assert set(blocks) == {"chb09_06", "chb09_08", "chb17a_03"}
    assert len(blocks["chb09_08"]["anomalies"]) == 1 and blocks["chb17a_03"]["n_declared"] == 0
    assert all(b["error"] is None for b in blocks.values())
    assert tt.require_clean_summary(tt.summary_blocks(lines(spark, SUMMARY))).count() == 3


@pytest.mark.parametrize("bad,what", [
    ("Number of Seizures in File: 1\nSeizure Start Time: 5 seconds", "start times vs"),
    ("Number of Seizures in File: 2\nSeizure Start Time: 5 seconds\nSeizure End Time: 9 seconds", "declares 2"),
    ("Number of Seizures in File: 1\nSeizure Start Time: 9 seconds\nSeizure End Time: 5 seconds", "end 5.0 <= start 9.0"),
    ("Number of Seizures in File: 0\nSeizure onset at 5", "unrecognised"),
])
def test_summary_errors_are_rows_and_strict_mode_fails(spark, bad, what):
    blocks = tt.summary_blocks(lines(spark, "File Name: chb01_01.edf\n" + bad))
    assert what in blocks.head()["error"]
    with pytest.raises(PySparkException):
        tt.require_clean_summary(blocks).collect()


GOLDEN = bytes.fromhex("00ECFFFFFFFF0100005817FC" + b"## time resolution: 256".hex() + "00"
                       + "00EC0B0000B40080" + "00EC00000028" + "0084" + "0000")


def test_annotation_golden_bytes(spark):
    df = spark.createDataFrame([("d/chb01_03.edf.seizures", GOLDEN)], "path string, content binary")
    got = an.annotation_seconds(an.decode_annotations(df)).collect()
    assert [tuple(r) for r in got] == [("chb01_03", 1, 2996, 3036)]


@pytest.mark.parametrize("tail,what", [
    ("00EC0B00", "inside a skip"), ("0080" + "0000", "unterminated"), ("0084" + "0000", "offset without"),
    ("0080" + "0080" + "0000", "alternate"), ("0080" + "0084" + "0000", "<= onset"),
])
def test_bad_annotations_become_rows(spark, tail, what):
    df = spark.createDataFrame([("x", bytes.fromhex("0100" + tail)), ("ok", GOLDEN)], "path string, content binary")
    got = {r["path"]: r["error"] for r in an.decode_annotations(df).collect()}
    assert what in got["x"] and got["ok"] is None


def test_cross_validation(spark):
    schema = "record_id string, start_sec long, end_sec long"
    a = spark.createDataFrame([("a", 10, 20), ("b", 10, 20), ("c", 5, 9)], schema)
    b = spark.createDataFrame([("a", 11, 20), ("b", 410, 20), ("d", 1, 2)], schema)
    got = sorted(r["problem"] for r in lb.cross_validate(a, b).collect())
    assert got == [
        "b: interval 1 is 10..20 against 410..20",
        "c: 1 against 0 intervals",
        "d: 0 against 1 intervals",
    ]
    assert lb.cross_validate(a, a).count() == 0


def test_registry(spark):
    info = tt.subject_info(lines(spark, "Case\tGender\tAge\n\nchb01\tF\t 11 \nchb02\tM\tx"))
    reg = lb.with_demographics(lb.case_registry(spark), info)
    facts = lb.require_registry(reg).head()
    assert (facts["n_cases"], facts["n_subjects"]) == (24, 23)
    assert reg.where("case_id = 'chb02'").head()["age"] is None
    with pytest.raises(PySparkException, match="share the subject"):
        broken = reg.withColumn(
            "subject_id", F.when(F.col("case_id") == "chb21", "sub21").otherwise(F.col("subject_id"))
        )
        lb.require_registry(broken, n_subjects=24).collect()


def test_record_ids(spark):
    df = spark.createDataFrame([(x,) for x in ("chb17a_03", "chb02_16+", "chb1_01", "other")], "r string")
    got = {r[0]: r[1] for r in df.select("r", lb.case_of(F.col("r"))).collect()}
    assert got == {"chb17a_03": "chb17", "chb02_16+": "chb02", "chb1_01": None, "other": None}
    with pytest.raises(PySparkException, match="unrecognised record id"):
        df.select(lb.case_of(F.col("r"), strict=True)).collect()


def test_expected_totals_are_asserted(spark):
    schema = "record_id string, case_id string"
    rows = spark.createDataFrame([("a", "c1"), ("b", "c2")], schema)
    totals = lb.interval_totals(rows, rows, "c2")
    assert lb.require_expected_totals(totals, 2, 2, 1).count() == 1
    with pytest.raises(PySparkException, match="expected 3, got 2"):
        lb.require_expected_totals(totals, 3, 2, 1).collect()


def test_channel_classes(spark):
    raw = ["FP1-F7", "T8-P8", "t8 - p8", "ECG", "-", "FOO-BAR", "CZ-CZ", "VNS", None]
    got = ch.with_classes(spark.createDataFrame([(raw,)], "labels array<string>")).head()
    assert got["kept"] == ["FP1-F7", "T8-P8"] and got["duplicate"] == ["t8 - p8"]
    assert got["non_eeg"] == ["ECG", "-", "VNS", None] and got["unrecognised"] == ["FOO-BAR", "CZ-CZ"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("chb02/chb02_16+.edf",)], "p string")
    p = F.col("p")
    got = df.select(tx.file_stem(p), tx.parent_folder(p), tx.quoted_path(p)).head()
    assert tuple(got) == ("chb02_16+", "chb02", "chb02/chb02_16%2B.edf")
    sums = tt.checksum_list(lines(spark, "A" * 64 + "  *./x/y.edf\nshort z\n"))
    assert tuple(sums.head()) == ("x/y.edf", "a" * 64)


def test_header_errors(spark):
    from recording_files import recording

    good = recording(["FP1-F7"], 4, 2, [[0.0] * 8])
    rows = [("g", len(good), good), ("s", 10, b"x" * 10), ("t", 300, good[:300]),
            ("m", 9, recording(["FP1-F7"], 4, 2, [[0.0] * 8], declared=999))]
    df = spark.createDataFrame(rows, "path string, length long, content binary")
    got = {r["path"]: r["error"] for r in hd.parse_headers(df).collect()}
    assert got["g"] is None and "fixed part" in got["s"] and "cut at" in got["t"] and "says it has" in got["m"]
    row = hd.derived_fields(hd.parse_headers(df.where("path = 'g'"))).head()
    assert row["duration_sec"] == 2.0 and row["sample_rates"] == [4.0] and row["size_matches_header"]


def test_headers_without_usable_records_are_error_rows(spark):
    """A record length of zero or below, or no signals, makes an error row and the job goes on."""
    from recording_files import recording

    good = recording(["FP1-F7"], 4, 2, [[0.0] * 8])
    put = lambda at, field: good[:at] + field.ljust(8 if at == 244 else 4) + good[at + (8 if at == 244 else 4) :]
    files = {"good": good, "zero": put(244, b"0"), "minus": put(244, b"-1"), "word": put(244, b"x"), "none": put(252, b"0")}
    df = spark.createDataFrame([(f"c/{k}.edf", len(v), v) for k, v in files.items()], "path string, length long, content binary")
    got = {r["record_id"]: r["error"] for r in hd.manifest(df).collect()}
    assert {k for k, v in got.items() if v} == {"zero", "minus", "word", "none"}
    rows = {k: rec.header_row(lambda at, n, v=v: v[at : at + n], f"c/{k}.edf", rec.BlockPlan()) for k, v in files.items()}
    assert {k for k, v in rows.items() if v["error"]} == {"zero", "minus", "word", "none"}


def split_frame(spark, subjects=6, n=20):
    rows = [(f"s{s}", f"s{s}_{i}", i % 5 == 0, float(s * 100 + i)) for s in range(subjects) for i in range(n)]
    return spark.createDataFrame(rows, "subject_id string, window_uid string, pos boolean, f0 double").withColumn(
        "label", F.col("pos").cast("int")
    )


@pytest.mark.parametrize("subjects,n_val", [(6, 2), (6, 10), (2, 4), (1, 4)])
def test_folds_are_disjoint_whole_and_repeatable(spark, subjects, n_val):
    df = split_frame(spark, subjects)
    got = {parts: sorted(map(tuple, sp.held_out(df.repartition(parts), "subject_id", n_val, 1).collect())) for parts in (1, 8)}
    k = max(0, min(n_val, subjects - 2))
    assert got[1] == got[8] and len(got[1]) == subjects * (k + 1)
    for fold in range(subjects):
        roles = [r for f, _, r in got[1] if f == fold]
        assert roles.count("test") == 1 and roles.count("val") == k
    assert sp.require_disjoint(sp.held_out(df, "subject_id", n_val, 1), "subject_id").count() == subjects * (k + 1)


def test_training_rows_leave_out_held_out_subjects(spark):
    df = split_frame(spark)
    folds = sp.held_out(df, "subject_id", 2, 1)
    out = {r["subject_id"] for r in folds.where("fold_idx = 3").collect()}
    kept = {r["subject_id"] for r in sp.training_rows(df, folds, "subject_id", 3).select("subject_id").distinct().collect()}
    assert out | kept == {f"s{i}" for i in range(6)} and not out & kept


def test_random_split_sizes(spark):
    got = sp.random_split(split_frame(spark), "window_uid", 3, [("train", 0.8), ("test", 0.2)])
    assert {r["role"]: r["count"] for r in got.groupBy("role").count().collect()} == {"train": 96, "test": 24}


def test_downsampling_keeps_positives(spark):
    df = split_frame(spark)
    out = sp.downsample_negatives(df, 2, 1, "window_uid")
    assert out.where("label = 1").count() == 24 and out.where("label = 0").count() == 48
    assert sp.downsample_negatives(df, None, 1, "window_uid").count() == df.count()
    assert sp.downsample_negatives(df.where("label = 0"), 3, 1, "window_uid").count() == 3


def test_duplicates_are_refused(spark):
    df = split_frame(spark)
    assert ql.require_deduplicated(df, ["f0"]).count() == 1
    with pytest.raises(PySparkException, match="repeat the features"):
        ql.require_deduplicated(df.unionByName(df.limit(1)), ["f0"]).collect()


@pytest.mark.parametrize("chunk", [4, 4096])
def test_pseudo_records(spark, chunk):
    seq = "0001100000110011111000"
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(seq)], "row_index long, label int")
    got = [r["pseudo_record"] for r in sp.pseudo_records(df, chunk).orderBy("row_index").collect()]
    # cuts at the middle of the zero runs 5-9 and 12-13
    assert got == [0] * 7 + [1] * 6 + [2] * 9


@pytest.mark.parametrize("fan", [2, 3])
def test_pseudo_records_of_a_long_line_in_levels(spark, fan):
    """Runs over many chunks, and cuts counted over levels of chunks, against a plain walk."""
    import random

    r = random.Random(fan)
    seq = "".join(c * r.choice([1, 2, 9, 40]) for _ in range(14) for c in "01")
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(seq)], "row_index long, label int").repartition(5)
    # fan ** 3 blocks of chunks span the line
    out = sp.pseudo_records(df, chunk=len(seq) // fan**3 + 1, fan=fan)
    got = [x["pseudo_record"] for x in out.orderBy("row_index").collect()]
    want, n, i = [0] * len(seq), 0, 0
    cuts = []
    while i < len(seq):
        j = i
        while j < len(seq) and seq[j] == seq[i]:
            j += 1
        if seq[i] == "0" and i > 0 and j < len(seq):
            cuts.append(i + (j - i) // 2)
        i = j
    for k in range(len(seq)):
        n += k in cuts
        want[k] = n
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_repeats_keep_the_first_of_a_large_group(spark):
    df = spark.range(1000).select(F.col("id").alias("row_index"), F.when(F.col("id") < 700, "x").otherwise(F.col("id").cast("string")).alias("row_hash"))
    out = sp.mark_repeats(df)
    assert out.where("is_repeat").count() == 699 and not out.where("row_index = 0").head()["is_repeat"]


def test_delete_audit_needs_every_field(spark):
    schema = ("record_id string, case_id string, checksum_verified boolean, n_samples long, duration_sec double, "
              "channel_labels array<string>, channel_stats map<string,double>, features_path string, n_windows int")
    full = ("a", "chb05", True, 1, 1.0, ["x"], {"x": 1.0}, "p", 1)
    rows = [full] + [("m%d" % i, *full[1 : 2 + i], None, *full[3 + i :]) for i in range(7)]
    rows += [("e", "chb05", True, 1, 1.0, [], {}, "p", 1), ("k", "chb12", None, None, None, None, None, None, None)]
    got = {r["record_id"]: r["missing_fields"] for r in lg.delete_audit(spark.createDataFrame(rows, schema)).collect()}
    assert "a" not in got and "k" not in got and got["e"] == ["channel_labels", "channel_stats"]
    assert sorted(sum((got[f"m{i}"] for i in range(7)), [])) == sorted(lg.fv.REQUIRED_BEFORE_DELETE)


def test_checksum_verdicts(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "rel string, digest string")
    sums = spark.createDataFrame([("a", "1"), ("b", "x")], "rel string, sha256 string")
    got = {r["rel"]: (r["checksum_verified"], r["state"]) for r in lg.checksum_verdict(files, sums).collect()}
    assert got == {"a": (True, "downloaded"), "b": (False, "failed"), "c": (False, "downloaded")}
