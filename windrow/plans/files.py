"""File-shaped inputs derived from the tables: label lists, headers, text and binary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.fixed_values import CANONICAL_CHANNELS
from windrow.plans import fixtures as fx
from windrow.plans.fixtures import CTES, Tables

STATES = ["pending", "downloaded", "extracted", "raw_deleted", "skipped", "failed"]
KEEP = ["c01", "c12", "c17"]
BASE_URL = "https://data.example/files/"
LABEL_RULES = [
    (c, {"FZ-CZ": "user_id % 7 <> 0", "CZ-PZ": "user_id % 40 <> 0"}.get(c, "TRUE"))
    for c in CANONICAL_CHANNELS
] + [
    ("T8-P8", "user_id % 2 = 0"),
    (" t8 - p8", "user_id % 9 = 0"),
    ("ECG", "user_id % 3 = 0"),
    ("-", "user_id % 5 = 0"),
    ("VNS", "user_id % 13 = 0"),
    ("EEG Fp1", "user_id % 11 = 0"),
    ("CZ-CZ", "user_id % 17 = 0"),
    ("FT9-FT10", "user_id % 4 = 0"),
]
CTES["fx_channels"] = (
    "SELECT *, list_filter(["
    + ", ".join(f"CASE WHEN {cond} THEN '{label}' END" for label, cond in LABEL_RULES)
    + "], lambda x: x IS NOT NULL) AS labels FROM fx_record"
)
CTES["fx_file"] = """
    SELECT user_id, record_id, case_id, subject_id,
      case_id || '/' || record_id || CASE WHEN user_id % 8 = 0 THEN '+' ELSE '' END || '.edf' AS rel,
      2592000 * (user_id % 7 + 1) * 512 AS size_bytes FROM fx_record"""
CTES["fx_sum"] = """
    SELECT rel, CASE WHEN user_id % 10 = 1 THEN sha256('other' || rel) ELSE sha256(rel) END AS sha256
    FROM fx_file WHERE user_id % 10 <> 0"""
CTES["fx_label_count"] = "SELECT record_id, label, count(*) AS n FROM fx_window GROUP BY 1, 2"
CTES["fx_ledger"] = """
    SELECT f.*, ['pending','downloaded','extracted','raw_deleted','skipped','failed'][user_id % 6 + 1] AS state,
      2592000.0::DOUBLE AS duration_sec
    FROM fx_file f"""


def channel_lists(t: Tables) -> DataFrame:
    """Per record a label list as a header could hold it."""
    entries = F.array(*[F.when(F.expr(cond), F.lit(label)) for label, cond in LABEL_RULES])
    return fx.records(t).withColumn("labels", F.array_compact(entries))


def recordings(t: Tables) -> DataFrame:
    """Files with case, size and content digest (the digest of the path stands for the content)."""
    plus = F.when(F.col("user_id") % 8 == 0, "+").otherwise("")
    return fx.records(t).select(
        "user_id", "record_id", "case_id", "subject_id",
        F.concat("case_id", F.lit("/"), "record_id", plus, F.lit(".edf")).alias("rel"),
        (F.lit(2592000) * (F.col("user_id") % 7 + 1) * 512).alias("size_bytes"),
    )


def checksum_lines(t: Tables) -> DataFrame:
    """Checksum list as text: missing for some files, wrong for some, with prefixes and junk."""
    digest = F.when(
        F.col("user_id") % 10 == 1, F.sha2(F.concat(F.lit("other"), "rel").cast("binary"), 256)
    ).otherwise(F.upper(F.sha2(F.col("rel").cast("binary"), 256)))
    prefix = F.element_at(F.array(F.lit(""), F.lit("./"), F.lit("*")), (F.col("user_id") % 3 + 1).cast("int"))
    line = F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("# "), "rel")).otherwise(
        F.concat(digest, F.lit("  "), prefix, "rel")
    )
    return recordings(t).select(line.alias("line"))


def summary_lines(t: Tables) -> DataFrame:
    """Event summaries as text, one file per case, with blank, ignored and mislabelled lines."""
    iv = fx.intervals(t)
    counts = iv.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("user_id") * 100000
    head = fx.records(t).join(counts, "user_id", "left").fillna(0, ["n"])
    row = lambda offset, text: F.struct((base + offset).alias("line_no"), text.alias("line"))
    heads = head.select(
        F.col("case_id").alias("file"),
        F.inline(
            F.array(
                row(0, F.concat(F.lit("File Name: "), "record_id", F.lit(".edf"))),
                row(1, F.lit("File Start Time: 25:10:00")),
                row(2, F.format_string("  Number of Seizures in File: %d", "n")),
                row(3, F.lit("")),
                row(4, F.lit("Channels changed:")),
            )
        ),
    )
    index = lambda i: F.when(F.col("n") == 1, F.lit("")).otherwise(F.format_string("%d ", i))
    end_idx = F.when(
        (F.col("seizure_idx") == 2) & (F.col("user_id") % 5 == 0), F.lit(1).cast("long")
    ).otherwise(F.col("seizure_idx"))
    times = (
        iv.join(counts, "user_id")
        .join(fx.records(t).select("record_id", "case_id"), "record_id")
        .select(
            F.col("case_id").alias("file"),
            F.inline(
                F.array(
                    row(
                        10 + 2 * F.col("seizure_idx"),
                        F.concat(F.lit("Seizure "), index(F.col("seizure_idx")),
                                 F.format_string("Start Time: %d seconds", "start_sec")),
                    ),
                    row(
                        11 + 2 * F.col("seizure_idx"),
                        F.concat(F.lit("seizure "), index(end_idx),
                                 F.format_string("End Time:  %d seconds", "end_sec")),
                    ),
                )
            ),
        )
    )
    return heads.unionByName(times)


def _little_endian(word: Column) -> Column:
    """Hex of a 16-bit word, low byte first."""
    h = F.lpad(F.hex(word), 4, "0")
    return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))


def annotation_contents(t: Tables, rate: int = 256) -> DataFrame:
    """Binary annotation files: rate note, then skip + mark per onset and offset, end word."""
    marks = F.inline(
        F.array(
            F.struct(F.col("start_sec").alias("at"), F.lit(32).alias("code")),
            F.struct(F.col("end_sec").alias("at"), F.lit(33).alias("code")),
        )
    )
    per_file = (
        fx.intervals(t)
        .select("record_id", marks)
        .groupBy("record_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("marks"))
    )
    delta = lambda s, i: (
        s["at"] - F.when(i > 0, F.get("marks", i - 1)["at"]).otherwise(0)
    ) * rate
    word = lambda s, i: F.concat(
        F.lit("00EC"),
        _little_endian(F.shiftright(delta(s, i).cast("long"), 16)),
        _little_endian(delta(s, i).cast("long").bitwiseAND(F.lit(65535))),
        _little_endian(s["code"] * 1024),
    )
    body = F.array_join(F.transform("marks", word), "")
    note = "## time resolution: %d" % rate
    head = "00ECFFFFFFFF" + "0100" + "0058" + f"{len(note):02X}FC" + note.encode().hex().upper()
    head += "00" if len(note) % 2 else ""
    return per_file.select(
        F.concat(F.lit("root/"), "record_id", F.lit(".edf.seizures")).alias("path"),
        F.unhex(F.concat(F.lit(head), body, F.lit("0000"))).alias("content"),
    )


def header_contents(t: Tables) -> DataFrame:
    """Header bytes of one recording per record; some truncated, some sizes off, mixed rates."""
    ns = F.size("labels")
    pad = lambda c, n: F.rpad(c.cast("string"), n, " ")
    per_signal = lambda text, n: F.repeat(F.rpad(F.lit(text), n, " "), ns)
    seconds = F.col("user_id") % 2 + 1
    spr = F.transform(
        "labels",
        lambda x, i: F.rpad(
            F.when((i == 0) & (F.col("user_id") % 6 == 0), 128 * seconds).otherwise(256 * seconds).cast("string"), 8, " "
        ),
    )
    n_records = F.col("user_id") % 5 + 720
    need = ns * 256 + 256
    header = F.concat(
        pad(F.lit("0"), 8), pad(F.lit("X"), 80), pad(F.lit("Startdate X"), 80),
        F.lit("01.01.24"), F.lit("10.00.00"), pad(need, 8), pad(F.lit(""), 44),
        pad(n_records, 8), pad(seconds, 8), pad(ns, 4),
        F.array_join(F.transform("labels", lambda x: F.rpad(x, 16, " ")), ""),
        per_signal("AgCl", 80), per_signal("uV", 8), per_signal("-800", 8), per_signal("800", 8),
        per_signal("-2048", 8), per_signal("2047", 8), per_signal("HP:0.1Hz", 80),
        F.array_join(spr, ""), per_signal("", 32),
    )
    total = F.when(F.col("user_id") % 6 == 0, ns * 256 * seconds - 128 * seconds).otherwise(ns * 256 * seconds)
    extra = F.when(F.col("user_id") % 4 == 0, 10).otherwise(0)
    cut = F.when(F.col("user_id") % 25 == 24, F.substring(header, F.lit(1), need - 100)).otherwise(header)
    return channel_lists(t).select(
        "user_id",
        F.concat("case_id", F.lit("/"), "record_id", F.lit(".edf")).alias("path"),
        (need + n_records * total * 2 + extra).alias("length"),
        cut.cast("binary").alias("content"),
    )


def ledger(t: Tables) -> DataFrame:
    """Ledger rows: an old pending row and the current one per record, some fields missing."""
    from windrow.operators.windows import label_counts

    u = F.col("user_id")
    counts = label_counts(fx.windows(t))
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (u % 6 + 1).cast("int"))
    stat = F.create_map(F.lit("FP1-F7"), F.struct(F.lit(0.0).alias("mean"), F.lit(1.0).alias("std")))
    current = (
        recordings(t)
        .join(counts, "record_id")
        .select(
            "user_id", "record_id", "case_id", "rel", state.alias("state"),
            F.when(u % 10 != 0, u % 10 != 1).alias("checksum_verified"),
            F.when(u % 15 != 0, F.lit(2592000).cast("long")).alias("n_samples"),
            F.lit(fx.DAYS30).alias("duration_sec"),
            F.when(u % 14 != 0, F.array(F.lit("FP1-F7"))).otherwise(F.array().cast("array<string>")).alias("channel_labels"),
            F.when(u % 9 != 0, stat).alias("channel_stats"),
            F.when(u % 16 != 0, F.lit("features")).alias("features_path"),
            F.lit(120).alias("n_windows"),
            "label_counts",
            F.lit(1).alias("updated"),
        )
    )
    old = current.withColumns({"state": F.lit("pending"), "updated": F.lit(0)})
    return old.unionByName(current)


RECORDING_RATE = 64


def recording_contents(t: Tables) -> DataFrame:
    """Whole recordings: one second of four channels per file, 16-bit, 0.1 µV per step."""
    digital = F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("long"))
    body = F.array_join(
        F.transform(digital, lambda v: _little_endian(v.bitwiseAND(F.lit(65535)))), ""
    )
    names = F.array(*[F.lit(c) for c in fx.SIGNAL_CHANNELS])
    place = (F.col("vec_id") % 4 + 1).cast("int")
    per_file = (
        t.embeddings.select(
            F.floor(F.col("vec_id") / 4).alias("n"),
            F.struct("vec_id", F.element_at(names, place).alias("label"), body.alias("body")).alias("s"),
        )
        .groupBy("n")
        .agg(F.array_sort(F.collect_list("s")).alias("s"))
    )
    ns = F.size("s")
    pad = lambda c, n: F.rpad(c.cast("string"), n, " ")
    each = lambda text, n: F.repeat(F.rpad(F.lit(text), n, " "), ns)
    header = F.concat(
        pad(F.lit("0"), 8), pad(F.lit("X"), 80), pad(F.lit("Startdate X"), 80), F.lit("01.01.24"),
        F.lit("10.00.00"), pad(ns * 256 + 256, 8), pad(F.lit(""), 44), pad(F.lit(1), 8),
        pad(F.lit(1), 8), pad(ns, 4),
        F.array_join(F.transform("s", lambda x: F.rpad(x["label"], 16, " ")), ""),
        each("AgCl", 80), each("uV", 8), each("-3276.8", 8), each("3276.7", 8), each("-32768", 8),
        each("32767", 8), each("", 80), each(str(RECORDING_RATE), 8), each("", 32),
    )
    content = F.unhex(
        F.concat(F.hex(header), F.array_join(F.transform("s", lambda x: x["body"]), ""))
    )
    return per_file.select(
        F.format_string("root/c00/chb01_%05d.edf", "n").alias("path"), content.alias("content")
    )
