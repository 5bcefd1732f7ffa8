"""Recording headers (fixed-width ASCII) parsed with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.text import file_stem, parent_folder
from windrow.operators.channels import classify

FIXED_BYTES = 256
SIGNAL_BYTES = 256

# Fixed values: (field, first byte counted from 1, width) of the fixed part.
FIXED_FIELDS = [
    ("version", 1, 8), ("start_date", 169, 8), ("start_time", 177, 8), ("declared_bytes", 185, 8),
    ("n_records", 237, 8), ("record_duration_sec", 245, 8), ("n_signals", 253, 4),
]
# Fixed values: (field, width) of the per-signal blocks, in file order.
SIGNAL_FIELDS = [
    ("labels", 16), ("transducers", 80), ("units", 8), ("phys_min", 8), ("phys_max", 8),
    ("dig_min", 8), ("dig_max", 8), ("prefilter", 80), ("samples_per_record", 8), ("reserved", 32),
]
NUMERIC = {"phys_min", "phys_max", "dig_min", "dig_max"}


def recording_files(spark: SparkSession, root: str) -> DataFrame:
    """Inventory of recordings; the contents are not read unless selected."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.edf")
        .load(root)
    )


def _text(content: Column, start: Column, width: int) -> Column:
    return F.trim(F.decode(F.substring(content, start, F.lit(width)), "US-ASCII"))


def _signal_field(content: Column, ns: Column, skip: int, width: int) -> Column:
    base = F.lit(FIXED_BYTES + 1) + ns * skip
    return F.transform(
        F.sequence(F.lit(0), ns - 1), lambda i: _text(content, base + i * width, width)
    )


def parse_headers(files: DataFrame) -> DataFrame:
    """Header fields of each file (``path``, ``length``, ``content`` at least the header).

    ``error`` tells a truncated header or a declared size that disagrees with the signal count.
    """
    c = F.col("content")
    fixed = files.select(
        "path",
        F.col("length").cast("long").alias("file_bytes"),
        "content",
        *[_text(c, F.lit(start), width).alias(name) for name, start, width in FIXED_FIELDS],
    ).withColumns(
        {
            "declared_bytes": F.col("declared_bytes").try_cast("int"),
            "n_records": F.col("n_records").try_cast("long"),
            "record_duration_sec": F.col("record_duration_sec").try_cast("double"),
            "n_signals": F.col("n_signals").try_cast("int"),
        }
    )
    ns = F.col("n_signals")
    need = ns * SIGNAL_BYTES + FIXED_BYTES
    have = F.length("content")
    error = (
        F.when(have < FIXED_BYTES, F.format_string("%d bytes are fewer than the fixed part of a header", have))
        .when(ns.isNull() | (ns < 1), F.lit("the number of signals cannot be read"))
        .when(have < need, F.format_string("header cut at byte %d of %d", have, need))
        .when(
            F.col("declared_bytes").isNull() | (F.col("declared_bytes") != need),
            F.format_string("header says it has %d bytes but has %d", "declared_bytes", need),
        )
        .when(
            F.coalesce(F.col("record_duration_sec"), F.lit(0.0)) <= 0, F.lit("no usable length of a data record")
        )
    )
    good = fixed.withColumn("error", error).withColumn("header_bytes", need)
    columns, skip = {}, 0
    for name, width in SIGNAL_FIELDS:
        field = _signal_field(c, ns, skip, width)
        if name in NUMERIC:
            field = F.transform(field, lambda x: x.try_cast("double"))
        elif name == "samples_per_record":
            field = F.transform(field, lambda x: x.try_cast("int"))
        columns[name] = F.when(F.col("error").isNull(), field)
        skip += width
    return good.withColumns(columns).drop("content", "transducers", "reserved", "declared_bytes")


def derived_fields(headers: DataFrame) -> DataFrame:
    """Duration, rates, the common rate (-1 when mixed), expected size and size agreement."""
    rates = F.transform("samples_per_record", lambda n: F.try_divide(n.cast("double"), F.col("record_duration_sec")))
    total = F.aggregate("samples_per_record", F.lit(0).cast("long"), lambda a, n: a + n)
    distinct = F.array_distinct("sample_rates")
    return (
        headers.withColumn("sample_rates", rates)
        .withColumns(
            {
                "duration_sec": F.col("n_records") * F.col("record_duration_sec"),
                "mixed_sample_rates": F.size(distinct) > 1,
                "sample_rate": F.when(F.size(distinct) == 1, distinct[0]).otherwise(F.lit(-1.0)),
                "expected_file_bytes": F.col("header_bytes") + F.col("n_records") * total * 2,
            }
        )
        .withColumn("size_matches_header", F.col("file_bytes") == F.col("expected_file_bytes"))
    )


def manifest(files: DataFrame, root: str = "") -> DataFrame:
    """One row per file: header facts, label classes, size agreement, or the error."""
    out = derived_fields(parse_headers(files))
    rel = F.regexp_replace("path", "^" + root.rstrip("/") + "/", "") if root else F.col("path")
    classes = classify(F.col("labels"))
    return out.withColumn("rel", rel).select(
        "rel",
        file_stem(F.col("rel")).alias("record_id"),
        parent_folder(F.col("rel")).alias("case_id"),
        "n_signals", "n_records", "record_duration_sec", "duration_sec", "sample_rate",
        "mixed_sample_rates", "header_bytes", "expected_file_bytes", "file_bytes",
        "size_matches_header", "start_date", "start_time",
        F.col("labels").alias("labels_raw"),
        classes["kept"].alias("labels_kept"),
        F.size(classes["kept"]).alias("n_kept"),
        classes["duplicate"].alias("dropped_duplicate"),
        classes["non_eeg"].alias("dropped_non_eeg"),
        classes["unrecognised"].alias("dropped_unrecognised"),
        "error",
    )


def describe_rejected(headers: DataFrame) -> DataFrame:
    """What a refused file holds: signals, rates, minutes, labels that look like EEG at >= 100 Hz."""
    from windrow.fixed_values import ELECTRODES
    from windrow.operators.channels import is_scalp, normalise

    out = derived_fields(headers)
    looks = lambda label: (
        F.lower(label).contains("eeg")
        | is_scalp(normalise(label))
        | F.upper(F.trim(label)).isin(ELECTRODES)
    )
    eeg = F.transform(
        F.filter(
            F.arrays_zip("labels", "sample_rates"),
            lambda s: (s["sample_rates"] >= 100) & looks(s["labels"]),
        ),
        lambda s: s["labels"],
    )
    return out.select(
        "path",
        "n_signals",
        "labels",
        F.array_sort(
            F.array_distinct(F.transform("sample_rates", lambda r: F.round(r, 1)))
        ).alias("rates"),
        (F.col("duration_sec") / 60).alias("minutes"),
        eeg.alias("eeg_like"),
    )
