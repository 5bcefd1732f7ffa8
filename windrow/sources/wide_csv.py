"""Wide CSV signals: one row per window, channels × samples feature columns and a target."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.config import Settings
from windrow.fixed_values import CSV_CHANNELS, CSV_SAMPLE_RATE, CSV_SAMPLES
from windrow.functions import kernels
from windrow.operators.features import aggregated_names
from windrow.operators.splits import mark_repeats, pseudo_records


def check_header(line: str, n_features: int) -> None:
    columns = line.rstrip("\r\n").split(",")
    has_target = columns[-1].strip().lower() == "target"
    found = len(columns) - has_target
    if found != n_features:
        raise ValueError(f"the header names {found} features where {n_features} belong")
    if not has_target:
        raise ValueError("the last column is not named target")


def numbered_lines(spark: SparkSession, path: str, header: str) -> DataFrame:
    """``row_index, value`` of the data lines of a CSV file, numbered from 0 as written.

    Ids rise within a file split, so a split's first id and the lines in earlier splits give the
    number; only the list of splits is ordered, the wide lines are not shuffled.
    """
    lines = spark.read.text(path).where(F.col("value") != header).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy("file", "start")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .select("file", "start", "first_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    number = F.col("before") + F.col("id") - F.col("first_id")
    return lines.join(splits, ["file", "start"]).select(number.alias("row_index"), "value")


def parse_rows(lines: DataFrame, n_channels: int, n_samples: int) -> DataFrame:
    """``row_index, label, row_hash, samples`` of numbered lines.

    The hash is over the feature text as written, so it finds exact copies without depending on
    how numbers print. Samples are channel-major.
    """
    text = F.regexp_replace("value", r",[^,]*\r?$", "")
    numbers = F.split(text, ",").cast("array<float>")
    return lines.select(
        "row_index",
        F.trim(F.substring_index(F.regexp_replace("value", r"\r$", ""), ",", -1)).cast("int").alias("label"),
        F.md5(text).alias("row_hash"),
        numbers.alias("numbers"),
    ).select(
        "row_index",
        "label",
        "row_hash",
        F.transform(
            F.sequence(F.lit(0), F.lit(n_channels - 1)),
            lambda c: F.slice("numbers", c * n_samples + 1, n_samples),
        ).alias("samples"),
    )


def read_wide_csv(
    spark: SparkSession, path: str, n_channels: int = CSV_CHANNELS, n_samples: int = CSV_SAMPLES
) -> DataFrame:
    header = spark.read.text(path).head()[0]
    check_header(header, n_channels * n_samples)
    return parse_rows(numbered_lines(spark, path, header), n_channels, n_samples)


def csv_features(
    rows: DataFrame, settings: Settings, fs: float = CSV_SAMPLE_RATE, notch: bool = True
) -> DataFrame:
    """Aggregated feature view of wide rows, with pseudo-records and repeat marks.

    Channels have no labels here and rows no subject, so there is no per-channel view and the
    subject is null.
    """
    feats, signal = settings.features, settings.signal
    bands = dict(feats.bands)

    @F.arrow_udf("array<float>")
    def run(column: pa.Array) -> pa.Array:
        # rows of one file are equally long, so a batch is one array (rows, channels, samples)
        channels = column.flatten()
        values = channels.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if not len(values):
            return pa.nulls(len(column), pa.list_(pa.float32()))
        x = values.reshape(len(column), len(channels) // len(column), -1)
        if notch:
            x = kernels.zero_phase(x, fs, signal.notch_hz, signal.bandpass)
        f = kernels.features(x.astype(np.float32), fs, bands, feats.welch_nperseg, feats.welch_noverlap)
        return pa.array(list(kernels.across_channels(f)), pa.list_(pa.float32()))

    names = aggregated_names(feats.names)
    vectors = rows.select("row_index", run(F.col("samples")).alias("f"))
    keys = mark_repeats(pseudo_records(rows.select("row_index", "label", "row_hash")))
    return keys.join(vectors, "row_index").select(
        "row_index", "label", "pseudo_record", "is_repeat",
        F.lit("csv_scaled").alias("source"),
        F.lit(settings.extraction_hash).alias("config_hash"),
        F.lit(None).cast("string").alias("subject_id"),
        *[F.col("f")[i].alias(n) for i, n in enumerate(names)],
    )
