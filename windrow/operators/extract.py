"""Features of whole recordings: filter, cut and featurise block by block, then label and store."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.config import Settings
from windrow.functions import kernels
from windrow.functions.arrow_kernels import by_length
from windrow.operators.features import aggregated_names, per_channel_names
from windrow.operators.labels import case_of
from windrow.operators.quality import refusal_reason
from windrow.operators.windows import label_windows, stamp_keys, window_count
from windrow.session import pinned
from windrow.sources.recordings import (
    HEADER_ARROW,
    HEADER_SCHEMA,
    BlockPlan,
    block_dicts,
    block_list,
    blocks_of_contents,
    blocks_of_files,
    header_row,
    nested,
    recording_headers,
)

CLEAN_SCHEMA = (
    "record_id string, block_idx int, block_start long, fs double, channels array<string>, "
    "samples array<array<float>>"
)
FEATURE_SCHEMA = (
    "record_id string, window_idx int, channels array<string>, features array<array<float>>, error string"
)

FEATURE_NAMES = ["record_id", "window_idx", "channels", "features", "error"]


def clean_block(block: dict, settings: Settings) -> np.ndarray:
    """A block with halos, filtered."""
    x = block["samples"]
    absent = np.isnan(x).any(axis=-1)
    signal = settings.signal
    y = kernels.zero_phase(np.where(absent[:, None], 0.0, x), block["fs"], signal.notch_hz, signal.bandpass).astype(np.float32)
    y[absent] = np.nan
    return y


def block_features(block: dict, settings: Settings, halo_sec: float) -> pa.RecordBatch | None:
    """Feature vectors of the windows that begin in a block.

    The halo makes the block's samples equal to those of the filtered recording; it must hold a
    window besides the filter's reach.
    """
    spec, feats = settings.windowing, settings.features
    size, hop = spec.length_samples, spec.stride_samples
    lo, hi = block["block_start"], block["block_start"] + block["block_len"]
    idx = np.arange(-(-lo // hop), -(-hi // hop))
    idx = idx[idx * hop + size <= block["n_samples"]]
    if not len(idx):
        return None
    y = clean_block(block, settings)
    at = idx * hop - lo + block["halo_left"]
    cut = y[:, at[:, None] + np.arange(size)].swapaxes(0, 1)
    f = kernels.features(cut, block["fs"], dict(feats.bands), feats.welch_nperseg, feats.welch_noverlap)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block["record_id"]] * len(idx)),
            pa.array(idx.astype(np.int32)),
            pa.array([block["channels"]] * len(idx), pa.list_(pa.string())),
            nested(f),
            pa.nulls(len(idx), pa.string()),
        ],
        names=FEATURE_NAMES,
    )


def failure(block: dict) -> pa.RecordBatch:
    """The row of a block that could not be read: its error, and no window."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block["record_id"]]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.string())),
            pa.nulls(1, pa.list_(pa.list_(pa.float32()))), pa.array([block["error"]]),
        ],
        names=FEATURE_NAMES,
    )


def batches_of(blocks, settings: Settings, halo_sec: float):
    """Feature rows of blocks; a block that cannot be read gives its error row and the rest goes on."""
    for block in blocks:
        if block["error"]:
            yield failure(block)
        elif _usable(block, settings):
            out = block_features(block, settings, halo_sec)
            if out is not None:
                yield out


def with_failures(states: DataFrame, features: DataFrame) -> DataFrame:
    """Ledger rows in which a recording with a failed block is ``failed``, whatever its header said."""
    broken = features.where("error IS NOT NULL").groupBy("record_id").agg(F.min("error").alias("__error"))
    bad = F.col("__error").isNotNull() & (F.col("state") == "extracted")
    return states.join(broken, "record_id", "left").select(
        *[
            F.when(bad, F.lit("failed")).otherwise(F.col("state")).alias(c) if c == "state"
            else F.when(bad, F.col("__error")).otherwise(F.col("error")).alias(c) if c == "error"
            else F.when(~bad, F.col("n_windows")).alias(c) if c == "n_windows"
            else F.col(c)
            for c in states.columns
        ]
    )


def _usable(block: dict, settings: Settings) -> bool:
    return not block["error"] and abs(block["fs"] - settings.signal.sample_rate) <= 1e-6


def features_of_files(headers: DataFrame, plan: BlockPlan, settings: Settings) -> DataFrame:
    """Feature vectors per window and channel of the files in a header table.

    Each task reads its blocks, filters and featurises them; samples never leave the task and
    nothing is shuffled but the (path, block) list.
    """

    def run(batches):
        for batch in batches:
            yield from batches_of(blocks_of_files(batch, plan), settings, plan.halo_sec)

    return block_list(headers).mapInArrow(run, FEATURE_SCHEMA)


def features_of_contents(files: DataFrame, plan: BlockPlan, settings: Settings) -> DataFrame:
    """The same for recordings already loaded as ``path, content``."""

    def run(batches):
        for batch in batches:
            yield from batches_of(blocks_of_contents(batch, plan), settings, plan.halo_sec)

    return files.select("path", "content").mapInArrow(run, FEATURE_SCHEMA)


def filter_blocks(blocks: DataFrame, settings: Settings, halo_sec: float = 40.0) -> DataFrame:
    """Filtered samples of the blocks without their halos, as float."""
    schema = pa.schema([
        ("record_id", pa.string()), ("block_idx", pa.int32()), ("block_start", pa.int64()),
        ("fs", pa.float64()), ("channels", pa.list_(pa.string())),
        ("samples", pa.list_(pa.list_(pa.float32()))),
    ])

    def run(batches):
        for batch in batches:
            for block in block_dicts(batch):
                y = clean_block(block, settings)
                core = y[:, block["halo_left"] : block["halo_left"] + block["block_len"]]
                head = [pa.array([block[f.name]], f.type) for f in list(schema)[:-1]]
                yield pa.RecordBatch.from_arrays([*head, nested(core[None])], schema=schema)

    return blocks.where("error IS NULL").mapInArrow(run, CLEAN_SCHEMA)


def content_headers(files: DataFrame, plan: BlockPlan) -> DataFrame:
    """Header rows of recordings already loaded as ``path, content``."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = memoryview(content.as_buffer())
                row = header_row(lambda at, n, data=data: bytes(data[at : at + n]), path, plan)
                yield pa.RecordBatch.from_pylist([row], HEADER_ARROW)

    return files.select("path", "content").mapInArrow(run, HEADER_SCHEMA)


def record_states(headers: DataFrame, settings: Settings) -> DataFrame:
    """One ledger row per recording: its size, channels, windows, and why it was refused if it was."""
    none = F.array().cast("array<string>")
    n = window_count(F.col("n_samples"), settings.windowing)
    rule = refusal_reason(
        none, F.size(F.coalesce("channels", none)), F.col("fs"),
        float(settings.signal.sample_rate), n,
    )
    refused = F.col("error").rlike("^(missing_channels|no_usable_channels|unexpected_sample_rate)")
    failed = F.col("error").isNotNull() & ~refused
    reason = F.when(F.col("error").isNull(), rule).when(refused, F.col("error"))
    return headers.select(
        "record_id",
        "path",
        F.when(failed, "failed").when(reason.isNotNull(), "skipped").otherwise("extracted").alias("state"),
        reason.alias("reason"),
        F.when(failed, F.col("error")).alias("error"),
        "n_samples",
        (F.col("n_samples") / F.nullif(F.col("fs"), F.lit(0.0))).alias("duration_sec"),
        F.col("channels").alias("channel_labels"),
        F.when(reason.isNull() & ~failed, n.cast("int")).alias("n_windows"),
    )


def feature_table(
    features: DataFrame, labelled: DataFrame, settings: Settings, view: str
) -> DataFrame:
    """Labelled key columns with the columns of one view, both by array position in the row."""
    names = settings.features.names
    joined = labelled.join(features.drop("error"), ["record_id", "window_idx"])
    keys = [c for c in labelled.columns if c not in ("record_id", "window_idx")]
    head = ["record_id", "window_idx", *keys]
    if view == "per_channel":
        channels = list(settings.signal.canonical_channels)
        at = lambda c: F.col("features")[F.array_position("channels", c).cast("int") - 1]
        cols = [
            F.get(at(c), F.lit(i)).alias(name)
            for c, i, name in zip(
                [c for c in channels for _ in names],
                list(range(len(names))) * len(channels),
                per_channel_names(channels, names),
            )
        ]
        return joined.select(*head, *cols)
    stats = across_channels(F.col("features"), len(names))
    wide = joined.withColumn("__s", stats)
    return wide.select(
        *head, *[F.col("__s")[i].alias(n) for i, n in enumerate(aggregated_names(names))]
    )


def across_channels(features: Column, n_features: int) -> Column:
    """The cross-channel statistics of each feature, as array<float>."""

    @F.arrow_udf("array<float>")
    def run(column: pa.Array) -> pa.Array:
        flat = pa.ListArray.from_arrays(
            pa.array(column.offsets.to_numpy() * n_features, pa.int32()), column.values.values
        )
        out = by_length(
            flat, lambda x: kernels.across_channels(x.reshape(len(x), -1, n_features))
        )
        return pa.array(out, pa.list_(pa.float32()))

    return run(features)


def extract_files(
    spark: SparkSession, root: str, settings: Settings, intervals: DataFrame, registry: DataFrame,
    view: str = "aggregated", disputed: DataFrame | None = None,
) -> DataFrame:
    """Recordings under ``root`` to a labelled feature table, case and subject from the record id."""
    plan = BlockPlan(tuple(settings.signal.canonical_channels), settings.data.on_missing_channel)
    headers = pinned(recording_headers(spark, root, plan))
    vectors = pinned(features_of_files(headers, plan, settings))
    states = with_failures(record_states(headers, settings), vectors)
    return labelled_features(states, vectors, settings, intervals, registry, view, disputed)


def labelled_features(
    states: DataFrame, features: DataFrame, settings: Settings, intervals: DataFrame,
    registry: DataFrame, view: str, disputed: DataFrame | None = None,
) -> DataFrame:
    """Window features joined with their labels and keys. Truth is joined, never shipped to tasks."""
    records = states.where("state = 'extracted'").select(
        "record_id", "n_samples", case_of(F.col("record_id")).alias("case_id")
    )
    records = stamp_keys(records, registry, settings.extraction_hash, settings.data.source)
    labelled = label_windows(records, intervals, settings.windowing, disputed).drop("n_samples")
    return feature_table(features, labelled, settings, view)
