"""Kernels over array columns, one Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from windrow.config import Features
from windrow.functions import kernels


def by_length(column: pa.Array, kernel) -> pa.Array:
    """Apply ``kernel`` to the rows of equal length together; one output list per row."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = [None] * len(sizes)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        block = kernel(flat[offsets[rows][:, None] + np.arange(size)])
        for r, v in zip(rows, block):
            out[r] = v
    return out


def feature_vector(samples: Column, fs: float, spec: Features) -> Column:
    """The feature vector of a window of samples, as array<float>."""
    bands = dict(spec.bands)

    @F.arrow_udf("array<float>")
    def run(column: pa.Array) -> pa.Array:
        out = by_length(
            column,
            lambda x: kernels.features(x, fs, bands, spec.welch_nperseg, spec.welch_noverlap),
        )
        return pa.array(out, pa.list_(pa.float32()))

    return run(samples)


def power_density(samples: Column, fs: float, nperseg: int, noverlap: int) -> Column:
    """Welch power density per frequency bin, as array<double>."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        out = by_length(column, lambda x: kernels.welch(x, fs, nperseg, noverlap)[1])
        return pa.array(out, pa.list_(pa.float64()))

    return run(samples)
