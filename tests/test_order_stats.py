"""Percentiles by selection against NumPy, and how much a task holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import order_stats as os_

SHARES = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]


def frame(spark, groups):
    return spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs], "k string, x double")


def test_equal_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {
        "normal": rng.normal(size=999), "wide": 10.0 ** rng.uniform(-300, 300, 400) * rng.choice([-1, 1], 400),
        "close": 1e6 + rng.random(500) * 1e-3, "ties": rng.integers(-3, 4, 301), "zero": np.zeros(7), "one": np.array([-2.5]),
        "tiny": np.array([5e-324, -5e-324, 0.0, 1e-310]), "two": np.array([1.0, 2.0]),
    }
    got = {r["k"]: r["p"] for r in os_.percentiles(frame(spark, groups), ["k"], "x", SHARES).collect()}
    assert got.keys() == groups.keys()
    for k, xs in groups.items():
        for p, s in zip(got[k], SHARES):
            at = s * (len(xs) - 1)
            low, high = np.sort(xs)[[int(np.floor(at)), int(np.ceil(at))]]
            assert p == (low if low == high else low + (high - low) * (at - np.floor(at)))


def test_bins_never_fall(spark):
    rng = np.random.default_rng(1)
    xs = np.sort(np.concatenate([rng.normal(size=500), 10.0 ** rng.uniform(-320, 308, 500), -(10.0 ** rng.uniform(-320, 308, 500)), [0, np.inf, -np.inf]]))
    bins = [r[0] for r in frame(spark, {"a": xs}).orderBy("x").select(os_.bin_of(F.col("x"))).collect()]
    assert bins == sorted(bins)


def test_a_large_group_of_distinct_values(spark):
    """Ten million distinct values in one group: what is ranked at the end is a small part of a bin."""
    n = 10_000_000
    rows = spark.range(n).select(F.lit("a").alias("k"), (((F.col("id") * 7_919) % n) / 1000 - 3000).alias("x"))
    (got,) = os_.percentiles(rows, ["k"], "x", [0.05, 0.5, 0.95]).collect()
    for p, s in zip(got["p"], (0.05, 0.5, 0.95)):
        assert p == pytest.approx(s * (n - 1) / 1000 - 3000, abs=1e-9)
    widest = rows.groupBy(os_.bin_of(F.col("x"))).count().agg(F.max("count")).head()[0]
    assert widest / os_.PARTS < 100


def test_nulls_nan_and_no_rows(spark):
    rows = spark.createDataFrame([("a", None), ("a", 1.0), ("a", float("nan")), ("a", 2.0), ("b", None)], "k string, x double")
    (got,) = os_.percentiles(rows, ["k"], "x", [0.0, 0.5]).collect()
    assert got["k"] == "a" and got["p"] == [1.0, 2.0]
    assert os_.percentiles(rows.where("k = 'z'"), ["k"], "x", [0.5]).count() == 0
