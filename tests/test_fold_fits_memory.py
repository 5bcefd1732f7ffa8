"""What a piece of work holds does not grow with the table."""

import tracemalloc

import numpy as np

from test_fold_fits import FITS, rows, scores  # noqa: F401
from test_fold_fits_groups import jobs_of
from windrow.operators import fold_fits as ff


def wide_block(n=ff.BLOCK, columns=64):
    rng = np.random.default_rng(5)
    values, labels, train = rng.normal(size=(n, columns)), (rng.random(n) < 0.2).astype(np.int8), (rng.random((n, 2)) < 0.8).astype(np.uint8)
    values[rng.random(values.shape) < 0.01] = np.nan
    facts = ff.Facts(columns, train.sum(0), labels @ train, np.full((2, columns), 0.25), [], np.full(columns, 0.1), 3)
    cells = {"hashes": np.arange(n, dtype="<u8"), "labels": labels, "values": values, "train": train}
    return ff.Block({"block": 0, **{k: v.tobytes() for k, v in cells.items()}}, facts)


def test_logistic_sums_look_at_a_few_rows_at_once():
    b, scale, points = wide_block(), (np.zeros(64), np.ones(64)), np.stack([np.zeros(65), np.full(65, 0.01)])
    tracemalloc.start()
    got, sums = ff.logistic_sums(b, 1, scale, points), ff.moments(b, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < b.values.nbytes * 2  # all rows at once took about three times their size
    inside = b.train[:, 1]
    x, y = b.filled(1)[inside], b.labels[inside]
    z, n, p = np.column_stack([x, np.ones(len(x))]), b.facts.rows[1], b.facts.positives[1]
    weight = np.where(y == 1, n / (2 * p), n / (2 * (n - p)))
    for row, beta in zip(got, points):
        q = 1 / (1 + np.exp(-(z @ beta)))
        assert np.allclose(row[1:66], z.T @ (weight * (q - y))) and np.allclose(row[66:], ((z * (weight * q * (1 - q))[:, None]).T @ z).ravel())
    assert np.allclose(sums, [(x - 0.1).sum(0), ((x - 0.1) ** 2).sum(0)])


def test_trees_over_a_dozen_blocks_need_no_job_per_level(spark, rows):  # noqa: F811
    trees = [f for f in FITS if f.name in ("hgb", "rf")]
    found, jobs = jobs_of(spark, "dozen", lambda: scores(rows, trees, size=20))
    assert jobs < 30 and found.keys() == scores(rows, trees).keys()
