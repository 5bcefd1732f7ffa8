"""Histogram trees against a plain booster that looks at every row and split."""

import numpy as np
import pytest

from windrow.operators import histogram_trees as ht

P = ht.Growth(bins=16, max_leaves=9, min_rows=5)


def data(n=300, d=4, seed=0, absent=0.2):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, P.bins, (n, d))
    bins[rng.random((n, d)) < absent] = P.bins
    g = np.round(rng.normal(size=n) * ht.ONE)
    h = np.round((0.1 + rng.random(n)) * ht.ONE)
    return bins, g, h


def plain_best(bins, g, h, rows, p):
    best = None
    base = g[rows].sum() ** 2 / h[rows].sum()
    for f in range(bins.shape[1]):
        b = bins[rows, f]
        for cut in range(p.bins):
            for side in ((False, True) if (b == p.bins).any() else (None,)):
                left = np.where(b == p.bins, bool(side), b <= cut)
                lo, hi = rows[left], rows[~left]
                if min(len(lo), len(hi)) < p.min_rows:
                    continue
                gain = g[lo].sum() ** 2 / h[lo].sum() + g[hi].sum() ** 2 / h[hi].sum() - base
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, f, cut, lo, hi)
    return best


def plain_leaves(bins, g, h, p):
    """Rows of the leaves of a best-first tree, by one split after the other."""
    leaves = [np.arange(len(g))]
    found = [plain_best(bins, g, h, leaves[0], p)]
    while len(leaves) < p.max_leaves:
        k = max(range(len(leaves)), key=lambda i: found[i][0] if found[i] else -1)
        if not found[k]:
            break
        _, _, _, lo, hi = found[k]
        leaves[k : k + 1], found[k : k + 1] = [lo, hi], [plain_best(bins, g, h, x, p) for x in (lo, hi)]
    return {tuple(x) for x in leaves}


@pytest.mark.parametrize("seed", range(4))
def test_best_first_tree_equals_plain_growth(seed):
    bins, g, h = data(seed=seed)
    t = ht.grow(ht.Rows(bins, np.stack([np.ones(len(g)), g, h])[None], P), 1, bins.shape[1], P)
    at = t.step(np.zeros(len(g), int), np.arange(len(g)), bins, P.bins)
    assert {tuple(np.flatnonzero(at == k)) for k in np.unique(at)} == plain_leaves(bins, g, h, P)
    for k in np.unique(at):
        assert t.stats[k].tolist() == [(at == k).sum(), g[at == k].sum(), h[at == k].sum()]


def test_many_jobs_grow_as_each_alone():
    parts = [data(seed=k) for k in range(3)]
    bins = parts[0][0]
    stats = np.stack([np.stack([np.ones(len(g)), g, h]) for _, g, h in parts])
    stats[1, 0, ::3] = 0  # rows that take no part in the second job
    stats[1, 1:, ::3] = 0
    rows = np.arange(len(bins))
    together = ht.grow(ht.Rows(bins, stats, P), 3, bins.shape[1], P)
    for j in range(3):
        alone = ht.grow(ht.Rows(bins, stats[j : j + 1], P), 1, bins.shape[1], P)
        a = together.stats[together.step(np.full(len(rows), j), rows, bins, P.bins)]
        assert (a == alone.stats[alone.step(np.zeros(len(rows), int), rows, bins, P.bins)]).all()


def test_absent_values_decide():
    """Only whether a value is there tells the label; the present values are noise."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    bins = rng.integers(0, P.bins, (400, 2))
    bins[y == 1, 1] = P.bins
    p = ht.Growth(bins=16, max_leaves=2, min_rows=5)
    stats = np.stack([np.ones(400), (0.5 - y) * ht.ONE, np.full(400, 0.25 * ht.ONE)])[None]
    t = ht.grow(ht.Rows(bins, stats, p), 1, 2, p)
    at = t.step(np.zeros(400, int), np.arange(400), bins, p.bins)
    assert len(set(zip(at.tolist(), y.tolist()))) == 2 and t.feature[0] == 1


def test_histograms_of_blocks_add_up():
    bins, g, h = data(200)
    stats = np.stack([np.ones(200), g, h])[None]
    t, ask = ht.Trees(1), np.array([0])
    feats = np.array([[0, 1, 2, 3]])
    whole = ht.Rows(bins, stats, P).histograms(t, ask, feats)
    parts = [ht.Rows(bins[s], stats[:, :, s], P).histograms(t, ask, feats) for s in (slice(0, 77), slice(77, 200))]
    assert (whole == parts[0] + parts[1]).all()


def test_draws_are_poisson_and_belong_to_the_row():
    rows = np.arange(100_000).astype(np.uint64)
    draws = ht.poisson_draws(rows, 3)
    assert abs(draws.mean() - 1) < 0.02 and abs(draws.var() - 1) < 0.03
    assert (ht.poisson_draws(rows[::-1], 3)[::-1] == draws).all() and (ht.poisson_draws(rows, 4) != draws).any()


def asked_of(rows, jobs, d, p, salts=None):
    """The tree, and the asked nodes of each question with the rows they hold."""
    asked = []

    def answer(t, ask, feats):
        found = rows(t, ask, feats)
        asked.append((ask.tolist(), found[:, 4].tolist()))
        return found

    return ht.grow(answer, jobs, d, p, salts), asked


def test_nodes_that_cannot_be_split_are_not_asked():
    """Rows of one class, too few rows, the last depth: their sums are known from the split above."""
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 8, (400, 4))
    y = ((bins[:, 0] > 4) ^ (rng.random(400) < 0.1)).astype(float)
    p = ht.Growth(8, None, 6, 3, 0.0, 2)
    t, asked = asked_of(ht.Rows(bins, np.stack([np.ones(400), y * ht.ONE, np.full(400, ht.ONE)])[None], p), 1, 4, p, np.array([7]))
    later = [k for nodes, _ in asked for k in nodes if k]
    s = t.stats[later]
    assert later and (s[:, 0] >= 6).all() and (s[:, 1] > 0).all() and (s[:, 1] < s[:, 2]).all() and (t.depth[later] < 6).all()
    at = t.step(np.zeros(400, int), np.arange(400), bins, p.bins)
    for k in np.unique(at):
        assert t.stats[k].tolist() == [(at == k).sum(), y[at == k].sum() * ht.ONE, (at == k).sum() * ht.ONE]


@pytest.mark.parametrize("cells", [ht.CELLS, 4 * 17])
def test_the_larger_sibling_is_not_read(monkeypatch, cells):
    """Its sums are the parent's less the smaller one's, also where siblings are asked apart; the tree is the same."""
    bins, g, h = data(600, seed=2)
    stats = np.stack([np.ones(600), g, h])[None]
    monkeypatch.setattr(ht, "CELLS", cells)
    read = []
    real = ht.JobRows.sums

    def sums(self, t, ask, feats):
        found = real(self, t, ask, feats)
        read.append(int(np.isin(self.at, ask).sum()))
        return found

    monkeypatch.setattr(ht.JobRows, "sums", sums)
    near = ht.grow(ht.Rows(bins, stats, P), 1, 4, P)
    depth = near.depth[near.left >= 0].max()
    assert read[0] == 600 and sum(read[1:]) <= 300 * (depth + 1)
    monkeypatch.setattr(ht, "KEPT", 0)
    far = ht.grow(ht.Rows(bins, stats, P), 1, 4, P)
    for name in ("left", "feature", "cut", "absent_left", "stats", "gain"):
        assert (getattr(near, name) == getattr(far, name)).all()


def test_sums_too_long_for_one_number_are_kept_apart():
    bins, g, h = data(200, seed=3)
    wide = np.stack([np.ones(200), g, h * 2.0**20])[None]
    rows = ht.Rows(bins, wide, P)
    assert rows.jobs[0].unit is None and ht.Rows(bins, np.stack([np.ones(200), g, h])[None], P).jobs[0].unit
    t = ht.grow(rows, 1, 4, P)
    at = t.step(np.zeros(200, int), np.arange(200), bins, P.bins)
    assert all(t.stats[k].tolist() == [(at == k).sum(), g[at == k].sum(), h[at == k].sum() * 2.0**20] for k in np.unique(at))
