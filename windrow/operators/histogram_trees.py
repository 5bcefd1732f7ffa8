"""Binary trees grown from histograms that can be added up, many trees at a time.

Rows hold small integer bins; bin ``absent`` stands for an absent value. Row statistics are fixed-point
whole numbers in doubles, so sums of histograms are exact and do not depend on how rows are spread. The growth
asks for histograms of nodes and gets the best split of each back; who answers (the rows of one task, or a Spark
aggregation over all blocks) makes no difference to the tree.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

ONE = float(1 << 20)  # fixed-point unit of gradients and weights
CELLS = 1 << 20  # histogram cells asked for at once
KEPT = 1 << 22  # and kept, so that a node's histogram is its parent's less its sibling's
READ = 1 << 13  # rows whose drawn bins are read at once
LOOKED = 1 << 17  # and looked at together
EXACT = 53  # bits of whole numbers in a double
SPLIT = ["gain", "feature", "cut", "absent_left", "count", "g", "h", "left_count", "left_g", "left_h"]


@dataclass(frozen=True)
class Growth:
    bins: int  # bins of present values; the next number is the absent bin
    max_leaves: int | None = None  # best-first up to so many leaves; all splits without it
    max_depth: int | None = None
    min_rows: int = 1
    min_hess: float = 1e-3
    some: int | None = None  # features drawn per node

    @property
    def width(self) -> int:
        return self.bins + 1


def stirred(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of numbers under a salt."""
    h = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def poisson_draws(rows: np.ndarray, salt: int) -> np.ndarray:
    """Poisson(1) draws from row hashes: the same for a row wherever it lies."""
    u = (stirred(rows, salt) >> np.uint64(11)).astype(np.float64) / 2.0**53
    steps = np.cumsum(np.exp(-1) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8]))
    return np.searchsorted(steps, u, "right").astype(np.float64)


class Trees:
    """Trees of several jobs in flat arrays; node ``j`` is the root of job ``j``."""

    def __init__(self, jobs: int):
        self.jobs = jobs
        self.left = np.full(jobs, -1)  # the right child is the next node
        self.feature, self.cut = np.full(jobs, -1), np.full(jobs, -1)
        self.absent_left = np.zeros(jobs, bool)
        self.depth = np.zeros(jobs, np.int64)
        self.job = np.arange(jobs)
        self.gain = np.full(jobs, -np.inf)
        self.stats = np.zeros((jobs, 3))
        self.left_stats = np.zeros((jobs, 3))

    def note(self, nodes: np.ndarray, found: np.ndarray) -> None:
        self.gain[nodes], self.feature[nodes], self.cut[nodes] = found[:, 0], found[:, 1], found[:, 2]
        self.absent_left[nodes], self.stats[nodes], self.left_stats[nodes] = found[:, 3] > 0, found[:, 4:7], found[:, 7:]

    def split(self, nodes: np.ndarray) -> np.ndarray:
        """Give the nodes two children each, whose sums are known from the split."""
        first, n = len(self.left), len(nodes)
        self.left[nodes] = first + 2 * np.arange(n)
        wide = 2 * n
        self.left, self.feature, self.cut = (np.append(x, np.full(wide, -1)) for x in (self.left, self.feature, self.cut))
        self.absent_left = np.append(self.absent_left, np.zeros(wide, bool))
        self.depth = np.append(self.depth, np.repeat(self.depth[nodes] + 1, 2))
        self.job = np.append(self.job, np.repeat(self.job[nodes], 2))
        self.gain = np.append(self.gain, np.full(wide, -np.inf))
        sums = np.stack([self.left_stats[nodes], self.stats[nodes] - self.left_stats[nodes]], axis=1)
        self.stats = np.append(self.stats, sums.reshape(wide, 3), axis=0)
        self.left_stats = np.append(self.left_stats, np.zeros((wide, 3)), axis=0)
        return np.arange(first, first + wide)

    def step(self, at: np.ndarray, rows: np.ndarray, bins: np.ndarray, absent: int) -> np.ndarray:
        """Nodes one or more levels down, until each row is at a node without children."""
        at, live = at.copy(), np.flatnonzero(self.left[at] >= 0)
        flat, d = bins.reshape(-1), bins.shape[1]
        while len(live):
            node = at[live]
            b = flat[rows[live] * d + self.feature[node]]
            goes_left = np.where(b == absent, self.absent_left[node], b <= self.cut[node])
            at[live] = self.left[node] + ~goes_left
            live = live[self.left[at[live]] >= 0]
        return at

    def best_first(self, p: Growth) -> tuple[np.ndarray, np.ndarray]:
        """Nodes that the best-first growth splits so far, and those of them that have no children yet."""
        chosen, fresh = [], []
        heaps: list[list] = [[(-self.gain[j], j)] for j in range(self.jobs)]
        for heap in heaps:
            leaves = 1
            while heap and leaves < p.max_leaves:
                gain, node = heapq.heappop(heap)
                if gain >= 0:
                    break
                leaves += 1
                chosen.append(node)
                if self.left[node] < 0:
                    fresh.append(node)
                else:
                    for child in (int(self.left[node]), int(self.left[node]) + 1):
                        heapq.heappush(heap, (-self.gain[child], child))
        return np.array(chosen, np.int64), np.array(fresh, np.int64)

    def to_split(self, p: Growth) -> np.ndarray:
        if p.max_leaves is not None:
            return self.best_first(p)[1]
        return np.flatnonzero((self.left < 0) & (self.gain > 0))

    def prune(self, p: Growth) -> None:
        """Take back splits that were tried ahead and that the best-first order does not reach."""
        if p.max_leaves is not None:
            kept = np.zeros(len(self.left), bool)
            kept[self.best_first(p)[0]] = True
            self.left[~kept] = -1


def best_splits(hist: np.ndarray, feats: np.ndarray, p: Growth) -> np.ndarray:
    """The best split of each node from its histograms ``[(count, g, h), node, feature, bin]``: columns ``SPLIT``."""
    cell = np.flatnonzero(hist[0])
    return best_of_cells(cell, hist.reshape(3, -1)[:, cell], hist[:, :, 0].sum(axis=2), feats, p)


def best_of_cells(cell: np.ndarray, sums: np.ndarray, total: np.ndarray, feats: np.ndarray, p: Growth) -> np.ndarray:
    """The best split of each node from the cells of its histograms that hold rows, in order of (node, feature, bin).

    Absent values go to the side with the greater gain, with the larger child if a node has none. Ties go
    to the earlier feature in the list, then the lower bin. A cut behind an empty bin parts the rows as the one
    before it does.
    """
    q, m = feats.shape
    column = cell // p.width
    place = cell - column * p.width
    gone = np.zeros((3, q * m))
    apart = place == p.bins
    if apart.any():
        gone[:, column[apart]] = sums[:, apart]
        column, place, sums = column[~apart], place[~apart], sums[:, ~apart]
    node = column // m
    total_at = total[:, node]
    run = np.cumsum(sums, axis=1)
    first = np.searchsorted(column, np.arange(q * m))
    before = np.concatenate([np.zeros((3, 1)), run], axis=1)[:, first]
    run -= before[:, column]

    def gain_of(c: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        rest = total_at[0] - c, total_at[1] - g, total_at[2] - h
        ok = (c >= p.min_rows) & (rest[0] >= p.min_rows) & (h >= p.min_hess * ONE) & (rest[2] >= p.min_hess * ONE)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g * g / h + rest[1] * rest[1] / rest[2]
        return np.where(ok, gain, -np.inf)

    base = total[1] ** 2 / np.maximum(total[2], 1e-300)
    right_gain = gain_of(*run)
    some = gone[0][column] > 0
    left_gain = np.full(len(column), -np.inf)
    if some.any():
        left_gain = np.where(some, gain_of(*(run + gone[:, column])), -np.inf)
    gain = np.maximum(right_gain, left_gain) - base[node]
    out = np.column_stack([np.full(q, -np.inf), np.full(q, -1), np.full(q, -1), np.zeros(q), total.T, np.zeros((q, 3))])
    edge = np.searchsorted(node, np.arange(q))
    full = edge < np.append(edge[1:], len(column))
    if not full.any():
        return out
    top = np.full(q, -np.inf)
    top[full] = np.maximum.reduceat(gain, edge[full])
    hits = np.flatnonzero(gain == top[node])
    best = hits[np.searchsorted(node[hits], np.flatnonzero(full))]
    at = node[best]
    larger_left = 2 * run[0, best] >= total[0][at]
    out[at, 3] = np.where(some[best], left_gain[best] > right_gain[best], larger_left)
    out[at, 1], out[at, 2] = feats[at, column[best] % m], place[best]
    out[at, 0] = np.where(top[at] > 1e-9 * np.maximum(base[at], 1e-3 * ONE), top[at] / ONE, -np.inf)
    out[at, 7:] = (run[:, best] + gone[:, column[best]] * out[at, 3]).T
    return out


class JobRows:
    """The rows of one job. A count and a sum of curvatures are kept as one whole number where a double has room."""

    def __init__(self, job: int, row: np.ndarray, stats: np.ndarray, bins: np.ndarray, by_feature: np.ndarray | None, p: Growth):
        self.row, self.bins, self.by_feature, self.p = row, bins, by_feature, p
        self.at = np.full(len(row), job)
        bits = [int(stats[k].sum()).bit_length() for k in (0, 2)]
        self.unit = float(1 << bits[1]) if sum(bits) <= EXACT else None
        self.weights = [*stats] if self.unit is None else [stats[0] * self.unit + stats[2], stats[1]]
        self.kept: dict[int, list[np.ndarray]] = {}  # sums of asked nodes without children

    def sums(self, t: Trees, ask: np.ndarray, feats: np.ndarray) -> list[np.ndarray]:
        """``[node, feature, bin]`` sums of each weight over the rows of the asked nodes."""
        self.at = t.step(self.at, self.row, self.bins, self.p.bins)
        (q, m), width, n = feats.shape, self.p.width, len(self.bins)
        slot = np.full(len(t.left), -1)
        slot[ask] = np.arange(q)
        own = slot[self.at]
        live = np.flatnonzero(own >= 0)
        own, row = own[live], self.row[live]
        if self.by_feature is not None and (feats == feats[:1]).all():
            bins_of = lambda j: self.by_feature[feats[0, j] * n : (feats[0, j] + 1) * n][row]
        else:
            drawn, flat, d = np.empty((len(row), m), self.bins.dtype), self.bins.reshape(-1), self.bins.shape[1]
            for lo in range(0, len(row), READ):  # a row's drawn bins lie side by side
                some = slice(lo, lo + READ)
                drawn[some] = flat[(row[some] * d)[:, None] + feats[own[some]]]
            bins_of = lambda j: drawn[:, j]
        base, out = own * width, [np.empty((q, m, width)) for _ in self.weights]
        weights = [w[live] for w in self.weights]
        used = [np.flatnonzero(w) for w in weights[1:2]]  # a negative of a forest has no gradient
        fewer = len(used[0]) < len(row) // 2
        if fewer:
            weights[1] = weights[1][used[0]]
        for j in range(m):  # a feature at a time: no wide array of rows times features
            cell = base + bins_of(j)
            for k, w in enumerate(weights):
                out[k][:, j] = np.bincount(cell[used[0]] if fewer and k == 1 else cell, w, q * width).reshape(q, width)
        if self.p.some:  # every leaf that gains is split in the next level: rows of the others are done
            done = (t.gain[self.at] <= 0) & (self.at < ask.min())
            if 4 * np.count_nonzero(done) > len(done):
                self.at, self.row, self.weights = self.at[~done], self.row[~done], [w[~done] for w in self.weights]
        return out

    def by_sibling(self, t: Trees, ask: np.ndarray, feats: np.ndarray) -> list[np.ndarray]:
        """The same; of two siblings the larger one's sums are the parent's less the smaller one's."""
        parent = {int(t.left[k]): k for k in self.kept if t.left[k] >= 0}
        fresh = [k for k in ask.tolist() if k not in self.kept]
        firsts = sorted({k if k in parent else k - 1 for k in fresh if k in parent or k - 1 in parent})
        lone = [k for k in fresh if k not in parent and k - 1 not in parent]  # roots
        small = [k if t.stats[k, 0] <= t.stats[k + 1, 0] else k + 1 for k in firsts]
        if lone or small:
            direct = np.array(lone + small, np.int64)
            found = self.sums(t, direct, np.broadcast_to(feats[0], (len(direct), feats.shape[1])))
            self.kept.update({k: [x[i] for x in found] for i, k in enumerate(direct.tolist())})
        for first, less in zip(firsts, small):
            self.kept[2 * first + 1 - less] = [a - b for a, b in zip(self.kept.pop(parent[first]), self.kept[less])]
        return [np.stack([self.kept[k][i] for k in ask.tolist()]) for i in range(len(self.weights))]

    def parted(self, x: list[np.ndarray]) -> np.ndarray:
        """Counts, gradients and curvatures of sums."""
        if self.unit is None:
            return np.stack(x)
        count = np.floor(x[0] / self.unit)
        return np.stack([count, x[1], x[0] - count * self.unit])

    def best(self, t: Trees, ask: np.ndarray, feats: np.ndarray) -> np.ndarray:
        cells = feats.shape[1] * self.p.width
        found = (self.by_sibling if self.p.some is None and len(t.left) * cells <= KEPT else self.sums)(t, ask, feats)
        out, step = [], max(1, LOOKED // cells)
        for lo in range(0, len(ask), step):
            some = [x[lo : lo + step] for x in found]
            cell = np.flatnonzero(some[0])
            total = self.parted([x[:, 0].sum(axis=1) for x in some])
            out.append(best_of_cells(cell, self.parted([x.reshape(-1)[cell] for x in some]), total, feats[lo : lo + step], self.p))
        return np.concatenate(out)


class Rows:
    """Rows of one block under several jobs, numbered from ``first``; answers with their histograms."""

    def __init__(self, bins: np.ndarray, stats: np.ndarray, p: Growth, by_feature: np.ndarray | None = None, first: int = 0):
        """``stats``: ``[job, (count, g, h), row]``, or one job's after another, fixed-point; rows of count 0 take no part.

        ``by_feature``: the bins feature by feature, where a caller has them; forests, whose nodes draw their own, do
        without.
        """
        bins, self.p, self.first = np.ascontiguousarray(bins), p, first
        by_feature = np.ascontiguousarray(bins.T).ravel() if by_feature is None and not p.some else by_feature
        self.jobs = []
        for j, x in enumerate(stats):
            row = np.flatnonzero(x[0])
            self.jobs.append(JobRows(first + j, row, x[:, row], bins, by_feature, p))

    def each(self, t: Trees, ask: np.ndarray) -> Iterator[tuple[JobRows, np.ndarray]]:
        job = t.job[ask]
        for j in np.unique(job).tolist():
            yield self.jobs[j - self.first], np.flatnonzero(job == j)

    def histograms(self, t: Trees, ask: np.ndarray, feats: np.ndarray) -> np.ndarray:
        out = np.empty((3, *feats.shape, self.p.width))
        for rows, mine in self.each(t, ask):
            out[:, mine] = rows.parted(rows.sums(t, ask[mine], feats[mine]))
        return out

    def __call__(self, t: Trees, ask: np.ndarray, feats: np.ndarray) -> np.ndarray:
        out = np.empty((len(ask), len(SPLIT)))
        for rows, mine in self.each(t, ask):
            out[mine] = rows.best(t, ask[mine], feats[mine])
        return out


def drawn_features(nodes: np.ndarray, t: Trees, salts: np.ndarray, d: int, some: int) -> np.ndarray:
    """``some`` features of each node, by hash of the job's salt and the node's place in its tree."""
    place = np.arange(len(t.left))
    key = stirred(salts[t.job[nodes]].astype(np.uint64) * np.uint64(1 << 32) + place[nodes].astype(np.uint64), 11)
    order = stirred((key[:, None] + np.arange(d, dtype=np.uint64)).ravel(), 5).reshape(len(nodes), d)
    return np.sort(np.argsort(order, axis=1)[:, :some], axis=1)


def may_split(t: Trees, nodes: np.ndarray, p: Growth) -> np.ndarray:
    """The new nodes less those that no split can gain from: few rows, the greatest depth, rows of one class."""
    s = t.stats[nodes]
    use = s[:, 0] >= 2 * p.min_rows
    if p.max_depth is not None:
        use &= t.depth[nodes] < p.max_depth
    if p.some:  # forests: g and h of a row are the same or g is nothing
        use &= (s[:, 1] > 0) & (s[:, 1] < s[:, 2])
    return nodes[use]


def grow(answer, jobs: int, d: int, p: Growth, salts: np.ndarray | None = None) -> Trees:
    """Grow the trees of all jobs, a level of each at a time.

    Best-first growth splits ahead every leaf that may still be reached with the leaves left, so a tree takes
    about as many rounds as it has levels; splits that the order does not reach are taken back.
    """
    t, ask = Trees(jobs), np.arange(jobs)
    every = np.arange(d)
    while len(ask):
        wide = p.some or d
        for lo in range(0, len(ask), step := max(1, CELLS // (wide * p.width))):
            part = ask[lo : lo + step]
            feats = drawn_features(part, t, salts, d, p.some) if p.some else np.broadcast_to(every, (len(part), d))
            t.note(part, answer(t, part, feats))
        if p.some and p.some < d:  # no split among the drawn features of an impure node: look at all
            s = t.stats[ask]
            dull = ask[(t.gain[ask] <= 0) & (s[:, 0] >= 2 * p.min_rows) & (s[:, 1] > 0) & (s[:, 1] < s[:, 2])]
            for lo in range(0, len(dull), step := max(1, CELLS // (d * p.width))):
                part = dull[lo : lo + step]
                t.note(part, answer(t, part, np.broadcast_to(every, (len(part), d))))
        if p.max_depth is not None:
            t.gain[ask[t.depth[ask] >= p.max_depth]] = -np.inf
        ask = may_split(t, t.split(t.to_split(p)), p)
    t.prune(p)
    return t
