"""Fits of many folds and models at once, and the scores of the rows each fold holds out.

Rows are gathered once into blocks of bounded size, each row knowing by arrays which folds train on it and
which hold it out. A fit asks for sums over its training rows: histograms of tree nodes, gradients and
curvatures of logistic losses. All folds' sums of one step come from one Spark aggregation, added up before
they reach the driver, so the number of jobs depends on the depth and rounds of a fit and not on the number of
folds, grid points or rows. Where all rows are one block there is nothing to add up between tasks: the same steps
then run inside the tasks, one for each fold (and part of a forest). Histograms hold whole numbers, so
trees are the same either way.

Sizes on the driver: per fold and column a few numbers, per fold and asked node one split, per fold and grid
point one matrix of columns squared (``CURVED`` columns at most; wider tables are refused here).
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.functions.memory import give_back
from windrow.operators import histogram_trees as ht
from windrow.session import pinned

BLOCK = 16_384  # rows of a block
CELLS = 1 << 20  # and values of a block, which bounds it also for wide tables
GATHERED = 96  # blocks whose bins and labels one piece of work may hold: 96 MB of bins
TASKS = 1024  # at most so many tasks do the pieces of work
DRAWN = 1 << 22  # rows times trees that one piece of work grows at once
ASKED = 64  # groups of nodes whose histograms are added up apart
BINS = 255
FOREST_BINS = 32
FOREST_TREES = 300
FOREST_PART = 25  # trees grown in one piece of work
ROUNDS = 100
REFRESH = 10  # rounds after which the blocks store the scores so far
CURVED = 2048
STRIP = 4096  # rows of a block that logistic sums look at together
NUMERIC = "block int, hashes binary, labels binary, values binary, bins binary, train binary, held binary, raw binary"
MODEL = "fold int, fit int, part int, kind string, body binary"
SCORE = "block int, place int, fold int, fit int, held int, score double"
TREES = ("hgb", "rf")
BATCH = str(4 << 20)  # bytes of one batch of blocks on its way to a Python worker


@dataclass(frozen=True)
class Fit:
    """One model of one fold."""

    fold: int
    name: str
    params: tuple[tuple[str, object], ...] = ()

    def get(self, key: str, default):
        found = dict(self.params).get(key, default)
        return default if found is None and default is not None else found

    @property
    def rounds(self) -> int:
        return self.get("rounds", ROUNDS)

    @property
    def trees(self) -> int:
        return self.get("trees", FOREST_TREES)

    def parts(self) -> list[range]:
        """The trees of a forest by pieces of work."""
        return [range(lo, min(self.trees, lo + FOREST_PART)) for lo in range(0, self.trees, FOREST_PART)]

    def growth(self) -> ht.Growth:
        if self.name == "hgb":
            return ht.Growth(BINS, max_leaves=self.get("max_leaf_nodes", 31), min_rows=20)
        return ht.Growth(FOREST_BINS, max_depth=self.get("max_depth", 30), min_rows=self.get("min_samples_leaf", 1), min_hess=0.0, some=1)


@dataclass
class Facts:
    """What is known of each fold's training rows before any fit."""

    columns: int
    rows: np.ndarray  # per fold
    positives: np.ndarray
    median: np.ndarray  # [fold, column]
    edges: list[np.ndarray]
    centre: np.ndarray  # per column, any number near its values
    salt: int
    same: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # per fold the first one with the same training rows

    def one_class(self, fold: int) -> float | None:
        """The constant score of a fold whose training rows have one class or none."""
        n, p = self.rows[fold], self.positives[fold]
        return (1.0 if n and p == n else 0.0) if p in (0, n) else None


class Block:
    """One block's rows as arrays."""

    def __init__(self, row: dict, facts: Facts):
        self.key, d = row["block"], facts.columns
        self.hashes, self.labels = np.frombuffer(row["hashes"], "<u8"), np.frombuffer(row["labels"], np.int8).astype(float)
        n = len(self.labels)
        self.values = np.frombuffer(row["values"], "<f8").reshape(n, d) if row.get("values") else None
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(n, d) if row.get("bins") else None
        self.train = np.frombuffer(row["train"], np.uint8).reshape(n, -1).astype(bool)
        self.held = np.frombuffer(row["held"], np.uint8).reshape(n, -1) if row.get("held") else None
        self.raw = np.frombuffer(row["raw"], "<f8").reshape(-1, n) if row.get("raw") else None
        self.facts = facts

    def taken(self, at: np.ndarray) -> Block:
        """Some rows, without their values."""
        out = copy.copy(self)
        out.hashes, out.labels, out.bins, out.train, out.held = (x[at] for x in (self.hashes, self.labels, self.bins, self.train, self.held))
        out.values = out.raw = None
        return out

    def filled(self, fold: int) -> np.ndarray:
        """Values with the fold's training median where absent."""
        return np.where(np.isnan(self.values), self.facts.median[fold], self.values)

    def coarse(self, fold: int) -> np.ndarray:
        """Bins for forests: fewer, and the median's bin where a value is absent."""
        median = np.array([np.searchsorted(e, m) for e, m in zip(self.facts.edges, self.facts.median[fold])], np.int64)
        filled = np.where(self.bins == BINS, median, self.bins) if (self.bins == BINS).any() else self.bins
        return (np.arange(BINS + 1) * FOREST_BINS // BINS).astype(np.uint8)[filled]


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time; binary cells are not copied."""
    for k in range(len(batch)):
        cells = {n: batch.column(n)[k] for n in batch.schema.names}
        yield {n: c.as_buffer() if isinstance(c, pa.BinaryScalar) and c.is_valid else c.as_py() for n, c in cells.items()}


def together(rows: list[dict], facts: Facts) -> Block:
    """Some blocks, without their values, as one; ``block`` is the number of the first."""
    names = ("hashes", "labels", "bins", "train", "held")
    return Block({"block": rows[0]["block"], **{n: b"".join(r[n] for r in rows) for n in names}}, facts)


# Boosting

def boost_stats(b: Block, fold: int, raw: np.ndarray) -> np.ndarray:
    """Count, negative gradient and curvature of the log loss of each training row."""
    p = 1 / (1 + np.exp(-raw))
    inside = b.train[:, fold]
    return np.stack([inside.astype(float), np.round((b.labels - p) * ht.ONE) * inside, np.round(p * (1 - p) * ht.ONE) * inside])


def base_score(facts: Facts, fold: int) -> float:
    p = facts.positives[fold] / max(1, facts.rows[fold])
    return float(np.log(p / (1 - p))) if 0 < p < 1 else 0.0


def leaf_values(t: ht.Trees, rate: float, curvature_floor: float = 1e-300) -> np.ndarray:
    return rate * t.stats[:, 1] / np.maximum(t.stats[:, 2], curvature_floor)


@dataclass
class Ensemble:
    """Trees of one job after another; each of one root."""

    p: ht.Growth
    trees: list[ht.Trees]
    values: list[np.ndarray]

    def add_to(self, raw: np.ndarray, bins: np.ndarray, root: int = 0) -> np.ndarray:
        rows = np.arange(len(bins))
        for t, v in zip(self.trees, self.values):
            raw = raw + v[t.step(np.full(len(bins), root), rows, bins, self.p.bins)]
        return raw


def boosted_here(b: Block, fit: Fit) -> Ensemble:
    """All rounds of one fold in one task."""
    p, rate = fit.growth(), fit.get("learning_rate", 0.1)
    out, raw = Ensemble(p, [], []), np.full(len(b.labels), base_score(b.facts, fit.fold))
    by_feature = np.ascontiguousarray(b.bins.T).ravel()
    for _ in range(fit.rounds):
        t = ht.grow(ht.Rows(b.bins, boost_stats(b, fit.fold, raw)[None], p, by_feature), 1, b.facts.columns, p)
        one = Ensemble(p, [t], [leaf_values(t, rate)])
        raw = one.add_to(raw, b.bins)
        out.trees += one.trees
        out.values += one.values
    return out


# Forests

def tree_salt(facts: Facts, fold: int, tree: int) -> int:
    return (facts.salt * 1_000_003 + fold) * 1_000_003 + tree


def drawn_classes(b: Block, fold: int, trees: range) -> np.ndarray:
    """Draws of each tree by class, ``[tree, class]``."""
    return np.array([
        [(ht.poisson_draws(b.hashes, tree_salt(b.facts, fold, t)) * b.train[:, fold])[b.labels == c].sum() for c in (0, 1)] for t in trees
    ])


def forest_stats(b: Block, fold: int, tree: int, drawn: np.ndarray) -> np.ndarray:
    """Count, weighted positives and weight of each drawn row; a tree's own draws balance its classes."""
    draws = ht.poisson_draws(b.hashes, tree_salt(b.facts, fold, tree)) * b.train[:, fold]
    share = drawn.sum() / (2 * np.maximum(1, drawn))
    weight = draws * share[b.labels.astype(int)]
    return np.stack([(draws > 0).astype(float), np.round(weight * b.labels * ht.ONE), np.round(weight * ht.ONE)])


def forest_growth(fit: Fit, columns: int) -> ht.Growth:
    p = fit.growth()
    return ht.Growth(p.bins, None, p.max_depth, p.min_rows, p.min_hess, max(1, int(columns**0.5)))


def salts_of(facts: Facts, fold: int, trees: range) -> np.ndarray:
    return np.array([tree_salt(facts, fold, t) & 0x7FFFFFFF for t in trees], np.int64)


def forest_here(b: Block, fit: Fit, trees: range) -> ht.Trees:
    """Some trees of one fold in one task, grown side by side."""
    p, drawn = forest_growth(fit, b.facts.columns), drawn_classes(b, fit.fold, trees)
    stats = (forest_stats(b, fit.fold, t, drawn[k]) for k, t in enumerate(trees))  # one tree's rows at a time
    return ht.grow(ht.Rows(b.coarse(fit.fold), stats, p), len(trees), b.facts.columns, p, salts_of(b.facts, fit.fold, trees))


# Logistic regression

def strips(b: Block, fold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values and labels of the training rows, ``STRIP`` rows of the block at a time."""
    for lo in range(0, len(b.labels), STRIP):
        inside = b.train[lo : lo + STRIP, fold]
        x = b.values[lo : lo + STRIP][inside]
        yield np.where(np.isnan(x), b.facts.median[fold], x), b.labels[lo : lo + STRIP][inside]


def moments(b: Block, fold: int) -> np.ndarray:
    """Sums of values and squares about ``centre`` over the training rows."""
    out = np.zeros((2, b.facts.columns))
    for x, _ in strips(b, fold):
        x -= b.facts.centre
        out += np.stack([x.sum(axis=0), (x**2).sum(axis=0)])
    return out


def scaling(facts: Facts, fold: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of each column; a constant column is left out by a deviation of infinity."""
    n = max(1, facts.rows[fold])
    mean = sums[0] / n
    spread = np.sqrt(np.maximum(sums[1] - n * mean**2, 0) / max(1, n - 1))
    return mean + facts.centre, np.where(spread > 1e-12 * (1 + np.abs(facts.centre)), spread, np.inf)


def logistic_sums(b: Block, fold: int, scale: tuple, points: np.ndarray) -> np.ndarray:
    """Weighted loss, gradient and curvature at each point, as one row: ``1 + k + k * k`` numbers."""
    n, p = b.facts.rows[fold], b.facts.positives[fold]
    k = b.facts.columns + 1
    out = np.zeros((len(points), 1 + k + k * k))
    for x, y in strips(b, fold):
        z = np.column_stack([(x - scale[0]) / scale[1], np.ones(len(x))])
        weight = np.where(y == 1, n / (2 * max(1, p)), n / (2 * max(1, n - p)))
        for row, beta in zip(out, points):
            m = z @ beta
            q = 1 / (1 + np.exp(-m))
            row[0] += (weight * np.logaddexp(0, np.where(y == 1, -m, m))).sum()
            row[1 : 1 + k] += z.T @ (weight * (q - y))
            row[1 + k :] += ((z * (weight * q * (1 - q))[:, None]).T @ z).ravel()
    return out


def newton(sums_at, penalties: np.ndarray, k: int, steps: int = 100) -> np.ndarray:
    """Minimise all penalised losses side by side; ``sums_at(points)`` gives the sums of every loss.

    The last coordinate, the intercept, is not penalised. Steps are halved until the loss falls enough, each
    loss on its own.
    """
    ridge = np.repeat(penalties[:, None], k, axis=1)
    ridge[:, -1] = 0.0

    def full(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = sums_at(points)
        curve = s[:, 1 + k :].reshape(-1, k, k) + ridge[:, :, None] * np.eye(k)
        return s[:, 0] + 0.5 * (ridge * points**2).sum(axis=1), s[:, 1 : 1 + k] + ridge * points, curve

    at = np.zeros((len(penalties), k))
    loss, slope, curve = full(at)
    size, move = np.ones(len(at)), None
    for _ in range(steps):
        if move is None:
            move = np.stack([np.linalg.lstsq(h, -g, rcond=None)[0] for h, g in zip(curve, slope)])
        drop = (slope * move).sum(axis=1)
        live = -drop > 1e-12 * (1 + np.abs(loss))
        if not live.any():
            break
        trial = np.where(live[:, None], at + size[:, None] * move, at)
        new_loss, new_slope, new_curve = full(trial)
        good = live & (new_loss <= loss + 1e-4 * size * drop + 1e-12 * np.abs(loss))
        at[good], loss[good], slope[good], curve[good] = trial[good], new_loss[good], new_slope[good], new_curve[good]
        size = np.where(good, 1.0, np.where(live, size / 2, size))
        if (size < 1e-10).any():
            slope[size < 1e-10] = 0  # rounding allows no further step
        for k_ in np.flatnonzero(good):
            move[k_] = np.linalg.lstsq(curve[k_], -slope[k_], rcond=None)[0]
    return at


# Blocks

def gathered(rows: DataFrame, columns: list[str], uid: str, train: Column, held: Column, size: int) -> tuple[DataFrame, int]:
    """``block, keys`` and the numbers of its rows; blocks by hash of the row id, rows in order of it."""
    n_blocks = max(1, -(-rows.count() // size))
    keys = [c for c in rows.columns if c not in {*columns, "__train", "__held", "__within", "__out"}]
    value = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns]
    item = F.struct(
        F.col(uid).alias("u"), F.xxhash64(uid).alias("h"), F.struct(*[F.col(f"`{c}`") for c in keys]).alias("key"),
        (F.col("label") == 1).cast("tinyint").alias("y"), F.array(*value).alias("v"), train.alias("t"), held.alias("r"),
    )
    blocks = rows.groupBy(F.pmod(F.xxhash64(uid), F.lit(n_blocks)).cast("int").alias("block")).agg(F.array_sort(F.collect_list(item)).alias("x"))
    each = lambda f: F.transform("x", lambda r: r[f])
    return blocks.select(
        "block", each("key").alias("keys"), each("h").alias("hashes"), each("y").alias("labels"),
        F.flatten(each("v")).alias("values"), F.flatten(each("t")).alias("train"), F.flatten(each("r")).alias("held"),
    ), n_blocks


def long_values(rows: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """One row for each present value: ``column`` (its index), ``value`` and ``more``."""
    listed = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    return rows.select(*more, F.posexplode(listed).alias("column", "value")).where(~F.isnan("value") & F.col("value").isNotNull())


def quantile_edges(rows: DataFrame, columns: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bin edges, a central value, and whether values are absent, per column. Sketches of quantiles are merged
    per column, so no task holds a column."""
    shares = [k / BINS for k in range(1, BINS)]
    found = long_values(rows, columns).groupBy("column").agg(
        F.percentile_approx("value", shares, 10_000).alias("q"), F.avg("value").alias("m"), F.count(F.lit(1)).alias("n")
    ).collect()  # one row a column
    every, n = {r["column"]: r for r in found}, rows.count()
    edges = [np.unique(np.array(every[k]["q"], float)) if k in every else np.zeros(0) for k in range(len(columns))]
    centre = np.array([every[k]["m"] if k in every else 0.0 for k in range(len(columns))])
    return edges, centre, np.array([k not in every or every[k]["n"] < n for k in range(len(columns))], bool)


def fold_medians(rows: DataFrame, columns: list[str], gaps: np.ndarray, train: Column, folds: int) -> np.ndarray:
    """Median of each column over each fold's training rows, for the columns with absent values."""
    out, asked = np.zeros((folds, len(columns))), np.flatnonzero(gaps).tolist()
    long = long_values(rows.withColumn("__train", train), [columns[k] for k in asked], F.col("__train"))
    long = long.select("column", "value", F.posexplode("__train").alias("fold", "__in")).where("__in")
    for r in long.groupBy("fold", "column").agg(F.percentile_approx("value", 0.5, 10_000).alias("m")).collect():  # one row a fold and column
        out[r["fold"], asked[r["column"]]] = r["m"]
    return out


def numbered(blocks: DataFrame, edges: list[np.ndarray], valued: bool) -> tuple[DataFrame, DataFrame]:
    """The blocks' keys, and their numbers in binary with bins; values only where fits ask for them.

    Without values both are one stored table. Rows with values are large, and are stored before they are converted, so
    that no task holds what it gathers beside what it sends.
    """
    names = [f.split()[0] for f in NUMERIC.split(", ")]
    also = [] if valued else ["keys"]
    blocks = pinned(blocks, "zstd") if valued else blocks

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                part = {n: batch.column(n)[k].values for n in ("hashes", "labels", "values", "train", "held")}
                values = part["values"].to_numpy(zero_copy_only=False).reshape(-1, len(edges))
                bins = np.column_stack([np.searchsorted(e, values[:, j]) for j, e in enumerate(edges)]).astype(np.uint8)
                bins[np.isnan(values)] = BINS
                kinds = {"hashes": "<i8", "labels": np.int8, "train": np.uint8, "held": np.uint8}
                flat = {n: part[n].to_numpy(zero_copy_only=False).astype(t).tobytes() for n, t in kinds.items()}
                own = values.astype("<f8").tobytes() if valued else None
                row = [batch.column("block")[k].as_py(), flat["hashes"], flat["labels"], own, bins.tobytes(), flat["train"], flat["held"], None]
                cells = [pa.array([v], pa.int32() if n == "block" else pa.binary()) for n, v in zip(names, row)]
                yield pa.RecordBatch.from_arrays([*cells, *(batch.column(n).slice(k, 1) for n in also)], [*names, *also])
            give_back()

    fields = [*T.StructType.fromDDL(NUMERIC).fields, *(blocks.schema[n] for n in also)]
    kept = pinned((blocks.drop("keys") if valued else blocks).mapInArrow(convert, T.StructType(fields)), "zstd")
    return (blocks if valued else kept).select("block", "keys"), kept.select(*names)


# Sums over all blocks

class Everywhere:
    """All blocks; asks of them are Spark jobs whose sums are added up before they come back."""

    def __init__(self, blocks: DataFrame, facts: Facts):
        self.blocks, self.facts = blocks, facts

    def summed(self, part_of, done=None) -> dict[int, np.ndarray]:
        """``part_of(block)`` gives ``(key, numbers)``; the sums by key, after ``done(key, sum)`` if given."""
        facts = self.facts

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for row in rows_of(batch):
                    for key, x in part_of(Block(row, facts)):
                        sums[key] = sums[key] + x if key in sums else x
            give_back()
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<f8").tobytes() for x in sums.values()], pa.binary())], ["key", "x"])

        def add(t: pa.Table) -> pa.Table:
            key = t["key"][0].as_py()
            total = sum(np.frombuffer(v.as_py(), "<f8") for v in t["x"])
            return pa.table({"key": pa.array([key], pa.int32()), "x": pa.array([(done(key, total) if done else total).astype("<f8").tobytes()], pa.binary())})

        parts = self.blocks.mapInArrow(partial, "key int, x binary")
        found = parts.groupBy("key").applyInArrow(add, "key int, x binary").collect()  # one row a key
        return {r["key"]: np.frombuffer(r["x"], "<f8") for r in found}

    def splits(self, stats_of, bins_of, p: ht.Growth):
        """Answers to tree growth: best splits of the asked nodes of all jobs."""

        def answer(t: ht.Trees, ask: np.ndarray, feats: np.ndarray) -> np.ndarray:
            size, m = -(-len(ask) // ASKED), feats.shape[1]  # nodes of a group

            def part_of(b: Block) -> Iterator[tuple[int, np.ndarray]]:
                out = np.zeros((-(-len(ask) // size), 3, size, m, p.width))
                for job in np.unique(t.job[ask]).tolist():
                    mine = np.flatnonzero(t.job[ask] == job)
                    rows = ht.Rows(bins_of(b, job), stats_of(b, job)[None], p, first=job)
                    out[mine // size, :, mine % size] = rows.histograms(t, ask[mine], feats[mine]).swapaxes(0, 1)
                yield from ((k, x.ravel()) for k, x in enumerate(out))

            def done(key: int, total: np.ndarray) -> np.ndarray:
                mine = feats[key * size : (key + 1) * size]
                return ht.best_splits(total.reshape(3, size, m, p.width)[:, : len(mine)], mine, p).ravel()

            found = self.summed(part_of, done)
            return np.concatenate([found[k].reshape(-1, len(ht.SPLIT)) for k in range(-(-len(ask) // size))])

        return answer

    def boosted(self, fits: list[Fit]) -> list[Ensemble]:
        """Boosting of several folds with the same settings, every level of a round one aggregation."""
        p, rate, folds, facts = fits[0].growth(), fits[0].get("learning_rate", 0.1), [f.fold for f in fits], self.facts
        recent, out, kept = [], [Ensemble(p, [], []) for _ in fits], self.blocks
        self.blocks = kept.drop("values", "held")

        def raw_of(b: Block, job: int) -> np.ndarray:
            raw = np.full(len(b.labels), base_score(facts, folds[job])) if b.raw is None else b.raw[job]
            return Ensemble(p, [t for t, _ in recent], [v for _, v in recent]).add_to(raw, b.bins, job)

        for k in range(fits[0].rounds):
            answer = self.splits(lambda b, j: boost_stats(b, folds[j], raw_of(b, j)), lambda b, j: b.bins, p)
            t = ht.grow(answer, len(fits), facts.columns, p)
            recent.append((t, leaf_values(t, rate)))
            for j, e in enumerate(out):
                one = only_job(t, j)
                e.trees.append(one)
                e.values.append(leaf_values(one, rate))
            if (k + 1) % REFRESH == 0 and k + 1 < fits[0].rounds:
                self.blocks = pinned(with_raw(self.blocks, facts, raw_of, len(fits)), "zstd")
                recent.clear()
        self.blocks = kept
        return out

    def forest(self, fit: Fit, trees: range) -> ht.Trees:
        p, facts = forest_growth(fit, self.facts.columns), self.facts
        kept, self.blocks = self.blocks, self.blocks.drop("values", "held")
        drawn = self.summed(lambda b: [(0, drawn_classes(b, fit.fold, trees).ravel())])[0].reshape(-1, 2)
        answer = self.splits(lambda b, j: forest_stats(b, fit.fold, trees[j], drawn[j]), lambda b, j: b.coarse(fit.fold), p)
        grown = ht.grow(answer, len(trees), facts.columns, p, salts_of(facts, fit.fold, trees))
        self.blocks = kept
        return grown

    def logistic(self, fits: list[Fit]) -> list[tuple]:
        """Every fold and penalty in the same steps, one aggregation each."""
        facts, folds = self.facts, sorted({f.fold for f in fits})
        kept, self.blocks = self.blocks, self.blocks.drop("bins", "held")
        sums = self.summed(lambda b: [(f, moments(b, f).ravel()) for f in folds])
        scales = {f: scaling(facts, f, sums[f].reshape(2, -1)) for f in folds}
        where = {f: [j for j, x in enumerate(fits) if x.fold == f] for f in folds}

        def sums_at(points: np.ndarray) -> np.ndarray:
            def part_of(b: Block) -> Iterator[tuple[int, np.ndarray]]:
                for f in folds:
                    yield from zip(where[f], logistic_sums(b, f, scales[f], points[where[f]]))

            found = self.summed(part_of)
            return np.stack([found[j] for j in range(len(fits))])

        betas = newton(sums_at, np.array([1.0 / f.get("C", 1.0) for f in fits]), facts.columns + 1)
        self.blocks = kept
        return [(*scales[f.fold], beta) for f, beta in zip(fits, betas)]


def only_job(t: ht.Trees, job: int) -> ht.Trees:
    """The tree of one job on its own, its root first."""
    mine = np.flatnonzero(t.job == job)
    new = np.full(len(t.job), -1)
    new[mine] = np.arange(len(mine))
    out = ht.Trees(1)
    for name in ("feature", "cut", "absent_left", "depth", "gain", "stats"):
        setattr(out, name, getattr(t, name)[mine])
    out.left, out.job = np.where(t.left[mine] >= 0, new[t.left[mine]], -1), np.zeros(len(mine), np.int64)
    return out


def with_raw(blocks: DataFrame, facts: Facts, raw_of, jobs: int) -> DataFrame:
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for row in rows_of(batch):
                b = Block(row, facts)
                raw.append(np.stack([raw_of(b, j) for j in range(jobs)]).astype("<f8").tobytes())
            yield batch.set_column(batch.schema.get_field_index("raw"), "raw", pa.array(raw, pa.binary()))

    return blocks.mapInArrow(store, blocks.schema)


# Fits and scores

def model_row(fit: Fit, number: int, part: int, kind: str, body) -> tuple:
    return (fit.fold, number, part, kind, pickle.dumps(body))


def slim(t: ht.Trees) -> dict:
    kinds = {"left": np.int32, "feature": np.int32, "cut": np.int16, "absent_left": bool}
    return {k: getattr(t, k).astype(kind) for k, kind in kinds.items()}


def forest_body(t: ht.Trees, fit: Fit) -> tuple:
    return slim(t), leaf_values(t, 1.0 / fit.trees), t.jobs


def ensemble_body(e: Ensemble, base: float) -> tuple:
    return [(slim(t), v) for t, v in zip(e.trees, e.values)], base


def forests_here(b: Block, fit: Fit, trees: range) -> Iterator[ht.Trees]:
    """Trees of one fold in one task, as many side by side as ``DRAWN`` allows."""
    step = max(1, DRAWN // max(1, len(b.labels)))
    for lo in range(0, len(trees), step):
        yield forest_here(b, fit, trees[lo : lo + step])


def trees_here(b: Block, fit: Fit, part: int) -> Iterator[tuple[str, object]]:
    """Kind and body of the models of one piece of work on trees, from all rows."""
    if fit.name == "hgb":
        yield "hgb", ensemble_body(boosted_here(b, fit), base_score(b.facts, fit.fold))
    else:
        for t in forests_here(b, fit, fit.parts()[part]):
            yield "rf", forest_body(t, fit)


def fitted_here(b: Block, fits: list[tuple[int, Fit]], part: int) -> list[tuple]:
    """Models of one piece of work from the only block."""
    number, fit = fits[0]
    if fit.name in TREES:
        return [model_row(fit, number, part, kind, body) for kind, body in trees_here(b, fit, part)]
    scale = scaling(b.facts, fit.fold, moments(b, fit.fold))
    betas = newton(lambda at: logistic_sums(b, fit.fold, scale, at), np.array([1.0 / f.get("C", 1.0) for _, f in fits]), b.facts.columns + 1)
    return [model_row(f, k, 0, "logreg", (*scale, beta)) for (k, f), beta in zip(fits, betas)]


def shared_fits(facts: Facts, fits: list[Fit]) -> dict[int, list[int]]:
    """The fits to run, by number, and the numbers of all fits that are the same: equal settings and training rows."""
    first: dict[tuple, int] = {}
    out: dict[int, list[int]] = {}
    for k, f in enumerate(fits):
        out.setdefault(first.setdefault((int(facts.same[f.fold]), f.name, f.params), k), []).append(k)
    return out


def spread(models: DataFrame, fits: list[Fit], shared: dict[int, list[int]]) -> DataFrame:
    """The models of the fits that were run, under the fold and number of each fit that is the same."""
    if all(len(v) == 1 for v in shared.values()):
        return models
    names = [(k, fits[j].fold, j) for k, v in shared.items() for j in v]
    named = models.sparkSession.createDataFrame(names, "__run int, fold int, fit int")
    return models.drop("fold").withColumnRenamed("fit", "__run").join(named, "__run").select([f.split()[0] for f in MODEL.split(", ")])


def models_of(spark: SparkSession, blocks: DataFrame, n_blocks: int, facts: Facts, fits: dict[int, Fit]) -> DataFrame:
    """The fitted models by number, one row each (a forest one row for some of its trees)."""
    ready, work = [], {}
    for k, f in fits.items():
        constant = facts.one_class(f.fold)
        if f.name == "dummy":
            constant = float(2 * facts.positives[f.fold] > facts.rows[f.fold])
        if constant is not None:
            ready.append(model_row(f, k, 0, "constant", constant))
        elif f.name == "logreg":
            work.setdefault(("logreg", f.fold, 0), []).append((k, f))
        elif f.name == "rf":
            work.update({("rf", k, part): [(k, f)] for part in range(len(f.parts()))})
        elif f.name == "hgb":
            work["hgb", k, 0] = [(k, f)]
        else:
            raise ValueError(f"unknown model: {f.name}")
    constants = spark.createDataFrame(ready, MODEL)
    if not work:
        return constants
    if n_blocks == 1:
        pieces = sorted(work.items(), key=lambda x: x[0][0])

        def fit_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    (_, _, part), some = pieces[row["piece"]]
                    yield from model_table(fitted_here(Block(row, facts), some, part)).to_batches()

        # the only block, of bounded size, goes to every piece of work
        each = blocks.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(len(pieces) - 1))))
        with_rows = each.repartitionByRange(min(len(pieces), 1024), "piece")
        return constants.unionByName(with_rows.mapInArrow(fit_piece, MODEL))
    every, out = Everywhere(blocks, facts), []
    if n_blocks <= GATHERED:
        trees = sorted((x for x in work.items() if x[0][0] != "logreg"), key=lambda x: x[0][0])  # boosting takes longest and comes first

        def fit_trees(piece: int, b: Block, numbers: np.ndarray, sizes: np.ndarray) -> pa.Table:
            (_, _, part), some = trees[piece]
            return model_table(fitted_here(b, some, part))

        constants = constants.unionByName(pieces_of(blocks, facts, len(trees), fit_trees, MODEL)) if trees else constants
        work = {k: some for k, some in work.items() if k[0] == "logreg"}
    linear = [x for (kind, _, _), some in work.items() if kind == "logreg" for x in some]
    if linear:
        out += [model_row(f, k, 0, "logreg", m) for (k, f), m in zip(linear, every.logistic([f for _, f in linear]))]
    boosts: dict = {}
    for (kind, _, _), some in work.items():
        if kind == "hgb":
            boosts.setdefault(some[0][1].params, []).append(some[0])
    for some in boosts.values():
        found = every.boosted([f for _, f in some])
        out += [model_row(f, k, 0, "hgb", ensemble_body(e, base_score(facts, f.fold))) for (k, f), e in zip(some, found)]
    for (kind, k, part), some in work.items():
        if kind == "rf":
            t = every.forest(some[0][1], some[0][1].parts()[part])
            out.append(model_row(some[0][1], k, part, "rf", forest_body(t, some[0][1])))
    return constants.unionByName(spark.createDataFrame(out, MODEL))


def pieces_of(blocks: DataFrame, facts: Facts, pieces: int, run, schema: str) -> DataFrame:
    """Rows that ``run(piece, block, numbers, sizes)`` gives for each piece of work from all of few blocks' bins and labels.

    ``numbers`` and ``sizes`` are those of the blocks that ``block`` joins, at most ``GATHERED``. Every task reads the
    stored blocks itself: a product of one partition of blocks with one row for each task shuffles nothing.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, mine = [], []
        for batch in batches:
            mine = batch.column("pieces")[0].as_py()
            rows += rows_of(batch.drop_columns("pieces"))
        rows.sort(key=lambda r: r["block"])
        if not rows:
            return
        numbers, sizes = np.array([r["block"] for r in rows]), np.array([len(r["labels"]) for r in rows])
        every = together(rows, facts)
        rows.clear()
        for piece in mine:
            yield from run(piece, every, numbers, sizes).to_batches()
            give_back()

    tasks = min(pieces, TASKS)
    mine = blocks.sparkSession.range(0, tasks, 1, tasks).select(F.sequence("id", F.lit(pieces - 1), F.lit(tasks)).alias("pieces"))
    each = blocks.drop("values", "raw").coalesce(1).crossJoin(mine.hint("shuffle_replicate_nl"))
    return each.mapInArrow(task, schema)


def model_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in MODEL.split(", ")])


def scored_trees(blocks: DataFrame, facts: Facts, fits: list[Fit], run: dict[int, list[int]]) -> DataFrame:
    """``SCORE`` of the rows that folds hold out, under fits of trees that are grown where all bins and labels lie.

    A piece of work, a fit or some trees of a forest, scores the rows itself, so no tree leaves its task. A
    forest's pieces give shares of a score.
    """
    works = [(k, part) for k in run for part in range(len(fits[k].parts()) if fits[k].name == "rf" else 1)]
    works.sort(key=lambda x: fits[x[0]].name)  # boosting takes longest and comes first

    def score_piece(piece: int, b: Block, numbers: np.ndarray, sizes: np.ndarray) -> pa.Table:
        k, part = works[piece]
        fit = replace(fits[k], fold=int(facts.same[fits[k].fold]))
        block = np.repeat(numbers, sizes)
        place = np.arange(len(block)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ends = [(j, np.flatnonzero(b.held[:, fits[j].fold])) for j in run[k]]
        found = [np.zeros(len(at)) for _, at in ends]
        for kind, body in trees_here(b, fit, part):
            for x, (_, at) in zip(found, ends):
                for lo in range(0, len(at), BLOCK):  # a block's worth of rows at a time
                    x[lo : lo + BLOCK] += scored_here(b.taken(at[lo : lo + BLOCK]), fit.fold, kind, body)
        out = []
        for x, (j, at) in zip(found, ends):
            cells = block[at], place[at], np.full(len(at), fits[j].fold), np.full(len(at), j), b.held[at, fits[j].fold]
            out.append(pa.table([*(pa.array(c.astype(np.int32)) for c in cells), pa.array(x)], [f.split()[0] for f in SCORE.split(", ")]))
        return pa.concat_tables(out)

    return pieces_of(blocks, facts, len(works), score_piece, SCORE)


def tree_of(body: dict) -> ht.Trees:
    t = ht.Trees(1)
    for k, v in body.items():
        setattr(t, k, v)
    return t


def scored_here(b: Block, fold: int, kind: str, body) -> np.ndarray:
    """Scores of all rows of a block by one model, or by some trees of it their share of the score."""
    if kind == "constant":
        return np.full(len(b.labels), body)
    if kind == "logreg":
        mean, spread, beta = body
        return 1 / (1 + np.exp(-(((b.filled(fold) - mean) / spread) @ beta[:-1] + beta[-1])))
    if kind == "hgb":
        parts, base = body
        e = Ensemble(ht.Growth(BINS), [tree_of(t) for t, _ in parts], [v for _, v in parts])
        return 1 / (1 + np.exp(-e.add_to(np.full(len(b.labels), base), b.bins)))
    trees, values, roots = body
    t, bins, rows = tree_of(trees), b.coarse(fold), np.arange(len(b.labels))
    return sum(values[t.step(np.full(len(rows), r), rows, bins, FOREST_BINS)] for r in range(roots))


def laid_out(
    rows: DataFrame, columns: list[str], train: Column, held: Column, folds: int, fits: list[Fit], seed: int, uid: str, size: int | None = None
) -> tuple[Facts, DataFrame, DataFrame, int]:
    """What fits start from: facts, blocks of keys and of numbers, and how many blocks."""
    if len(columns) >= CURVED and any(f.name == "logreg" for f in fits):
        raise ValueError(f"logistic fits of all folds at once take fewer than {CURVED} columns")
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)  # a row is a block: one or a few at a time
    # the draws of trees go by row hash, so they are the same under any blocks
    size = size or max(256, min(BLOCK, CELLS // max(1, len(columns))))
    arrays, n_blocks = gathered(rows, columns, uid, train, held, size)
    edges, centre, gaps = quantile_edges(rows, columns)
    median = fold_medians(rows, columns, gaps, train, folds) if gaps.any() else np.zeros((folds, len(columns)))
    arrays, blocks = numbered(arrays, edges, any(f.name == "logreg" for f in fits))
    facts = Facts(len(columns), np.zeros(folds), np.zeros(folds), median, edges, centre, seed)

    def counts(b: Block) -> list[tuple[int, np.ndarray]]:
        inside = b.train.astype(float)
        return [(0, np.concatenate([b.labels @ inside, (inside.T @ inside).ravel()]))]

    found = Everywhere(blocks, facts).summed(counts)
    facts.positives, both = (found[0][:folds], found[0][folds:].reshape(folds, folds)) if found else (np.zeros(folds), np.zeros((folds, folds)))
    facts.rows = np.diag(both).copy()
    facts.same = np.argmax((both == facts.rows) & (both == facts.rows[:, None]), axis=1)
    return facts, arrays, blocks, n_blocks


def fitted(
    rows: DataFrame, columns: list[str], train: Column, held: Column, folds: int, fits: list[Fit], seed: int, uid: str, size: int | None = None
) -> tuple[DataFrame, Facts]:
    """The models of all fits as a stored table, and facts on what they were fitted from."""
    facts, _, blocks, n_blocks = laid_out(rows, columns, train, held, folds, fits, seed, uid, size)
    return stored_models(blocks, n_blocks, facts, fits, shared_fits(facts, fits)), facts


def stored_models(blocks: DataFrame, n_blocks: int, facts: Facts, fits: list[Fit], run: dict[int, list[int]]) -> DataFrame:
    mine = {k: replace(fits[k], fold=int(facts.same[fits[k].fold])) for k in run}
    return spread(pinned(models_of(blocks.sparkSession, blocks, n_blocks, facts, mine)), fits, run)


SLICE = "block int, fold int, places binary, codes binary, hashes binary, labels binary, values binary, bins binary, train binary"


def held_slices(blocks: DataFrame, facts: Facts) -> DataFrame:
    """The rows that each fold holds out of each block: their places in the block, codes and numbers."""
    names = [f.split()[0] for f in SLICE.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                b = Block(row, facts)
                for fold in np.flatnonzero(b.held.any(axis=0)).tolist():
                    at = np.flatnonzero(b.held[:, fold])
                    parts = [at.astype("<i4"), b.held[at, fold], b.hashes[at], b.labels[at].astype(np.int8), b.bins[at], b.train[at]]
                    parts.insert(4, np.zeros(0) if b.values is None else b.values[at])
                    cells = [pa.array([v], pa.int32()) for v in (row["block"], fold)] + [pa.array([x.tobytes()], pa.binary()) for x in parts]
                    yield pa.RecordBatch.from_arrays(cells, names)

    return blocks.drop("raw").mapInArrow(cut, SLICE)


def fold_scores(
    rows: DataFrame, columns: list[str], train: Column, held: Column, folds: int, fits: list[Fit], seed: int,
    uid: str = "window_uid", size: int | None = None,
) -> DataFrame:
    """Scores of every fold's held-out rows under every fit of the fold.

    ``train`` is an array of booleans, one for each fold; ``held`` an array of small integers, 0 where the fold does
    not hold the row out. Columns: those of ``rows`` without the features, ``fold``, ``held``, ``fit`` (index into
    ``fits``), ``score``. Absent values are null or NaN: boosting learns their side, the other models take the
    median of the fold's training rows. Bin edges come from all given rows, without labels. ``uid`` names a row;
    draws of forests belong to it. A fold of one class scores that class.
    """
    facts, arrays, blocks, n_blocks = laid_out(rows, columns, train, held, folds, fits, seed, uid, size)
    run = shared_fits(facts, fits)
    trees = {k: v for k, v in run.items() if n_blocks <= GATHERED and fits[k].name in TREES and facts.one_class(fits[k].fold) is None}
    rest = {k: v for k, v in run.items() if k not in trees}
    found = [scored_trees(blocks, facts, fits, trees)] if trees else []
    if rest:
        found.append(scored_models(stored_models(blocks, n_blocks, facts, fits, rest), blocks, n_blocks, facts))
    scores = reduce(DataFrame.unionByName, found).groupBy("block", "place", "fold", "fit", "held").agg(F.sum("score").alias("score"))
    named = arrays.select("block", F.posexplode("keys").alias("place", "key"))
    return pinned(scores.join(named, ["block", "place"]).select("key.*", "fold", "held", "fit", "score"))


def scored_models(models: DataFrame, blocks: DataFrame, n_blocks: int, facts: Facts) -> DataFrame:
    """``SCORE`` of the rows that folds hold out under stored models."""
    sides = held_slices(blocks, facts)
    small = models.where("kind <> 'rf'").groupBy("fold").agg(F.collect_list(F.struct("fit", "kind", "body")).alias("models"))
    # a forest's parts are large; they meet bins only, each on its own
    parts = models.where("kind = 'rf'").select("fold", F.array(F.struct("fit", "kind", "body")).alias("models"))
    at_blocks = lambda m: m.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = at_blocks(small).join(sides, ["fold", "block"]).unionByName(
        at_blocks(parts).join(sides.withColumn("values", F.lit(None).cast("binary")), ["fold", "block"])
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = batch.column("models")
            for k, row in enumerate(rows_of(batch.drop_columns("models"))):
                b, places, codes = Block(row, facts), np.frombuffer(row["places"], "<i4"), np.frombuffer(row["codes"], np.uint8)
                for m in models[k].as_py():
                    found = scored_here(b, row["fold"], m["kind"], pickle.loads(m["body"]))
                    names = [f.split()[0] for f in SCORE.split(", ")]
                    cells = [np.full(len(places), row["block"]), places, np.full(len(places), row["fold"]), np.full(len(places), m["fit"]), codes]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in cells), pa.array(found)], names)

    return pairs.mapInArrow(score, SCORE)
