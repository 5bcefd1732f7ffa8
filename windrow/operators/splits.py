"""Leakage-safe splits, seeded sampling, pseudo-records and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.operators.quality import require
from windrow.operators.ranking import hash_rank
from windrow.operators.runs import islands
from windrow.operators.scans import FAN, sums_before

CHUNK = 4096


def _hash(seed: int, c: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")))


def group_ring(rows: DataFrame, group: str, seed: int) -> DataFrame:
    """Distinct groups with ``place`` on a seeded ring, which is also their ``fold_idx``, and ``n_groups``.

    Places come from the two-level hash rank, so also a list of groups that grows with the rows
    (pseudo-records) is not ordered in one task.
    """
    if group not in rows.columns:
        raise ValueError(f"grouped folds need a {group!r} column")
    groups = rows.select(F.col(group).cast("string").alias("group_id")).distinct()
    ring = hash_rank(groups, [], seed, "group_id", out="place", total="n_groups")
    return ring.select("group_id", (F.col("place") - 1).cast("int").alias("place"), "n_groups").withColumn("fold_idx", F.col("place"))


def held_out(rows: DataFrame, group: str, n_val: int, seed: int) -> DataFrame:
    """Leave-one-group-out folds: the test group and the validation groups of each fold.

    Validation groups are the next min(n_val, n-2) on a ring ordered by md5(seed:group), so
    the same seed gives the same folds and no pairing of groups is needed. Groups not listed
    for a fold train in it.
    """
    ring = group_ring(rows, group, seed)
    k = F.greatest(F.lit(0), F.least(F.lit(n_val), F.col("n_groups") - 2))
    steps = ring.select(
        "fold_idx", F.col("place").alias("at"), "n_groups", F.explode(F.sequence(F.lit(0), k.cast("int"))).alias("step")
    ).select(
        "fold_idx", "step", ((F.col("at") + F.col("step")) % F.col("n_groups")).alias("place")
    )
    return steps.join(ring.select("place", "group_id"), "place").select(
        "fold_idx",
        F.col("group_id").alias(group),
        F.when(F.col("step") == 0, "test").otherwise("val").alias("role"),
    )


def evaluation_rows(rows: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """Rows of the held-out groups under each fold that holds them out, with their role."""
    return rows.join(folds, group)


def training_rows(rows: DataFrame, folds: DataFrame, group: str, fold_idx: int) -> DataFrame:
    """Rows of one fold whose group is not held out in it."""
    out = folds.where(F.col("fold_idx") == fold_idx).select(group)
    return rows.join(out, group, "left_anti")


def random_split(rows: DataFrame, uid: str, seed: int, shares: list[tuple[str, float]]) -> DataFrame:
    """Rows with a ``role`` by seeded rank: int(share·n) rows per share, the last takes the rest."""
    ranked = hash_rank(rows, [], seed, uid, total="__n")
    role, before = None, F.lit(0)
    for name, share in shares[:-1]:
        upto = before + F.floor(F.lit(share) * F.col("__n"))
        hit = F.col("rank") <= upto
        role = F.when(hit, name) if role is None else role.when(hit, name)
        before = upto
    return ranked.withColumn("role", role.otherwise(shares[-1][0])).drop("rank", "__n")


def downsample_negatives(
    rows: DataFrame, ratio: int | None, seed: int, uid: str, keys: list[str] | None = None
) -> DataFrame:
    """All positives and min(n_neg, ratio·max(1, n_pos)) negatives by seeded rank, per key.

    For training rows only; held-out rows are never thinned.
    """
    if ratio is None:
        return rows
    keys = keys or []
    positive, negative = rows.where("label = 1"), rows.where("label = 0")
    n_pos = F.count_if(F.col("label") == 1).alias("__pos")
    ranked = hash_rank(negative, keys, seed, uid)
    if keys:
        ranked = ranked.join(rows.groupBy(*keys).agg(n_pos), keys)
    else:
        # a single total row, joined on a constant
        ranked = ranked.withColumn("__k", F.lit(0)).join(rows.agg(n_pos).withColumn("__k", F.lit(0)), "__k")
    kept = ranked.where(F.col("rank") <= ratio * F.greatest(F.lit(1), F.col("__pos")))
    return positive.unionByName(kept.select(*positive.columns))


def pseudo_records(rows: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Rows with ``pseudo_record``: cuts at the middle of every interior run of label 0.

    ``row_index`` is dense from 0. Runs come from chunked islands; the group number is the
    number of cuts up to the row, as cuts in earlier chunks plus cuts in the row's own chunk. Both the
    runs and the cuts before a chunk are combined in levels, so no task holds the edges of the whole table.
    """
    last = rows.agg(F.max("row_index")).head()[0]  # one number
    zeros = islands(rows.where("label = 0"), [], idx="row_index", chunk=chunk, fan=fan)
    cuts = zeros.where((F.col("first_idx") > 0) & (F.col("last_idx") < F.lit(last))).select(
        (F.col("first_idx") + F.floor(F.col("n") / 2)).alias("row_index"),
        F.lit(1).alias("__cut"),
    )
    block = F.floor(F.col("row_index") / chunk)
    marked = rows.join(cuts, "row_index", "left").withColumn("__chunk", block)
    per_chunk = sums_before(marked.groupBy("__chunk").agg(F.count("__cut").alias("__n")), "__chunk", "__n", "__before", fan=fan)
    inside = Window.partitionBy("__chunk").orderBy("row_index")
    return (
        marked.join(per_chunk, "__chunk")
        .withColumn(
            "pseudo_record",
            (F.col("__before") + F.count("__cut").over(inside)).cast("int"),
        )
        .drop("__cut", "__chunk", "__before")
    )


def mark_repeats(rows: DataFrame) -> DataFrame:
    """Rows with ``is_repeat``: an earlier row carries the same ``row_hash``.

    The first index per hash is a map-side minimum; the join back is on the unique row index,
    so a group holding most of the rows stays spread.
    """
    firsts = rows.groupBy("row_hash").agg(F.min("row_index").alias("row_index"))
    return rows.join(
        firsts.select("row_index", F.lit(False).alias("is_repeat")), "row_index", "left"
    ).fillna(True, ["is_repeat"])


def spread_sample(files: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Per group every max(1, n div size)-th file in order, the first ``size`` of those."""
    w = Window.partitionBy(group)
    i = F.row_number().over(w.orderBy(order)) - 1
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / size))
    return (
        files.withColumns({"__i": i, "__step": step})
        .where((F.col("__i") % F.col("__step") == 0) & (F.col("__i") / F.col("__step") < size))
        .drop("__i", "__step")
    )


def feature_columns(columns: list[str], keys: set[str], subset: str = "all") -> list[str]:
    """Feature columns by name: all, amplitude_invariant or amplitude_dependent."""
    from windrow.fixed_values import AMPLITUDE_DEPENDENT_MARKERS, AMPLITUDE_INVARIANT_MARKERS

    has = lambda c, marks: any(m in c for m in marks)
    features = [c for c in columns if c not in keys]
    if subset == "all":
        return features
    if subset == "amplitude_invariant":
        return [c for c in features if has(c, AMPLITUDE_INVARIANT_MARKERS)]
    if subset == "amplitude_dependent":
        return [
            c
            for c in features
            if has(c, AMPLITUDE_DEPENDENT_MARKERS) and not has(c, AMPLITUDE_INVARIANT_MARKERS)
        ]
    raise ValueError(f"unknown feature subset: {subset}")


def require_disjoint(folds: DataFrame, group: str) -> DataFrame:
    """Fails when a group has two roles in a fold."""
    per = folds.groupBy("fold_idx", group).agg(F.count(F.lit(1)).alias("n_roles"))
    return require(per, F.col("n_roles") == 1, "a group has two roles in one fold")
