"""Models, grouped search and evaluation protocols.

The fits of all folds, models and grid points of a protocol run together (``fold_fits``); their scores are one table,
and everything after the fits (operating points, runs, events, metrics) is one plan keyed by fold and model. The
shipped model is a Spark ML pipeline.
"""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.config import Settings
from windrow.fixed_values import SEARCH_GRIDS
from windrow.operators import splits as sp
from windrow.operators.events import event_metrics_of_runs, validation_event_score
from windrow.operators.fold_fits import Fit, fold_scores
from windrow.operators.metrics import ranking_metrics, window_metrics
from windrow.operators.quality import require_deduplicated
from windrow.operators.ranking import hash_rank
from windrow.operators.runs import positive_runs
from windrow.operators.thresholds import pick_k, pick_threshold, pick_threshold_and_k
from windrow.operators.windows import drop_guard, overlap_sweep, relabel
from windrow.session import pinned

TEST, VAL = 1, 2  # how a fold holds a row out; 0 where it does not


def class_sizes(train: DataFrame) -> tuple[int, int]:
    """Rows and positives, two numbers."""
    row = train.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("p")
    ).head()
    return row["n"], row["p"]


def balanced_weight(n: int, n_pos: int) -> Column:
    """n / (2 · class size), as sums to n over the rows."""
    pos, neg = n / (2 * max(1, n_pos)), n / (2 * max(1, n - n_pos))
    return F.when(F.col("label") == 1, pos).otherwise(neg)


def estimator(name: str, columns: list[str], n: int, seed: int, params: dict | None = None) -> Pipeline:
    """An unfitted pipeline; imputing and scaling are inside, so they see training rows only."""
    p = params or {}
    filled = [f"__{c}" for c in columns]
    impute = Imputer(strategy="median", inputCols=columns, outputCols=filled)
    common = dict(labelCol="label", featuresCol="features", probabilityCol="probability")
    if name == "logreg":
        stages = [
            impute,
            VectorAssembler(inputCols=filled, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True),
            # the penalty is per mean loss here, hence 1/(C·n)
            LogisticRegression(
                weightCol="weight", regParam=1.0 / (p.get("C", 1.0) * n), elasticNetParam=0.0,
                standardization=False, maxIter=2000, **common,
            ),
        ]
    elif name == "rf":
        stages = [
            impute,
            VectorAssembler(inputCols=filled, outputCol="features"),
            RandomForestClassifier(
                numTrees=300, maxDepth=p.get("max_depth") or 30, weightCol="weight", seed=seed,
                minInstancesPerNode=p.get("min_samples_leaf", 1), featureSubsetStrategy="sqrt", **common,
            ),
        ]
    elif name == "hgb":
        # leaves are bounded through the depth: 15 leaves at 4 levels, 31 at 5
        depth = (p.get("max_leaf_nodes", 31) + 1).bit_length() - 1
        stages = [
            VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"),
            GBTClassifier(
                labelCol="label", featuresCol="features", maxIter=100, maxBins=255, maxDepth=depth,
                stepSize=p.get("learning_rate", 0.1), minInstancesPerNode=20, seed=seed,
            ),
        ]
    else:
        raise ValueError(f"unknown model: {name}")
    return Pipeline(stages=stages)


def with_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with the positive-class ``score``."""
    scored = model.transform(rows)
    score = vector_to_array("probability")[1]
    return scored.select(*[F.col(f"`{c}`") for c in rows.columns], score.alias("score"))


def fit(name: str, train: DataFrame, columns: list[str], seed: int, params: dict | None = None) -> PipelineModel:
    n, n_pos = class_sizes(train)
    used = train.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns], "label")
    return estimator(name, columns, n, seed, params).fit(used.withColumn("weight", balanced_weight(n, n_pos)))


def in_sample_scores(name: str, rows: DataFrame, columns: list[str], seed: int, uid: str = "window_uid", params: dict | None = None) -> DataFrame:
    """Fit on all rows, score all rows."""
    every = F.array(F.lit(True)), F.array(F.lit(TEST).cast("tinyint"))
    found = fold_scores(rows, columns, *every, 1, [Fit(0, name, tuple((params or {}).items()))], seed, uid)
    return found.drop("fold", "held", "fit")


def held_by_fold(rows: DataFrame, folds: DataFrame, group: str) -> tuple[DataFrame, int]:
    """Rows with ``__held``, one code for each fold, and the number of folds. A fold holds out a few groups."""
    n = folds.agg(F.max("fold_idx")).head()[0]
    n = 0 if n is None else n + 1
    code = F.when(F.col("role") == "test", TEST).otherwise(VAL)
    roles = folds.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("fold_idx", code.alias("c")))).alias("__roles"))
    held = F.array(*[F.coalesce(F.col("__roles")[i], F.lit(0)).cast("tinyint") for i in range(n)])
    return rows.join(roles, group, "left").withColumn("__held", held).drop("__roles"), n


def thinned(rows: DataFrame, train: Column, n: int, ratio: int | None, seed: int, uid: str) -> Column:
    """Which folds train on a row: ``train`` less the negatives beyond ``ratio`` times the fold's positives.

    All folds order negatives by the same seeded hash, so a fold's choice is a bound on it: one string a fold.
    """
    if ratio is None:
        return train
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(uid).cast("string")))
    narrow = rows.select(uid, "label", F.posexplode(train).alias("fold", "__in")).where("__in")
    kept = sp.downsample_negatives(narrow, ratio, seed, uid, ["fold"]).where("label = 0")
    bound = {r["fold"]: r["d"] for r in kept.groupBy("fold").agg(F.max(digest).alias("d")).collect()}  # one row a fold
    inside = F.array(*[(F.col("label") == 1) | (digest <= F.lit(bound.get(i, ""))) for i in range(n)])
    return F.zip_with(train, inside, lambda a, b: a & b)


def points_of(name: str) -> list[dict]:
    grid = SEARCH_GRIDS.get(name, {})
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())] if grid else []


def search_folds(
    rows: DataFrame, columns: list[str], train: Column, n: int, names: list[str], group: str, n_splits: int, seed: int, uid: str
) -> dict[tuple[int, str], tuple[dict, float]]:
    """The best grid point of every fold and model by mean average precision over group folds inside its training rows.

    All folds, inner folds and grid points are fitted together. ({}, NaN) without a grid, with fewer than two
    groups or with a single class in the fold's training rows.
    """
    names = [m for m in names if points_of(m)]
    marked = rows.withColumn("__train", train)
    narrow = marked.select(F.col(group).cast("string").alias("__g"), "label", F.posexplode("__train").alias("fold", "__in")).where("__in")
    facts = {r["fold"]: r for r in narrow.groupBy("fold").agg(F.count_distinct("__g").alias("g"), F.count_distinct("label").alias("c")).collect()}
    usable = {i: min(n_splits, r["g"]) for i, r in facts.items() if r["g"] > 1 and r["c"] > 1}
    if not names or not usable:
        return {}
    ring = hash_rank(narrow.select("fold", "__g").distinct(), ["fold"], seed, "__g")
    inner = F.map_from_entries(F.collect_list(F.struct("fold", F.col("rank").cast("int"))))
    places = ring.groupBy("__g").agg(inner.alias("__inner"))
    marked = marked.join(places.withColumnRenamed("__g", "__group"), F.col(group).cast("string") == F.col("__group"), "left").drop("__group")
    pairs = [(i, j) for i, k in sorted(usable.items()) for j in range(k)]
    own = lambda i: F.col("__train")[i]
    out = lambda i, j: F.coalesce((F.col("__inner")[i] - 1) % usable[i] == j, F.lit(False))
    within = F.array(*[own(i) & ~out(i, j) for i, j in pairs])
    held = F.array(*[F.when(own(i) & out(i, j), TEST).otherwise(0).cast("tinyint") for i, j in pairs])
    marked = marked.withColumns({"__within": within, "__out": held})
    fits = [Fit(x, m, tuple(point.items())) for x in range(len(pairs)) for m in names for point in points_of(m)]
    kept = marked.select(F.col(uid), "label", *[F.col(f"`{c}`") for c in columns], "__within", "__out")
    scored = fold_scores(kept, columns, F.col("__within"), F.col("__out"), len(pairs), fits, seed, uid)
    found = ranking_metrics(scored.select("fit", "label", "score"), ["fit"]).select("fit", "pr_auc").collect()  # one row a fit
    value = {r["fit"]: r["pr_auc"] for r in found}
    best: dict[tuple[int, str], tuple[dict, float]] = {}
    for i in usable:
        for m in names:
            means = []
            for point in points_of(m):
                mine = [value[k] for k, f in enumerate(fits) if pairs[f.fold][0] == i and f.name == m and dict(f.params) == point and k in value]
                mine = [v for v in mine if v == v]
                means.append(sum(mine) / len(mine) if mine else float("nan"))
            top = max(range(len(means)), key=lambda x: (means[x] == means[x], means[x], -x))
            best[i, m] = points_of(m)[top], means[top]
    return best


def search(
    name: str, train: DataFrame, columns: list[str], group: str = "subject_id", n_splits: int = 3, seed: int = 42, uid: str = "window_uid"
) -> tuple[dict, float]:
    """The best grid point of one model over all given rows."""
    found = search_folds(train, columns, F.array(F.lit(True)), 1, [name], group, n_splits, seed, uid)
    return found.get((0, name), ({}, float("nan")))


def score_folds(
    rows: DataFrame, columns: list[str], settings: Settings, folds: DataFrame, only: list[int] | None = None, uid: str = "window_uid"
) -> DataFrame:
    """Held-out scores of every fold and model as one stored table.

    Columns of ``rows`` without the features, plus ``fold_idx, role, model, score``. Negatives are thinned in
    training rows only.
    """
    tr, seed = settings.training, settings.splits.seed
    marked, n = held_by_fold(rows, folds, "subject_id")
    names = [c for c in rows.columns if c not in columns]
    free = thinned(marked, F.transform("__held", lambda h: h == 0), n, tr.negative_downsample_ratio, seed, uid)
    marked = pinned(marked.withColumn("__train", free))
    chosen = {}
    if tr.search:
        chosen = search_folds(marked, columns, F.col("__train"), n, list(tr.models), "subject_id", tr.inner_splits, seed, uid)
    fits = [
        Fit(i, m, tuple(chosen.get((i, m), ({}, 0.0))[0].items())) for i in (range(n) if only is None else only) for m in tr.models
    ]
    scored = fold_scores(marked, columns, F.col("__train"), F.col("__held"), n, fits, seed, uid)
    model = F.element_at(F.array(*[F.lit(f.name) for f in fits]), F.col("fit") + 1)
    return scored.select(
        *names, F.col("fold").alias("fold_idx"), F.when(F.col("held") == TEST, "test").otherwise("val").alias("role"), model.alias("model"), "score"
    )


FOLD = ["fold_idx", "model"]


def operating_points(scored: DataFrame, settings: Settings) -> DataFrame:
    """Threshold, k and validation score per fold and model, from validation rows only."""
    tr, reach = settings.training, settings.windowing.reach
    val = scored.where("role = 'val'")
    ks = list(tr.consecutive_k)
    if tr.joint_threshold_k:
        points = pick_threshold_and_k(val, FOLD, ks, tr.joint_grid, reach).withColumnRenamed("f2", "val_score")
    else:
        cut = pick_threshold(val, FOLD, tr.threshold_metric).withColumnRenamed("achieved", "val_score")
        at = val.join(cut.select(*FOLD, "threshold"), FOLD)
        points = cut.join(pick_k(at, FOLD, F.col("threshold"), ks, reach).drop("f2"), FOLD)
    classes = val.groupBy(*FOLD).agg(F.count_distinct("label").alias("c"))
    both = F.col("c") > 1
    listed = scored.select(*FOLD).distinct()
    return listed.join(points.join(classes, FOLD), FOLD, "left").select(
        *FOLD,
        F.when(both, F.col("threshold")).otherwise(0.5).alias("threshold"),
        F.when(both, F.col("best_k")).otherwise(1).alias("k"),
        F.when(both, F.col("val_score")).otherwise(F.lit("NaN").cast("double")).alias("val_score"),
    )


def events_at(
    rows: DataFrame, points: DataFrame, truth: DataFrame, durations: DataFrame | None, bin_sec: float
) -> DataFrame:
    """Event metrics per fold and model at each one's own threshold and k."""
    at = rows.join(points.select(*FOLD, "threshold", "k"), FOLD).withColumn(
        "pred", F.col("score") >= F.col("threshold")
    )
    runs = positive_runs(at, 1, FOLD).join(points.select(*FOLD, "k"), FOLD)
    return event_metrics_of_runs(
        at, runs.where(F.col("n_windows") >= F.col("k")), truth, FOLD, durations, bin_sec
    )


def evaluate_folds(
    scored: DataFrame, settings: Settings, truth: DataFrame, durations: DataFrame | None = None,
    bin_sec: float = 3600.0,
) -> DataFrame:
    """Fold detail: operating point from validation rows, metrics of the test rows at it."""
    points = pinned(operating_points(scored, settings))
    test, val = scored.where("role = 'test'"), scored.where("role = 'val'")
    val_events = validation_event_score(events_at(val, points, truth, durations, bin_sec))
    at = test.join(points.select(*FOLD, F.col("threshold").alias("__t")), FOLD)
    windows = window_metrics(at, FOLD, F.col("__t"))
    events = events_at(test, points, truth, durations, bin_sec).drop("source")
    subjects = test.groupBy(*FOLD).agg(F.min("subject_id").alias("test_subject"))
    sizes = val.groupBy(*FOLD).agg(F.count(F.lit(1)).alias("n_val"))
    out = (
        windows.join(events, FOLD)
        .join(points.select(*FOLD, "k", "val_score"), FOLD)
        .join(val_events.select(*FOLD, F.col("event_f2").alias("val_event_f2")), FOLD, "left")
        .join(subjects, FOLD)
        .join(sizes, FOLD, "left")
    )
    if settings.training.select_on == "event_f2":
        out = out.withColumn("val_score", F.col("val_event_f2"))
    return out.withColumn("protocol", F.lit("loso"))


def prepared(rows: DataFrame, columns: list[str], settings: Settings) -> tuple[DataFrame, list[str]]:
    """Rows and columns as every protocol takes them.

    Labels at the overlap threshold of the settings (if one is set and rows know their overlap), no guard
    windows, the chosen feature subset, and no two rows with equal features: the query fails on
    repeats unless ``data.dedupe`` is off. The count of repeats is one row, read with the rows.
    """
    tr = settings.training
    if tr.relabel_overlap_min is not None:
        rows = relabel(rows, tr.relabel_overlap_min)
    rows = drop_guard(rows)
    columns = sp.feature_columns(columns, set(), tr.feature_subset)
    if settings.data.dedupe:
        require_deduplicated(rows, columns).collect()  # one row
    return rows, columns


def grouped_evaluation(
    rows: DataFrame, columns: list[str], settings: Settings, truth: DataFrame,
    durations: DataFrame | None = None, bin_sec: float = 3600.0,
) -> DataFrame:
    """Leave-one-subject-out: fit per fold, pick on validation, measure the test subject once."""
    rows, columns = prepared(rows, columns, settings)
    folds = sp.held_out(rows, "subject_id", settings.splits.n_val_subjects, settings.splits.seed)
    sp.require_disjoint(folds, "subject_id").agg(F.count(F.lit(1))).collect()  # one row
    scored = score_folds(rows, columns, settings, folds)
    return evaluate_folds(scored, settings, truth, durations, bin_sec)


def random_window_evaluation(rows: DataFrame, columns: list[str], settings: Settings) -> DataFrame:
    """The contrast that ignores subjects: 20/10/70 test, validation, training rows."""
    tr, seed = settings.training, settings.splits.seed
    rows, columns = prepared(rows, columns, settings)
    shares = [("test", 0.2), ("val", 0.1), ("train", 0.7)]
    split = pinned(sp.random_split(rows, "window_uid", seed, shares))
    free = thinned(split, F.array(F.col("role") == "train"), 1, tr.negative_downsample_ratio, seed, "window_uid")
    held = F.array(F.when(F.col("role") == "test", TEST).when(F.col("role") == "val", VAL).otherwise(0).cast("tinyint"))
    fits = [Fit(0, m) for m in tr.models]
    scored = fold_scores(split, columns, free, held, 1, fits, seed)
    model = F.element_at(F.array(*[F.lit(f.name) for f in fits]), F.col("fit") + 1)
    scored = scored.select("label", "source", "role", model.alias("model"), "score")
    cut = pick_threshold(scored.where("role = 'val'"), ["model"], tr.threshold_metric)
    test = scored.where("role = 'test'").join(
        cut.select("model", F.col("threshold").alias("__t")), "model"
    )
    return window_metrics(test, ["model"], F.col("__t")).join(
        cut.select("model", F.col("achieved").alias("val_score")), "model"
    ).withColumn("protocol", F.lit("random_window"))


def export_scores(
    rows: DataFrame, columns: list[str], settings: Settings, subjects: list[str], model: str
) -> DataFrame:
    """Held-out scores of named subjects from their own folds, with each fold's operating point."""
    from dataclasses import replace

    one = replace(settings, training=replace(settings.training, models=(model,)))
    folds = sp.held_out(rows, "subject_id", settings.splits.n_val_subjects, settings.splits.seed)
    tested = folds.where((F.col("role") == "test") & F.col("subject_id").isin(subjects)).select("fold_idx").distinct()
    scored = score_folds(rows, columns, one, folds, sorted(r["fold_idx"] for r in tested.collect()))  # as many as asked
    points = operating_points(scored, one).select(
        *FOLD, F.col("threshold").alias("chosen_threshold"), F.col("k").alias("chosen_k")
    )
    return scored.where("role = 'test'").join(points, FOLD).select(
        "subject_id", "record_id", "window_idx", "t_start_sec", "t_end_sec", "label", "score",
        "chosen_threshold", "chosen_k", "model",
    )


def final_fit(
    rows: DataFrame, columns: list[str], settings: Settings, model: str
) -> tuple[PipelineModel, DataFrame]:
    """The shipped model, fitted on every subject, and its one-row metadata."""
    seed = settings.splits.seed
    thin = sp.downsample_negatives(rows, settings.training.negative_downsample_ratio, seed, "window_uid")
    fitted = fit(model, thin, columns, seed)
    facts = rows.agg(
        F.count_distinct("subject_id").alias("n_subjects"), F.count(F.lit(1)).alias("n_rows_available")
    ).withColumn("__k", F.lit(0))
    used = thin.agg(F.count(F.lit(1)).alias("n_rows_fitted")).withColumn("__k", F.lit(0))
    meta = facts.join(used, "__k").select(
        F.lit(model).alias("model"), "n_subjects", "n_rows_available", "n_rows_fitted",
        F.lit(len(columns)).alias("n_features"),
        F.lit(settings.training.feature_subset).alias("feature_subset"),
        F.lit(settings.extraction_hash).alias("extraction_hash"),
        F.lit(settings.full_hash).alias("full_hash"),
        F.array(*[F.lit(c) for c in columns]).alias("feature_columns"),
    )
    return fitted, meta


def fold_of(seed: int, key: str, n_folds: int) -> Column:
    """A fold number by seeded hash of a group or a row id; sizes vary a little."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(n_folds)).cast("int")


def leakage_study(
    rows: DataFrame, columns: list[str], models: list[str], seed: int, group: str = "pseudo_record",
    uid: str = "row_index", n_folds: int = 5,
) -> DataFrame:
    """Four protocols (grouped or random folds, with or without repeats) per model.

    Each row is scored by the model of the folds it is not in. All protocols, folds and models are fitted together.
    """
    protocols = [(f"{split}_{repeats}", split, repeats) for repeats in ("with_duplicates", "deduplicated") for split in ("random", "grouped")]
    train, held = [], []
    for _, split, repeats in protocols:
        inside = F.lit(True) if repeats == "with_duplicates" else ~F.col("is_repeat")
        own = fold_of(seed, group if split == "grouped" else uid, n_folds)
        for i in range(n_folds):
            train.append(inside & (own != i))
            held.append(F.when(inside & (own == i), TEST).otherwise(0).cast("tinyint"))
    fits = [Fit(i, m) for i in range(len(train)) for m in models]
    names = [c for c in rows.columns if c not in columns]
    used = rows.select(*columns, *names, F.array(*train).alias("__train"), F.array(*held).alias("__held"))
    scored = fold_scores(pinned(used), columns, F.col("__train"), F.col("__held"), len(train), fits, seed, uid)
    named = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), k)
    scored = scored.select(
        named([p for p, _, _ in protocols], F.floor(F.col("fold") / n_folds).cast("int") + 1).alias("protocol"),
        named([f.name for f in fits], F.col("fit") + 1).alias("model"), "label", "source", "score",
    )
    keys = ["protocol", "model"]
    cut = pick_threshold(scored, keys).select(*keys, F.col("threshold").alias("__t"))
    return window_metrics(scored.join(cut, keys), keys, F.col("__t"))


def overlap_model_sweep(
    rows: DataFrame, columns: list[str], settings: Settings, truth: DataFrame, fractions: list[float],
    model: str = "logreg", bin_sec: float = 3600.0,
) -> DataFrame:
    """The grouped evaluation of one model at each overlap threshold, averaged over folds.

    ``rows`` keep their guard windows; each threshold relabels them and drops what stays guard.
    """
    from dataclasses import replace

    from windrow.operators.report import sweep_summary

    def evaluated(f: float) -> DataFrame:
        training = replace(settings.training, models=(model,), search=False, relabel_overlap_min=f)
        detail = grouped_evaluation(rows, columns, replace(settings, training=training), truth, None, bin_sec)
        return pinned(detail.withColumn("min_overlap_frac", F.lit(float(f))))

    with ThreadPoolExecutor(len(fractions)) as pool:  # a few thresholds, side by side
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(evaluated), fractions))
    detail = parts[0]
    for part in parts[1:]:
        detail = detail.unionByName(part)
    return sweep_summary(detail, "min_overlap_frac").join(
        overlap_sweep(rows, fractions), "min_overlap_frac"
    )


def score_recordings(model: PipelineModel, table: DataFrame, columns: list[str]) -> DataFrame:
    """Scores of a feature table from new recordings; fails when a column is missing."""
    absent = [c for c in columns if c not in table.columns]
    if absent:
        raise ValueError(f"schema_mismatch: missing {absent}")
    keys = [c for c in table.columns if c not in columns]
    typed = table.select(
        *[F.col(f"`{c}`") for c in keys], *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]
    )
    return with_scores(model, typed).drop(*columns)
