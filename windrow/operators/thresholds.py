"""Operating points: exact thresholds, the k-consecutive rule, both together, and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.ratios import fbeta, nan
from windrow.operators import superlevel as sl
from windrow.operators.events import match_counts, match_events
from windrow.operators.ranking import quantiles, ranked_blocks
from windrow.operators.runs import longest_run, positive_runs
from windrow.session import pinned


def pick_threshold(rows: DataFrame, keys: list[str], metric: str = "f2") -> DataFrame:
    """The threshold with the best F-beta per key, over the ends of tie blocks.

    It lies midway to the next lower distinct score. Among equal values the highest score
    wins. Without positives or with a single distinct score: 0.5 and 0.
    """
    beta = 2 if metric == "f2" else 1
    b = ranked_blocks(rows, keys)
    f = fbeta(F.col("tp"), F.col("fp"), F.col("total_pos") - F.col("tp"), beta)
    best = b.withColumn("f", f).groupBy(*keys).agg(
        F.max(F.struct("f", "score", "next_score")).alias("best"),
        F.max("total_pos").alias("n_pos"),
        F.max("n_scores").alias("n_scores"),
    )
    usable = (F.col("n_pos") > 0) & (F.col("n_scores") > 1)
    cut = F.coalesce(
        (F.col("best.score") + F.col("best.next_score")) / 2, F.col("best.score")
    )
    return best.select(
        *keys,
        F.when(usable, cut).otherwise(F.lit(0.5)).alias("threshold"),
        F.when(usable, F.col("best.f")).otherwise(F.lit(0.0)).alias("achieved"),
    )


def mask_counts(
    windows: DataFrame, keys: list[str], ks: list[int], reach: int = 0
) -> DataFrame:
    """Per key and k: windows covered by a run of at least k (``marked``), positives of them.

    ``windows`` holds predicted windows flagged by ``pred``. Where windows do not overlap,
    covered windows are the runs' own members and the runs alone carry the counts.
    """
    if reach == 0:
        runs = positive_runs(windows, 1, keys, count_positives=True)
        length, n, pos = F.col("n_windows"), F.col("n_windows"), F.col("n_pos")
        base = runs
    else:
        runs = positive_runs(windows, 1, keys)
        base = longest_run(windows, runs, keys, reach)
        length, n, pos = F.col("run_len"), F.lit(1), (F.col("label") == 1).cast("int")
    sums = []
    for i, k in enumerate(ks):
        kept = length >= k
        sums.append(F.sum(F.when(kept, n).otherwise(0)).alias(f"m{i}"))
        sums.append(F.sum(F.when(kept, pos).otherwise(0)).alias(f"p{i}"))
    wide = base.groupBy(*keys).agg(*sums)
    per_k = F.array(
        *[
            F.struct(
                F.lit(i).alias("k_order"),
                F.lit(k).alias("k"),
                F.col(f"m{i}").alias("marked"),
                F.col(f"p{i}").alias("marked_pos"),
            )
            for i, k in enumerate(ks)
        ]
    )
    return wide.select(*keys, F.inline(per_k))


def _class_counts(windows: DataFrame, keys: list[str]) -> DataFrame:
    return windows.groupBy(*keys).agg(
        F.count_if(F.col("label") == 1).alias("n_pos"),
        F.count_if(F.col("label") != 1).alias("n_neg"),
    )


def _mask_f2(n_pos: Column) -> Column:
    tp = F.coalesce("marked_pos", F.lit(0))
    return fbeta(tp, F.coalesce("marked", F.lit(0)) - tp, n_pos - tp, 2)


def _options(df: DataFrame, ks: list[int]) -> DataFrame:
    """Each row once per k of the literal list, in list order."""
    options = F.array(*[F.struct(F.lit(i).alias("k_order"), F.lit(k).alias("k")) for i, k in enumerate(ks)])
    return df.select("*", F.inline(options))


def pick_k(
    windows: DataFrame, keys: list[str], threshold: Column | float, ks: list[int], reach: int = 0
) -> DataFrame:
    """The first k of the list with the strictly greatest F2 of its run mask, per key."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    counts = mask_counts(windows.withColumn("pred", F.col("score") >= thr), keys, ks, reach)
    tried = _options(_class_counts(windows, keys), ks).join(
        counts, keys + ["k_order", "k"], "left"
    )
    tried = tried.withColumn("f2", _mask_f2(F.col("n_pos")))
    best = F.max(F.struct("f2", (-F.col("k_order")).alias("o"), "k"))
    return tried.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.k").alias("best_k"), F.col("b.f2").alias("f2")
    )


def threshold_candidates(
    windows: DataFrame, keys: list[str], lo: float, hi: float, n_grid: int, drop_top: bool
) -> DataFrame:
    """Distinct score quantiles per key as the sorted array ``candidates``.

    With ``drop_top`` those at the highest score go, unless only one is left.
    """
    q = quantiles(windows, keys, lo, hi, n_grid)
    c = F.array_distinct("q")
    if drop_top:
        # the last quantile asked for is 1.0, the highest score
        top = F.element_at("q", -1)
        c = F.when(F.size(c) > 1, F.filter(c, lambda v: v < top)).otherwise(c)
    return q.select(*keys, c.alias("candidates"))


def pick_threshold_and_k(
    windows: DataFrame, keys: list[str], ks: list[int], n_grid: int = 24, reach: int = 0
) -> DataFrame:
    """Threshold and k chosen together by the F2 of the run mask, per key.

    Candidates are score quantiles. Ties go to the smaller k in list order, then the lower
    threshold. With one class only: 0.5, the first k, NaN.
    """
    cands = pinned(threshold_candidates(windows, keys, 0.0, 1.0, n_grid, drop_top=True))
    narrow = windows.select(*keys, "record_id", "window_idx", "t_start_sec", "label", "score")
    levels = sl.opened(sl.with_levels(narrow, cands, keys), keys, sorted(set(ks)), reach)
    per_k = F.array(*[F.struct(F.lit(i).alias("k_order"), F.lit(k).alias("k"), F.col(f"open_{k}").alias("reached")) for i, k in enumerate(ks)])
    wide = levels.select(*keys, "label", F.inline(per_k))
    positive = (F.col("label") == 1).cast("int")
    sums = sl.steps(wide, keys + ["k_order", "k"], (F.col("reached"), {"marked": F.lit(1), "marked_pos": positive}))
    grid = sl.at_candidates(_options(cands, ks), sums, keys + ["k_order", "k"], ["marked", "marked_pos"])
    tried = grid.join(_class_counts(windows, keys), keys).withColumn("f2", _mask_f2(F.col("n_pos")))
    best = F.max(
        F.struct("f2", (-F.col("k_order")).alias("o"), (-F.col("threshold")).alias("t"), "k")
    )
    picked = tried.groupBy(*keys).agg(
        best.alias("b"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg")
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return picked.select(
        *keys,
        F.when(both, -F.col("b.t")).otherwise(F.lit(0.5)).alias("threshold"),
        F.when(both, F.col("b.k")).otherwise(F.lit(ks[0] if ks else 1)).alias("best_k"),
        F.when(both, F.col("b.f2")).otherwise(nan()).alias("f2"),
    )


def threshold_sweep(
    windows: DataFrame, truth: DataFrame, k: int, n_grid: int = 60,
    lo: float = 0.50, hi: float = 0.9995, bin_sec: float = 3600.0,
) -> DataFrame:
    """Per record and candidate threshold: segments, time in alarm, detections, false alarms.

    All are sums of steps (``superlevel``): one pass over the windows, whatever the number of thresholds.
    """
    cands = pinned(threshold_candidates(windows, ["record_id"], lo, hi, n_grid, drop_top=False))
    narrow = windows.select("record_id", "window_idx", "t_start_sec", "t_end_sec", "score")
    rows = pinned(sl.opened(sl.with_levels(narrow, cands, ["record_id"]), [], [k]))
    level, link = f"open_{k}", f"link_{k}"
    alone = {"segments": F.lit(1), "alarm_sec": F.col("t_end_sec") - F.col("t_start_sec")}
    shared = {"segments": F.lit(-1), "alarm_sec": F.coalesce(F.col("next_start") - F.col("t_end_sec"), F.lit(0.0))}
    runs = sl.steps(rows, ["record_id"], (F.col(level), alone), (F.col(link), shared))
    marks, met = sl.touched(rows, truth, level, link, bin_sec)
    marks = pinned(marks)
    detected = sl.steps(met, ["record_id"], (F.col("level"), {"detected": F.lit(1)}))
    names = ["segments", "alarm_sec", "matched", "detected"]
    sums = runs.unionByName(sl.mark_steps(rows, marks, level, link), True).unionByName(detected, True)
    sums = sums.groupBy("record_id", "level").agg(*[F.sum(n).alias(n) for n in names])
    lengths = windows.groupBy("record_id").agg(F.max("t_end_sec").alias("duration_sec"))
    whole = lambda c: F.round(c).cast("long")
    return sl.at_candidates(cands, sums, ["record_id"], names).join(lengths, "record_id").select(
        "record_id", "threshold", whole(F.col("segments")).alias("segments"),
        (F.col("alarm_sec") / F.col("duration_sec")).alias("time_in_alarm"),
        whole(F.col("detected")).alias("detected"),
        whole(F.col("segments") - F.col("matched")).alias("false_alarms"),
    )


def k_sweep(
    windows: DataFrame, truth: DataFrame, threshold: float, ks=(1, 2, 3, 4, 5),
    bin_sec: float = 3600.0,
) -> DataFrame:
    """Per record and k at a fixed threshold: segments, time in alarm, detections, false alarms."""
    flagged = windows.withColumn("pred", F.col("score") >= threshold)
    every_k = F.array(*[F.lit(k) for k in ks])
    runs = (
        positive_runs(flagged, 1)
        .withColumn("k", F.explode(every_k))
        .where(F.col("n_windows") >= F.col("k"))
    )
    listed = windows.select("record_id").distinct().withColumn("k", F.explode(every_k))
    return _sweep_rows(windows, listed, runs, truth, ["k"], bin_sec)


def _sweep_rows(windows, listed, runs, truth, by, bin_sec):
    on = ["record_id"] + by
    truth_in = truth.select("record_id", "seizure_idx", "start_sec", "end_sec").join(
        listed, "record_id"
    )
    counts = match_counts(match_events(runs, truth_in, by, bin_sec), on)
    lengths = windows.groupBy("record_id").agg(F.max("t_end_sec").alias("duration_sec"))
    return (
        listed.join(counts, on, "left")
        .join(lengths, "record_id")
        .select(
            *on,
            F.coalesce("n_runs", F.lit(0)).alias("segments"),
            (F.coalesce("alarm_sec", F.lit(0.0)) / F.col("duration_sec")).alias("time_in_alarm"),
            F.coalesce("n_detected", F.lit(0)).alias("detected"),
            F.coalesce("false_alarms", F.lit(0)).alias("false_alarms"),
        )
    )
