"""Window-level metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.ratios import fbeta, nan, ratio_or_zero
from windrow.operators.quality import require_single_source, single_source_columns
from windrow.operators.ranking import ranked_blocks


def confusion_columns(label: Column, predicted: Column) -> list[Column]:
    y = label == 1
    return [
        F.count_if(y & predicted).alias("tp"),
        F.count_if(~y & predicted).alias("fp"),
        F.count_if(y & ~predicted).alias("fn"),
        F.count_if(~y & ~predicted).alias("tn"),
    ]


def add_window_ratios(counts: DataFrame, suffix: str = "") -> DataFrame:
    """Precision, recall, F1, F2 and accuracy from ``tp, fp, fn, tn``."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            f"precision{suffix}": ratio_or_zero(tp, tp + fp),
            f"recall{suffix}": ratio_or_zero(tp, tp + fn),
            f"f1{suffix}": fbeta(tp, fp, fn, 1),
            f"f2{suffix}": fbeta(tp, fp, fn, 2),
            f"accuracy{suffix}": ratio_or_zero(tp + tn, tp + fp + fn + tn),
        }
    )


def ranking_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision and ROC area (ties count half) per key; NaN with one class."""
    b = ranked_blocks(rows, keys)
    both = (F.max("total_pos") > 0) & (F.max("total_neg") > 0)
    share = F.col("pos") / F.greatest(F.col("total_pos"), F.lit(1))
    gain = share * (F.col("tp") / (F.col("tp") + F.col("fp")))
    wins = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    pairs = F.greatest(F.max("total_pos") * F.max("total_neg"), F.lit(1))
    return b.groupBy(*keys).agg(
        F.when(both, F.sum(gain)).otherwise(nan()).alias("pr_auc"),
        F.when(both, F.sum(wins) / pairs).otherwise(nan()).alias("roc_auc"),
    )


def window_metrics(rows: DataFrame, keys: list[str], threshold: Column | float) -> DataFrame:
    """All window metrics per key of ``label, score, source`` rows at ``score >= threshold``."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    if "source" not in rows.columns:
        raise ValueError("frame has no 'source' column; every derived table carries one")
    per_source = rows.groupBy(*keys, "source").agg(
        F.max(thr).alias("threshold"), *confusion_columns(F.col("label"), F.col("score") >= thr)
    )
    counts = require_single_source(
        per_source.groupBy(*keys).agg(
            F.max("threshold").alias("threshold"),
            *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
            *single_source_columns(per_source),
        )
    )
    n_pos = F.col("tp") + F.col("fn")
    n = n_pos + F.col("fp") + F.col("tn")
    counts = counts.withColumns({"n": n, "n_pos": n_pos, "pos_rate": n_pos / n})
    return add_window_ratios(counts).join(ranking_metrics(rows, keys), keys)


def pooled_window_metrics(fold_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ratios re-derived from counts summed over folds."""
    sums = fold_rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    sums = sums.withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return add_window_ratios(sums, "_pooled")


def long_form(detail: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Metric rows ``(ids..., metric_name, metric_value)`` without NaN."""
    typed = detail.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return typed.unpivot(ids, metrics, "metric_name", "metric_value").where(
        F.col("metric_value").isNotNull() & ~F.isnan("metric_value")
    )
