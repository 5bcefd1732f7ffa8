"""Report tables over per-fold detail rows (one row per model and fold)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.functions.ratios import number_or_null, ratio_or_nan
from windrow.operators.metrics import add_window_ratios

COUNTS = ("tp", "fp", "fn", "tn")


def mean(c: str) -> Column:
    """Mean that skips NaN."""
    return F.avg(number_or_null(F.col(c)))


def fold_detail(window_rows: DataFrame, event_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Window and event metrics of the same folds side by side."""
    return window_rows.join(event_rows.drop("source"), keys)


def model_table(detail: DataFrame, keys: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Per model: fold means, pooled window ratios and pooled event rates."""
    sums = ["n_detected", "n_true_events", "false_alarms", "interictal_hours", "alarm_hours"]
    table = detail.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"),
        *[mean(c).alias(c) for c in ("pr_auc", "roc_auc", "precision", "recall", "f2", "accuracy")],
        *[F.sum(c).alias(c) for c in COUNTS],
        *[F.sum(c).alias(c) for c in sums],
        F.sum("evaluated_hours").alias("evaluated_hours"),
        F.median(number_or_null(F.col("median_latency_sec"))).alias("median_latency_sec"),
        F.min("threshold").alias("threshold_min"),
        F.max("threshold").alias("threshold_max"),
    )
    return add_window_ratios(table, "_pooled").withColumns(
        {
            "event_sensitivity": ratio_or_nan(F.col("n_detected"), F.col("n_true_events")),
            "fa_per_hour": ratio_or_nan(F.col("false_alarms"), F.col("interictal_hours")),
            "time_in_alarm_frac": ratio_or_nan(F.col("alarm_hours"), F.col("evaluated_hours")),
        }
    )


def headline(models: DataFrame, designated: str | None = None) -> DataFrame:
    """One row: the model reported first.

    The highest mean validation score, else the highest PR-AUC; a designated model overrides
    the choice and is flagged.
    """
    score, area = number_or_null(F.col("val_score")), number_or_null(F.col("pr_auc"))
    best = models.agg(
        F.max_by("model", score).alias("by_validation"), F.max_by("model", area).alias("by_area")
    )
    auto = F.coalesce("by_validation", "by_area")
    basis = F.when(F.col("by_validation").isNotNull(), "validation").otherwise("test PR-AUC")
    return best.select(
        F.coalesce(F.lit(designated), auto).alias("model"),
        F.when(F.lit(designated is not None), "designated").otherwise(basis).alias("basis"),
        auto.alias("auto_choice"),
        F.lit(designated is not None).alias("is_designated"),
    )


def per_subject(detail: DataFrame, model: str) -> DataFrame:
    """Subjects of one model, lowest PR-AUC first and undefined ones last."""
    columns = [
        "test_subject", "n", "n_pos", "pr_auc", "recall", "precision", "event_sensitivity", "fa_per_hour",
    ]
    return (
        detail.where(F.col("model") == model)
        .select(*columns)
        .orderBy(number_or_null(F.col("pr_auc")).asc_nulls_last())
    )


def confusion(detail: DataFrame, model: str) -> DataFrame:
    return detail.where(F.col("model") == model).groupBy("model").agg(
        *[F.sum(c).alias(c) for c in COUNTS]
    )


def protocol_contrast(grouped: DataFrame, random: DataFrame) -> DataFrame:
    """Grouped fold means against the random split, by model."""
    g = grouped.groupBy("model").agg(mean("pr_auc").alias("grouped_pr"), mean("recall").alias("grouped_recall"))
    r = random.select("model", F.col("pr_auc").alias("random_pr"), F.col("recall").alias("random_recall"))
    return g.join(r, "model").withColumn("delta_pr", F.col("random_pr") - F.col("grouped_pr"))


def view_comparison(models: DataFrame, contrasts: DataFrame) -> DataFrame:
    """Aggregated against per-channel view by model, with each view's random-split inflation.

    Both inputs carry ``view``; the majority model is left out.
    """
    a, p = "aggregated", "per_channel"
    rows = models.select("model", "view", "pr_auc").join(
        contrasts.select("model", "view", "delta_pr"), ["model", "view"], "left"
    )
    of = lambda v, c: F.max(F.when(F.col("view") == v, F.col(c)))
    wide = rows.where("model <> 'dummy'").groupBy("model").agg(
        of(a, "pr_auc").alias("agg_pr"), of(p, "pr_auc").alias("pch_pr"),
        of(a, "delta_pr").alias("agg_delta"), of(p, "delta_pr").alias("pch_delta"),
    )
    winner = F.when(F.col("pch_pr") > F.col("agg_pr"), p).otherwise(a)
    return wide.where("agg_pr IS NOT NULL AND pch_pr IS NOT NULL").withColumn("winner", winner)


PROTOCOLS = [
    "random_with_duplicates", "grouped_with_duplicates", "random_deduplicated", "grouped_deduplicated",
]


def leakage_decomposition(rows: DataFrame) -> DataFrame:
    """Four protocols side by side per model and what each change costs; all four needed."""
    wide = rows.groupBy("model").pivot("protocol", PROTOCOLS).agg(F.max("pr_auc")).dropna(subset=PROTOCOLS)
    rd, gd, rn, gn = (F.col(p) for p in PROTOCOLS)
    return wide.select(
        "model",
        rd.alias("pr_dup_random"), gd.alias("pr_dup_grouped"),
        rn.alias("pr_dedup_random"), gn.alias("pr_dedup_grouped"),
        (rd - rn).alias("dedup_effect_random"), (gd - gn).alias("dedup_effect_grouped"),
        (rd - gd).alias("grouping_effect_with_dups"), (rn - gn).alias("grouping_effect_deduped"),
    )


def operating_point(detail: DataFrame, model: str) -> DataFrame:
    """One row: median threshold, modal k, threshold range, pooled detections, missed subjects."""
    missed = (F.col("n_detected") == 0) & (F.col("n_true_events") > 0)
    return detail.where(F.col("model") == model).groupBy("model").agg(
        F.median("threshold").alias("threshold"),
        F.mode("k", deterministic=True).alias("k"),
        F.min("threshold").alias("threshold_min"),
        F.max("threshold").alias("threshold_max"),
        mean("pr_auc").alias("pr_auc_mean"),
        F.sum("n_detected").alias("seizures_detected"),
        F.sum("n_true_events").alias("seizures_total"),
        ratio_or_nan(F.sum("n_detected"), F.sum("n_true_events")).alias("event_sensitivity"),
        ratio_or_nan(F.sum("false_alarms"), F.sum("interictal_hours")).alias("fa_per_hour"),
        F.count_if(missed).alias("subjects_with_zero_detections"),
        F.count_distinct("test_subject").alias("n_subjects"),
    )


def sweep_summary(detail: DataFrame, by: str) -> DataFrame:
    """Per setting: NaN-skipping means of the window metrics and pooled event sensitivity."""
    return detail.groupBy(by).agg(
        F.count(F.lit(1)).alias("folds"),
        *[mean(c).alias(c) for c in ("pr_auc", "recall", "precision")],
        ratio_or_nan(F.sum("n_detected"), F.sum("n_true_events")).alias("event_sensitivity"),
    )


def best_setting(summary: DataFrame, by: str) -> DataFrame:
    return summary.agg(F.max_by(by, number_or_null(F.col("pr_auc"))).alias(by))


def markdown(table: DataFrame) -> DataFrame:
    """A report table as Markdown, a ``line`` per row after ``part`` 0 (names) and 1 (rule)."""
    cells = []
    for f in table.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), F.format_string("%.4f", c))
        cells.append(F.coalesce(c.cast("string"), F.lit("–")))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = [(0, "| " + " | ".join(table.columns) + " |"), (1, "|" + "---|" * len(table.columns))]
    names = table.sparkSession.createDataFrame(head, "part int, line string")
    return names.unionByName(table.select(F.lit(2).alias("part"), line.alias("line")))
