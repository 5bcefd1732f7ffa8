"""Sinks and the reads that go with them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """Write partitions, replacing those present in ``df`` and leaving the others.

    Rows are gathered by partition first; adaptive execution splits a large one over several
    tasks and packs small ones together.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in by])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def read_parts(spark: SparkSession, path: str) -> DataFrame | None:
    """A partitioned table, or None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_features(spark: SparkSession, path: str, cases: list[str] | None = None) -> DataFrame:
    """A feature view; chosen cases prune its partitions."""
    df = spark.read.parquet(path)
    return df if cases is None else df.where(F.col("case_id").isin(cases))


def write_report(df: DataFrame, path: str) -> None:
    """A one-row or short table as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_manifest(manifest: DataFrame, presence: DataFrame, path: str) -> None:
    """Flat parquet without the label lists, the full rows as JSON, the presence table as JSON."""
    flat = [c for c in manifest.columns if not c.startswith(("labels_", "dropped_"))]
    write_table(manifest.select(*flat), f"{path}/file_manifest")
    manifest.write.mode("overwrite").json(f"{path}/file_manifest_full")
    write_report(presence, f"{path}/channel_presence")


def log_metrics(rows: DataFrame, path: str, run_id: str) -> None:
    """Long metric rows of a run, a partition per fold; writing a fold again replaces it."""
    out = rows.withColumn("run_id", F.lit(run_id)).where(
        F.col("metric_value").isNotNull() & ~F.isnan("metric_value")
    )
    overwrite_parts(out, path, ["run_id", "fold_idx"])


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


def write_work_list(work: DataFrame, path: str) -> None:
    """The download list as CSV files with header, a folder per batch."""
    (
        work.repartition("batch")
        .sortWithinPartitions("batch", "rel")
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )


def write_model(model: PipelineModel, meta: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    write_report(meta, f"{path}/meta")


def read_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.json(f"{path}/meta")
