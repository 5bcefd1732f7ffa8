"""Session helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "windrow") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.files.openCostInBytes", "131072")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A session in one machine's single process that names none gets a temporary one, which goes with
    the process; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="windrow-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def pinned(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cut lineage: write the rows once to a table in the shared folder and read it back.

    What follows reads columns of that table instead of repeating the work before it, also
    after executors are lost. Snappy, the usual ``compression``, takes buffers outside the heap as large as a
    page, and a page has a hundred rows at least: rows of megabytes want another one.
    """
    target = f"{shared_folder(df.sparkSession)}/windrow-{uuid.uuid4().hex}"
    df.write.parquet(target, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(target)
