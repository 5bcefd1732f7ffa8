"""Queries: incremental ingest over recordings derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from windrow.operators import ledger as lg
from windrow.operators.labels import case_registry
from windrow.plans import files as fl
from windrow.plans.catalog import query
from windrow.plans.fixtures import Tables, sql
from windrow.plans.signal_features import SMALL
from windrow.session import shared_folder
from windrow.streaming.ingest import Ingest, ingest_present, ingest_stream

FILES = """
    SELECT n, printf('chb01_%05d', n) AS record_id, n % 10 = 1 AS bad, n % 10 <> 0 AS listed, n % 7 = 3 AS broken
    FROM (SELECT DISTINCT vec_id // 4 AS n FROM fx_signal)"""
RESULT = """
    SELECT record_id, CASE WHEN bad OR broken THEN 'failed' ELSE 'extracted' END AS state,
      CASE WHEN bad THEN 'checksum_mismatch' END AS reason, listed AND NOT bad AS checksum_verified,
      CASE WHEN NOT bad AND NOT broken THEN 3 END AS n_windows,
      CASE WHEN NOT bad AND NOT broken THEN CASE WHEN record_id LIKE '%3' THEN 3 ELSE 0 END END AS n_ictal
    FROM ff"""


def _number():
    return F.regexp_extract("path", r"_(\d+)\.edf$", 1).cast("int")


def _files(t: Tables):
    """Recording files; some cut short."""
    whole = fl.recording_contents(t)
    return whole.withColumn(
        "content",
        F.when(_number() % 7 == 3, F.substring(F.col("content"), F.lit(1), F.length("content") - 10)).otherwise(
            F.col("content")
        ),
    )


def _job(t: Tables, out: str) -> Ingest:
    n = _number()
    sums = _files(t).where(n % 10 != 0).select(
        F.concat(F.lit("c00/"), F.element_at(F.split("path", "/"), -1)).alias("rel"),
        F.when(n % 10 == 1, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"),
    )
    iv = _files(t).select(F.regexp_extract("path", r"([^/]+)\.edf$", 1).alias("record_id")).where(
        F.col("record_id").endswith("3")
    ).select("record_id", F.lit(0.25).alias("start_sec"), F.lit(0.75).alias("end_sec"))
    return Ingest(out, SMALL, iv, case_registry(t.spark), sums, halo_sec=1.0)


def _outcome(job: Ingest):
    rows = lg.latest(job.ledger())
    ictal = F.when(F.col("n_windows").isNotNull(), lg.label_total(1))
    return rows.select(
        "record_id", "state", "reason", "checksum_verified", "n_windows", ictal.cast("int").alias("n_ictal")
    )


@query(sql(RESULT, ff=FILES))
def incremental_ingest(t: Tables):
    """A stream of recordings to feature tables and ledger, failures as rows."""
    root = f"{shared_folder(t.spark)}/windrow-{uuid.uuid4().hex}"
    _files(t).write.parquet(f"{root}/files")
    job = _job(t, f"{root}/out")
    stream = t.spark.readStream.schema("path string, content binary").option("maxFilesPerTrigger", 4).parquet(
        f"{root}/files"
    )
    ingest_stream(stream, job, f"{root}/checkpoint").awaitTermination()
    return _outcome(job)


@query(sql("SELECT state, count(*) AS n FROM rs GROUP BY 1", ff=FILES, rs=RESULT))
def present_files_tally(t: Tables):
    """K3: files already there as one batch, tallied by state."""
    job = _job(t, f"{shared_folder(t.spark)}/windrow-{uuid.uuid4().hex}")
    return ingest_present(_files(t), job)


@query(sql("""
    SELECT record_id, i::INTEGER AS window_idx, CASE WHEN record_id LIKE '%3' THEN 1 ELSE 0 END AS label, 'sub01' AS subject_id
    FROM rs, range(3) r(i) WHERE state = 'extracted'""", ff=FILES, rs=RESULT))
def stored_feature_table(t: Tables):
    """The feature table written by an ingest, read back by case."""
    from windrow.sources.sinks import read_features

    job = _job(t, f"{shared_folder(t.spark)}/windrow-{uuid.uuid4().hex}")
    job.process(_files(t), 0)
    table = read_features(t.spark, f"{job.out}/aggregated", ["chb01"])
    return table.select("record_id", "window_idx", "label", "subject_id")
