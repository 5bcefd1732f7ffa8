"""Incremental ingest: new recordings to feature tables and ledger rows, batch by batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from windrow.config import Settings
from windrow.functions.text import file_stem
from windrow.operators import extract as ex
from windrow.operators import ledger as lg
from windrow.operators.features import channel_stats
from windrow.operators.labels import case_of
from windrow.operators.windows import label_counts
from windrow.session import pinned
from windrow.sources.recordings import BlockPlan, decode_contents
from windrow.sources.sinks import overwrite_parts, read_parts

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


@dataclass(frozen=True)
class Ingest:
    """Where a run writes and what it joins with. Truth and checksums are tables."""

    out: str
    settings: Settings
    intervals: DataFrame
    registry: DataFrame
    checksums: DataFrame
    disputed: DataFrame | None = None
    halo_sec: float = 40.0
    block_sec: float = 600.0

    @property
    def plan(self) -> BlockPlan:
        s = self.settings
        return BlockPlan(
            tuple(s.signal.canonical_channels), s.data.on_missing_channel, self.block_sec, self.halo_sec
        )

    @property
    def spark(self) -> SparkSession:
        return self.intervals.sparkSession

    def ledger(self) -> DataFrame | None:
        return read_parts(self.spark, f"{self.out}/ledger")

    def process(self, files: DataFrame, batch: int) -> None:
        """Verify, extract and record the files (``path, content``) of one batch.

        Output is partitioned by batch and replaced as a whole, so a repeated batch leaves the
        same tables. Problems with a file end up in its ledger row and do not stop the batch.
        Features are written before the ledger rows that point to them.
        """
        settings = self.settings
        todo = files.withColumn("record_id", file_stem(F.col("path")))
        known = self.ledger()
        if known is not None:
            todo = lg.remaining(todo, lg.latest(known.where(F.col("batch") != batch)))
        verdicts = pinned(self._verified(todo))
        good = todo.join(
            verdicts.where("state <> 'failed'").select("path"), "path", "left_semi"
        ).select("path", "content")
        states = pinned(ex.record_states(ex.content_headers(good, self.plan), settings))
        vectors = pinned(ex.features_of_contents(good, self.plan, settings))
        states = ex.with_failures(states, vectors)
        counts = None
        for view in settings.features.views:
            table = ex.labelled_features(
                states, vectors, settings, self.intervals, self.registry, view, self.disputed
            )
            overwrite_parts(table.withColumn("batch", F.lit(batch)), f"{self.out}/{view}", ["case_id", "batch"])
            counts = label_counts(table.select("record_id", "label")) if counts is None else counts
        rows = self._ledger_rows(verdicts, states, counts, self._stats(good), batch)
        overwrite_parts(rows, f"{self.out}/ledger", ["batch"])

    def _verified(self, todo: DataFrame) -> DataFrame:
        rel = F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2))
        digests = todo.select(
            "path", "record_id", rel.alias("rel"), F.sha2("content", 256).alias("digest")
        )
        return lg.checksum_verdict(digests, self.checksums)

    def _stats(self, good: DataFrame) -> DataFrame:
        blocks = decode_contents(good, self.plan).where("error IS NULL")
        core = F.transform(
            "samples", lambda x: F.slice(x, F.col("halo_left") + 1, F.col("block_len").cast("int"))
        )
        rows = blocks.select(
            "record_id", F.inline(F.arrays_zip("channels", core.alias("core")))
        ).toDF("record_id", "channel", "samples")
        facts = F.struct("mean", "std", "p05", "p50", "p95")
        return (
            channel_stats(rows, ["record_id", "channel"])
            .groupBy("record_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("channel", facts))).alias("channel_stats"))
        )

    def _ledger_rows(self, verdicts, states, counts, stats, batch: int) -> DataFrame:
        found = states.drop("path").withColumnsRenamed({"state": "found", "reason": "why"})
        return (
            verdicts.join(found, "record_id", "left")
            .join(counts, "record_id", "left")
            .join(stats, "record_id", "left")
            .select(
                "record_id",
                case_of(F.col("record_id")).alias("case_id"),
                "rel",
                F.when(F.col("state") == "failed", "failed").otherwise(F.col("found")).alias("state"),
                F.coalesce("reason", "why").alias("reason"),
                "error",
                "checksum_verified",
                "n_samples",
                "duration_sec",
                "channel_labels",
                "channel_stats",
                F.when(F.col("found") == "extracted", F.lit(self.out)).alias("features_path"),
                "n_windows",
                "label_counts",
                F.lit(batch).alias("batch"),
                F.lit(batch).alias("updated"),
            )
        )


def recording_stream(spark: SparkSession, root: str, per_batch: int = 64) -> DataFrame:
    """New recordings under a folder as a stream of whole files."""
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.edf")
        .option("maxFilesPerTrigger", per_batch)
        .load(root)
    )


def ingest_stream(files: DataFrame, job: Ingest, checkpoint: str) -> StreamingQuery:
    """Ingest what is there and stop; the checkpoint remembers which files were seen."""
    return (
        files.writeStream.foreachBatch(lambda df, i: job.process(df.select("path", "content"), i))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_present(files: DataFrame, job: Ingest, batch: int = 0) -> DataFrame:
    """The same over files already there, as one batch; returns the tally by state."""
    job.process(files.select("path", "content"), batch)
    return lg.state_counts(lg.latest(job.ledger()))
