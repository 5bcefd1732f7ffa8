"""The ingest ledger: latest state per record, resume, audits, work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow import fixed_values as fv


def latest(ledger: DataFrame, order: str = "updated") -> DataFrame:
    """One row per record: the one written last."""
    row = F.struct(*[F.col(c) for c in ledger.columns])
    return ledger.groupBy("record_id").agg(F.max_by(row, F.col(order)).alias("r")).select("r.*")


def state_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def done(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("state").isin(fv.DONE_STATES))


def remaining(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose record is not finished in the ledger."""
    return files.join(done(ledger).select("record_id"), "record_id", "left_anti")


def delete_audit(
    ledger: DataFrame, required: list[str] = fv.REQUIRED_BEFORE_DELETE, keep=fv.KEEP_CASES
) -> DataFrame:
    """Records whose raw data may not go yet, with the fields that are still unrecorded.

    Null, empty lists and empty maps count as unrecorded; cases to keep are not audited.
    """
    kinds = dict(ledger.dtypes)

    def lacks(c):
        empty = F.col(c).isNull()
        if kinds[c].startswith(("array", "map")):
            empty = empty | (F.size(c) == 0)
        return F.when(empty, F.lit(c))

    missing = F.array_compact(F.array(*[lacks(c) for c in required]))
    return (
        ledger.where(~F.col("case_id").isin(keep))
        .withColumn("missing_fields", missing)
        .where(F.size("missing_fields") > 0)
        .select("record_id", "case_id", "missing_fields")
    )


def label_total(label: int):
    return F.coalesce(F.try_element_at("label_counts", F.lit(label)), F.lit(0))


def interictal_hours(ledger: DataFrame, registry: DataFrame, window_sec: float = 10) -> DataFrame:
    """Hours of label-0 windows already held per subject, from extracted records."""
    return (
        ledger.where(F.col("state").isin(fv.EXTRACTED_STATES))
        .join(registry.select("case_id", "subject_id"), "case_id")
        .groupBy("subject_id")
        .agg((F.sum(label_total(0)) * window_sec / 3600).alias("interictal_hours"))
    )


def provenance(ledger: DataFrame) -> DataFrame:
    """One row: records by state, windows by label, hours and positive rate."""
    extracted = F.col("state").isin(fv.EXTRACTED_STATES)
    when_done = lambda c: F.sum(F.when(extracted, c).otherwise(0))
    out = ledger.agg(
        F.count_if(extracted).alias("records_extracted"),
        F.count(F.lit(1)).alias("records_available"),
        F.count_if(F.col("state") == "skipped").alias("records_skipped"),
        F.count_if(F.col("state") == "failed").alias("records_failed"),
        (when_done(F.coalesce("duration_sec", F.lit(0.0))) / 3600).alias("hours"),
        when_done(label_total(1)).alias("n_ictal"),
        when_done(label_total(0)).alias("n_interictal"),
        when_done(label_total(-1)).alias("n_guard"),
    )
    used = F.col("n_ictal") + F.col("n_interictal")
    return out.withColumns(
        {
            "windows": used + F.col("n_guard"),
            "positive_rate": F.when(used > 0, F.col("n_ictal") / used),
        }
    )


def interval_accounting(intervals: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: annotated intervals, those lost in skipped records, those reachable."""
    skipped = ledger.where("state = 'skipped'").select("record_id", F.lit(1).alias("s"))
    return (
        intervals.join(skipped, "record_id", "left")
        .agg(F.count(F.lit(1)).alias("total"), F.count("s").alias("in_skipped_records"))
        .withColumn("reachable", F.col("total") - F.col("in_skipped_records"))
    )


def priority_tiers(
    work: DataFrame, coverage: DataFrame, n_tiers: int = 4, per_subject: int = 6
) -> DataFrame:
    """Remaining files of each subject with the subject's tier, least covered first.

    Tiers hold n_subjects div n_tiers subjects, the last one the rest; each subject gives an
    even spread of at most ``per_subject`` files. The ranking is over subjects only.
    """
    from windrow.operators.splits import spread_sample

    subjects = (
        work.select("subject_id")
        .distinct()
        .join(coverage, "subject_id", "left")
        .fillna(0.0, ["interictal_hours"])
    )
    everyone = Window.partitionBy()
    place = F.row_number().over(Window.orderBy("interictal_hours", "subject_id")) - 1
    size = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(everyone) / n_tiers))
    tiers = subjects.withColumn(
        "tier", (F.least(F.floor(place / size), F.lit(n_tiers - 1)) + 1).cast("int")
    )
    return spread_sample(work, "subject_id", "rel", per_subject).join(tiers, "subject_id")


def tier_totals(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("tier").agg(
        F.count_distinct("subject_id").alias("n_subjects"),
        F.count(F.lit(1)).alias("n_records"),
        F.sum("size_bytes").alias("total_bytes"),
    )


def work_list(files: DataFrame, checksums: DataFrame, budget: int, base_url: str) -> DataFrame:
    """Files with batch number, URL and expected digest.

    The batch is the running size before the file over the budget. Sizes run case by case:
    totals per case give offsets, so files are only ordered within their case.
    """
    from windrow.functions.text import quoted_path

    before = Window.orderBy("case_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.groupBy("case_id").agg(F.sum("size_bytes").alias("s")).select(
        "case_id", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__offset")
    )
    along = Window.partitionBy("case_id").orderBy("rel")
    ahead = F.col("__offset") + F.sum("size_bytes").over(along) - F.col("size_bytes")
    return (
        files.join(offsets, "case_id")
        .withColumn("batch", (F.floor(ahead / budget) + 1).cast("int"))
        .join(checksums.select("rel", "sha256"), "rel", "left")
        .select(
            "batch",
            "rel",
            "size_bytes",
            F.concat(F.lit(base_url), quoted_path(F.col("rel"))).alias("url"),
            F.coalesce("sha256", F.lit("")).alias("sha256"),
        )
    )


def checksum_verdict(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """``checksum_verified`` and ``state`` of files (``rel``, ``digest``) against the list.

    A file not listed is unverified but goes on; a mismatch fails.
    """
    joined = files.join(
        checksums.select("rel", F.col("sha256").alias("__want")), "rel", "left"
    )
    same = F.col("__want").isNotNull() & F.coalesce(F.col("digest") == F.col("__want"), F.lit(False))
    bad = F.col("__want").isNotNull() & ~same
    return joined.select(
        *files.columns,
        same.alias("checksum_verified"),
        F.when(bad, "failed").otherwise("downloaded").alias("state"),
        F.when(bad, "checksum_mismatch").alias("reason"),
    )
