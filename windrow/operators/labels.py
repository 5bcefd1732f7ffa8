"""Interval tables and the subject registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow import fixed_values as fv
from windrow.operators.quality import require
from windrow.operators.ranking import cell_rank


DAY_SEC = 86400


def enumerate_intervals(intervals: DataFrame, first: int = 1) -> DataFrame:
    """``seizure_idx`` 1, 2, … per record in order of start and end, ranked day by day."""
    day = F.floor(F.col("start_sec") / DAY_SEC)
    ranked = cell_rank(intervals, ["record_id"], day, ["start_sec", "end_sec"], "seizure_idx")
    return ranked.withColumn("seizure_idx", (F.col("seizure_idx") + (first - 1)).cast("long"))


def case_of(record: Column, pattern: str = fv.RECORD_ID_PATTERN, strict: bool = False) -> Column:
    """Case of a record id; null, or an error when strict, if the id does not fit."""
    case = F.nullif(F.regexp_extract(record, pattern, 1), F.lit(""))
    if not strict:
        return case
    bad = F.raise_error(F.concat(F.lit("unrecognised record id: "), record)).cast("string")
    return F.coalesce(case, bad)


def case_registry(spark: SparkSession) -> DataFrame:
    """Case -> subject for the numbered cases, two of which are one person."""
    number = F.format_string("%02d", "id")
    shared = F.create_map(
        *[F.lit(x) for pair in fv.SHARED_SUBJECT_CASES.items() for x in pair]
    )
    case = F.concat(F.lit("chb"), number)
    return spark.range(1, fv.N_CASES + 1).select(
        case.alias("case_id"),
        F.coalesce(F.try_element_at(shared, case), F.concat(F.lit("sub"), number)).alias(
            "subject_id"
        ),
    )


def with_demographics(registry: DataFrame, info: DataFrame) -> DataFrame:
    """Registry with gender and age; a case without them keeps nulls."""
    return registry.join(info.select("case_id", "gender", "age"), "case_id", "left")


def registry_facts(
    registry: DataFrame, shared_cases: list[str], shared_subject: str, unknown_case: str
) -> DataFrame:
    """One row: cases, subjects, shared cases with another subject, unknown case with gender."""
    in_shared = F.col("case_id").isin(shared_cases)
    return registry.agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_distinct("subject_id").alias("n_subjects"),
        F.count_if(in_shared).alias("n_shared"),
        F.count_if(in_shared & (F.col("subject_id") != shared_subject)).alias("n_split_shared"),
        F.count_if((F.col("case_id") == unknown_case) & F.col("gender").isNotNull()).alias(
            "n_unknown_with_gender"
        ),
    )


def require_registry(
    registry: DataFrame, n_cases: int = fv.N_CASES, n_subjects: int = fv.N_SUBJECTS
) -> DataFrame:
    """The facts of the numbered-case registry; fails when one is not as expected."""
    shared = ["chb01", *fv.SHARED_SUBJECT_CASES]
    facts = registry_facts(registry, shared, "sub01", fv.CASE_WITHOUT_DEMOGRAPHICS)
    facts = require(facts, F.col("n_cases") == n_cases, "unexpected number of cases")
    facts = require(facts, F.col("n_subjects") == n_subjects, "unexpected number of subjects")
    facts = require(
        facts,
        (F.col("n_split_shared") == 0) & (F.col("n_shared") == len(shared)),
        "cases of one person must share the subject",
    )
    return require(facts, F.col("n_unknown_with_gender") == 0, "unknown demographics must stay null")


def cross_validate(a: DataFrame, b: DataFrame, tolerance_sec: int = 1) -> DataFrame:
    """Disagreements of two interval sources, ``(record_id, seizure_idx, problem)``.

    Records whose counts differ give one row; otherwise intervals are compared by position.
    """
    counts = (
        a.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_a"))
        .join(b.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_b")), "record_id", "full")
        .fillna(0, ["n_a", "n_b"])
    )
    uneven = counts.where("n_a <> n_b").select(
        "record_id",
        F.lit(None).cast("long").alias("seizure_idx"),
        F.format_string(
            "%s: %d against %d intervals", "record_id", "n_a", "n_b"
        ).alias("problem"),
    )
    left = enumerate_intervals(a.select("record_id", "start_sec", "end_sec"))
    right = enumerate_intervals(b.select("record_id", "start_sec", "end_sec")).withColumnsRenamed(
        {"start_sec": "b_start", "end_sec": "b_end"}
    )
    far = (F.abs(F.col("start_sec") - F.col("b_start")) > tolerance_sec) | (
        F.abs(F.col("end_sec") - F.col("b_end")) > tolerance_sec
    )
    apart = (
        left.join(right, ["record_id", "seizure_idx"])
        .join(counts.where("n_a = n_b").select("record_id"), "record_id", "left_semi")
        .where(far)
        .select(
            "record_id",
            "seizure_idx",
            F.format_string(
                "%s: interval %d is %d..%d against %d..%d",
                "record_id", "seizure_idx", "start_sec", "end_sec", "b_start", "b_end",
            ).alias("problem"),
        )
    )
    return uneven.unionByName(apart)


def interval_table(intervals: DataFrame, registry: DataFrame) -> DataFrame:
    """Numbered intervals with case, subject and duration; fails on a non-positive duration."""
    cases = intervals if "case_id" in intervals.columns else intervals.withColumn(
        "case_id", case_of(F.col("record_id"), strict=True)
    )
    out = enumerate_intervals(cases).withColumn(
        "duration_sec", F.col("end_sec") - F.col("start_sec")
    )
    out = out.join(registry.select("case_id", "subject_id"), "case_id", "left")
    return require(out, F.col("duration_sec") > 0, "non-positive interval duration").select(
        "case_id", "subject_id", "record_id", "seizure_idx", "start_sec", "end_sec", "duration_sec"
    )


def interval_totals(
    summary: DataFrame, annotations: DataFrame, excluded_case: str
) -> DataFrame:
    """One row: counts per source, annotated records per source, total without one case."""
    s = summary.agg(
        F.count(F.lit(1)).alias("n_from_summary"),
        F.count_distinct("record_id").alias("n_records_summary"),
        F.count_if(F.col("case_id") != excluded_case).alias("n_without_case"),
    ).withColumn("k", F.lit(0))
    a = annotations.agg(
        F.count(F.lit(1)).alias("n_from_annotations"),
        F.count_distinct("record_id").alias("n_records_annotations"),
    ).withColumn("k", F.lit(0))
    return s.join(a, "k").drop("k")


def require_expected_totals(
    totals: DataFrame,
    n_intervals: int = fv.EXPECTED_INTERVALS,
    n_records: int = fv.EXPECTED_ANNOTATED_RECORDS,
    n_without_case: int = fv.EXPECTED_INTERVALS_FIRST_23,
) -> DataFrame:
    """Totals unchanged; fails unless both sources and the record count are as expected."""
    checks = [
        ("n_from_annotations", n_intervals), ("n_from_summary", n_intervals),
        ("n_records_annotations", n_records), ("n_without_case", n_without_case),
    ]
    for column, expected in checks:
        text = F.concat(
            F.lit(f"{column}: expected {expected}, got "), F.col(column).cast("string")
        )
        totals = require(totals, F.col(column) == expected, text)
    return totals


def truth_verdict(records: DataFrame, intervals: DataFrame, pattern: str) -> DataFrame:
    """``verdict``: annotated, annotated without events, or not verifiable."""
    known = intervals.select("record_id").distinct().withColumn("__has", F.lit(True))
    return records.join(known, "record_id", "left").select(
        *records.columns,
        F.when(F.col("__has"), "annotated")
        .when(F.col("record_id").rlike(pattern), "annotated_seizure_free")
        .otherwise("unverifiable")
        .alias("verdict"),
    )


def fixed_intervals(spark: SparkSession, table: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """A small literal interval table (resolved or disputed spans) as rows."""
    rows = [(r, int(a), int(b)) for r, spans in table.items() for a, b in spans]
    return spark.createDataFrame(rows, "record_id string, start_sec long, end_sec long")
