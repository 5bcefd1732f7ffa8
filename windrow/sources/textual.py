"""Text sources: record lists, subject info, checksum lists, interval maps, event summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow import fixed_values as fv
from windrow.functions.text import number_or_null, strip_edf
from windrow.operators.quality import require


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of small text files, lines numbered as written."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(
        F.col("_metadata.file_path").alias("file"),
        F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"),
    )


def record_list(lines: DataFrame) -> DataFrame:
    """Non-blank lines, trimmed."""
    return lines.select(F.trim("line").alias("rel")).where(F.length("rel") > 0)


def subject_info(lines: DataFrame, prefix: str = "chb") -> DataFrame:
    """Case, gender and age from tab-separated lines; other lines are skipped."""
    parts = F.transform(F.split("line", "\t"), lambda p: F.trim(p))
    return (
        lines.select(parts.alias("p"))
        .where((F.size("p") >= 3) & F.col("p")[0].startswith(prefix))
        .select(
            F.col("p")[0].alias("case_id"),
            F.nullif(F.col("p")[1], F.lit("")).alias("gender"),
            number_or_null(F.col("p")[2]).alias("age"),
        )
    )


def checksum_list(lines: DataFrame) -> DataFrame:
    """Path and lower-case digest of lines that start with a 64-character token."""
    tokens = F.split(F.trim("line"), r"\s+")
    return (
        lines.select(tokens.alias("p"))
        .where((F.size("p") >= 2) & (F.length(F.col("p")[0]) == 64))
        .select(
            F.ltrim(F.element_at("p", -1), F.lit("*./")).alias("rel"),
            F.lower(F.col("p")[0]).alias("sha256"),
        )
    )


def interval_map(documents: DataFrame, column: str = "value") -> DataFrame:
    """Intervals of a JSON object record -> [[start, end], ...]."""
    parsed = F.from_json(column, "map<string, array<array<long>>>")
    return (
        documents.select(F.explode(parsed).alias("record_id", "spans"))
        .select("record_id", F.explode("spans").alias("s"))
        .select("record_id", F.col("s")[0].alias("start_sec"), F.col("s")[1].alias("end_sec"))
    )


def _summary_lines(lines: DataFrame) -> DataFrame:
    """Lines of a summary with their file block and what they say."""
    text = F.trim("line")
    got = lambda pattern, i: F.nullif(F.regexp_extract("text", pattern, i), F.lit(""))
    marked = (
        lines.select("file", "line_no", text.alias("text"))
        .where(F.length("text") > 0)
        .withColumn("name", strip_edf(got(fv.SUMMARY_FILE_NAME, 1)))
    )
    # a summary describes one case, so a file's lines fit one task
    along = Window.partitionBy("file").orderBy("line_no")
    kind = F.lower(got(fv.SUMMARY_TIME, 2))
    odd = (
        kind.isNull()
        & F.col("text").rlike(fv.SUMMARY_EVENT_LINE)
        & ~F.col("text").rlike(fv.SUMMARY_IGNORED)
    )
    return (
        marked.withColumns(
            {
                "block": F.count("name").over(along),
                "record_id": F.last("name", ignorenulls=True).over(along),
            }
        )
        .where((F.col("block") > 0) & F.col("name").isNull())
        .select(
            "file",
            "block",
            "record_id",
            "line_no",
            got(fv.SUMMARY_COUNT, 1).cast("int").alias("declared"),
            kind.alias("kind"),
            got(fv.SUMMARY_TIME, 1).cast("int").alias("printed_idx"),
            got(fv.SUMMARY_TIME, 3).cast("double").alias("sec"),
            F.when(odd, F.col("text")).alias("odd_line"),
        )
    )


def _summary_pairs(marked: DataFrame) -> DataFrame:
    """Starts and ends of a block paired by position."""
    place = F.row_number().over(
        Window.partitionBy("file", "block", "record_id", "kind").orderBy("line_no")
    )
    start, end = F.col("kind") == "start", F.col("kind") == "end"
    return (
        marked.where(F.col("kind").isNotNull())
        .withColumn("seizure_idx", place)
        .groupBy("file", "block", "record_id", "seizure_idx")
        .agg(
            F.max(F.when(start, F.col("sec"))).alias("start"),
            F.max(F.when(end, F.col("sec"))).alias("end"),
            F.max(F.when(start, F.col("printed_idx"))).alias("start_idx"),
            F.max(F.when(end, F.col("printed_idx"))).alias("end_idx"),
        )
    )


def summary_blocks(lines: DataFrame) -> DataFrame:
    """One row per file block: declared and found counts, anomalies, and the error if any."""
    marked = _summary_lines(lines)
    on = ["file", "block", "record_id"]
    facts = marked.groupBy(*on).agg(
        F.coalesce(
            F.max_by("declared", F.when(F.col("declared").isNotNull(), F.col("line_no"))), F.lit(0)
        ).alias("n_declared"),
        F.count_if(F.col("kind") == "start").alias("n_starts"),
        F.count_if(F.col("kind") == "end").alias("n_ends"),
        F.min("odd_line").alias("odd_line"),
    )
    note = F.format_string(
        "index mismatch: start labelled %d, end labelled %d; paired positionally as seizure %d",
        "start_idx", "end_idx", "seizure_idx",
    )
    backwards = F.format_string(
        "seizure %d has end %s <= start %s",
        "seizure_idx", F.col("end").cast("string"), F.col("start").cast("string"),
    )
    pairs = _summary_pairs(marked).groupBy(*on).agg(
        F.array_sort(
            F.collect_list(F.when(F.col("start_idx") != F.col("end_idx"), note))
        ).alias("anomalies"),
        F.min(F.when(F.col("end") <= F.col("start"), backwards)).alias("backwards"),
    )
    error = (
        F.when(F.col("odd_line").isNotNull(), F.concat(F.lit("unrecognised seizure line: "), "odd_line"))
        .when(
            F.col("n_starts") != F.col("n_ends"),
            F.format_string("%d start times vs %d end times", "n_starts", "n_ends"),
        )
        .when(
            F.col("n_declared") != F.col("n_starts"),
            F.format_string(
                "declares %d seizures but %d start times parsed", "n_declared", "n_starts"
            ),
        )
        .otherwise(F.col("backwards"))
    )
    return facts.join(pairs, on, "left").select(
        "file",
        "record_id",
        "n_declared",
        "n_starts",
        F.coalesce("anomalies", F.array().cast("array<string>")).alias("anomalies"),
        error.alias("error"),
    )


def summary_intervals(lines: DataFrame) -> DataFrame:
    """Intervals of the file blocks, whole seconds; position, not the printed index, counts."""
    return _summary_pairs(_summary_lines(lines)).select(
        "file",
        "record_id",
        F.col("seizure_idx").cast("long").alias("seizure_idx"),
        F.col("start").cast("long").alias("start_sec"),
        F.col("end").cast("long").alias("end_sec"),
    )


def require_clean_summary(blocks: DataFrame) -> DataFrame:
    """Blocks unchanged; fails on the first block with an error."""
    text = F.concat("record_id", F.lit(": "), F.coalesce("error", F.lit("")))
    return require(blocks, F.col("error").isNull(), text)
