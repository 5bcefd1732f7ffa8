"""Views over the given tables in the shapes the operators take, and the same views in SQL.

Every Spark view here has a twin in ``CTES``; the SQL checks are written over the twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.config import Windowing
from windrow.operators.windows import drop_guard, label_windows
from windrow.session import pinned

DAYS30 = 2592000.0
SPEC = Windowing(21600.0, 21600.0, 0.5, 10800.0, sample_rate=1)
OVERLAPPING_SPEC = Windowing(21600.0, 10800.0, 0.5, 10800.0, sample_rate=1)
THRESHOLD = 0.25
BIN = 86400.0
VALUES = 64  # of an embedding


SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
}


class Tables:
    """The given tables by name; schemas are declared, so opening one starts no job."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._open, self._kept = spark, folder, {}, {}

    def keep(self, name: str, make) -> DataFrame:
        """A frame of this query written once to the shared folder."""
        if name not in self._kept:
            self._kept[name] = pinned(make())
        return self._kept[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._open:
            reader = self.spark.read
            if name in SCHEMAS:
                reader = reader.schema(SCHEMAS[name])
            self._open[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._open[name]


def seconds(ts="ts"):
    """Seconds since 2024-01-01 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', {ts}) / 1e6")


def record_id(user="user_id"):
    return F.format_string("r%04d", user)


def records(t: Tables) -> DataFrame:
    case = F.pmod("user_id", F.lit(24)).cast("int")
    return (
        t.events.select("user_id")
        .distinct()
        .select(
            "user_id",
            record_id().alias("record_id"),
            F.format_string("c%02d", case).alias("case_id"),
            F.when(case == 20, "s00").otherwise(F.format_string("s%02d", case)).alias("subject_id"),
            F.lit(DAYS30).alias("duration_sec"),
            F.lit(int(DAYS30)).cast("long").alias("n_samples"),
        )
    )


def raw_intervals(t: Tables) -> DataFrame:
    start = F.floor(seconds())
    return t.events.where("event_type = 'error' and value >= 60").select(
        "user_id",
        record_id().alias("record_id"),
        start.alias("start_sec"),
        (start + 3600 + F.floor(F.col("value") * 120)).alias("end_sec"),
    )


def intervals(t: Tables) -> DataFrame:
    from windrow.operators.labels import enumerate_intervals

    return enumerate_intervals(raw_intervals(t))


def intervals_b(t: Tables) -> DataFrame:
    """A second source: shifted on even indexes, far off on some rows, without some rows."""
    key = F.pmod(F.col("user_id") * 7 + F.col("seizure_idx"), F.lit(70))
    far = F.pmod(F.col("user_id") * 7 + F.col("seizure_idx"), F.lit(50)) == 1
    shift = F.when(far, 400).when(F.pmod("seizure_idx", F.lit(2)) == 0, 1).otherwise(0)
    return (
        intervals(t)
        .where(key != 3)
        .select(
            "record_id",
            (F.col("start_sec") + shift).alias("start_sec"),
            (F.col("end_sec") + shift).alias("end_sec"),
        )
    )


def windows(t: Tables, spec: Windowing = SPEC) -> DataFrame:
    return label_windows(records(t), intervals(t), spec).withColumn("source", F.lit("events"))


def peak_values(t: Tables, spec: Windowing) -> DataFrame:
    """Highest non-error value per (record, window); an event falls in each window covering it."""
    at = seconds()
    last = F.floor(at / spec.stride_sec)
    first = F.greatest(F.lit(0), last - spec.reach)
    idx = F.explode(F.sequence(first.cast("int"), last.cast("int")))
    return (
        t.events.where("event_type <> 'error'")
        .select(record_id().alias("record_id"), "value", idx.alias("window_idx"))
        .groupBy("record_id", "window_idx")
        .agg(F.max("value").alias("peak"))
    )


def scored(t: Tables, spec: Windowing = SPEC) -> DataFrame:
    """Labelled windows with a score in [0, 1] and the prediction at the usual threshold."""
    score = F.least(F.lit(1.0), F.coalesce("peak", F.lit(0.0)) / 150.0)
    return (
        windows(t, spec)
        .join(peak_values(t, spec), ["record_id", "window_idx"], "left")
        .withColumn("score", score)
        .withColumn("pred", F.col("score") >= THRESHOLD)
        .drop("peak")
    )


def evaluated(t: Tables, spec: Windowing = SPEC) -> DataFrame:
    return drop_guard(scored(t, spec))


def stored_evaluated(t: Tables, spec: Windowing = SPEC) -> DataFrame:
    """The same rows written once, for queries that read them several times."""
    return t.keep(f"evaluated-{spec.stride_sec}", lambda: evaluated(t, spec))


def durations(t: Tables) -> DataFrame:
    """Known durations, for even users only."""
    return records(t).where("user_id % 2 = 0").select("record_id", "duration_sec")


def scored_documents(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id",
        F.col("source").alias("group_id"),
        F.lit("documents").alias("source"),
        F.col("quality").alias("label"),
        (F.col("n_chars") / 20000.0).alias("score"),
    )


def signals(t: Tables) -> DataFrame:
    """Four one-second channels at 64 Hz per window."""
    names = F.array(*[F.lit(c) for c in SIGNAL_CHANNELS])
    return t.embeddings.select(
        "vec_id",
        F.col("label").cast("string").alias("record_id"),
        F.floor(F.col("vec_id") / 4).cast("int").alias("window_idx"),
        F.element_at(names, (F.pmod("vec_id", F.lit(4)) + 1).cast("int")).alias("channel"),
        F.lit(64.0).alias("fs"),
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"),
    )


SIGNAL_CHANNELS = ["FP1-F7", "F7-T7", "FZ-CZ", "CZ-PZ"]
SIGNAL_BANDS = {
    "delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0),
    "gamma": (30.0, 32.0),
}


def hashed_documents(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_index"), F.md5("text").alias("row_hash"), "quality"
    )


def label_sequence(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("row_index"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def learning_rows(t: Tables) -> DataFrame:
    """Rows for models: every value of the vector, a binary label and a group."""
    return t.embeddings.select(
        "vec_id",
        F.format_string("w%06d", "vec_id").alias("window_uid"),
        F.format_string("g%02d", F.pmod("vec_id", F.lit(12)).cast("int")).alias("subject_id"),
        (F.col("label") == 5).cast("int").alias("label"),
        F.lit("embeddings").alias("source"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(VALUES)],
    )


CTES = {
    "fx_record": """
        SELECT DISTINCT user_id, printf('r%04d', user_id) AS record_id,
          printf('c%02d', user_id % 24) AS case_id,
          CASE WHEN user_id % 24 = 20 THEN 's00' ELSE printf('s%02d', user_id % 24) END AS subject_id,
          2592000.0::DOUBLE AS duration_sec
        FROM events""",
    "fx_time": """
        SELECT *, printf('r%04d', user_id) AS record_id,
          date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6 AS t FROM events""",
    "fx_interval": """
        SELECT user_id, record_id, start_sec, end_sec,
          row_number() OVER (PARTITION BY record_id ORDER BY start_sec, end_sec) AS seizure_idx
        FROM (SELECT user_id, record_id, floor(t)::BIGINT AS start_sec,
                floor(t)::BIGINT + 3600 + floor(value * 120)::BIGINT AS end_sec
              FROM fx_time WHERE event_type = 'error' AND value >= 60)""",
    "fx_interval_b": """
        SELECT record_id, start_sec + s AS start_sec, end_sec + s AS end_sec FROM (
          SELECT *, CASE WHEN (user_id * 7 + seizure_idx) % 50 = 1 THEN 400
                         WHEN seizure_idx % 2 = 0 THEN 1 ELSE 0 END AS s
          FROM fx_interval WHERE (user_id * 7 + seizure_idx) % 70 <> 3)""",
    "fx_grid": """
        SELECT r.*, i::INTEGER AS window_idx, i * 21600::DOUBLE AS t_start_sec,
          (i + 1) * 21600::DOUBLE AS t_end_sec
        FROM fx_record r, range(120) g(i)""",
    "fx_grid_overlap": """
        SELECT r.*, i::INTEGER AS window_idx, i * 10800::DOUBLE AS t_start_sec,
          i * 10800::DOUBLE + 21600 AS t_end_sec
        FROM fx_record r, range(239) g(i)""",
}


def _label_cte(grid: str) -> str:
    return f"""
        SELECT w.user_id, w.record_id, w.case_id, w.subject_id, w.window_idx, w.t_start_sec,
          w.t_end_sec, coalesce(h.ov, 0) / 21600.0 AS overlap_frac,
          CASE WHEN coalesce(h.ov, 0) / 21600.0 >= 0.5 THEN 1
               WHEN coalesce(h.ov, 0) > 0 OR coalesce(h.near, FALSE) THEN -1 ELSE 0 END AS label
        FROM {grid} w LEFT JOIN (
          SELECT w.record_id, w.window_idx,
            sum(greatest(0, least(w.t_end_sec, i.end_sec) - greatest(w.t_start_sec, i.start_sec))) AS ov,
            bool_or((w.t_end_sec > i.start_sec - 10800 AND w.t_start_sec < i.start_sec + 10800)
                 OR (w.t_end_sec > i.end_sec - 10800 AND w.t_start_sec < i.end_sec + 10800)) AS near
          FROM {grid} w JOIN fx_interval i ON i.record_id = w.record_id
          GROUP BY 1, 2) h ON h.record_id = w.record_id AND h.window_idx = w.window_idx"""


CTES["fx_window"] = _label_cte("fx_grid")
CTES["fx_window_overlap"] = _label_cte("fx_grid_overlap")
CTES["fx_score"] = """
    SELECT w.*, least(1.0, coalesce(p.peak, 0) / 150.0) AS score,
      least(1.0, coalesce(p.peak, 0) / 150.0) >= 0.25 AS pred
    FROM fx_window w LEFT JOIN (
      SELECT record_id, floor(t / 21600)::INTEGER AS window_idx, max(value) AS peak
      FROM fx_time WHERE event_type <> 'error' GROUP BY 1, 2) p
    USING (record_id, window_idx)"""
CTES["fx_score_overlap"] = """
    SELECT w.*, least(1.0, coalesce(p.peak, 0) / 150.0) AS score,
      least(1.0, coalesce(p.peak, 0) / 150.0) >= 0.25 AS pred
    FROM fx_window_overlap w LEFT JOIN (
      SELECT record_id, window_idx, max(value) AS peak FROM (
        SELECT record_id, value, unnest([floor(t / 10800)::INTEGER - 1, floor(t / 10800)::INTEGER]) AS window_idx
        FROM fx_time WHERE event_type <> 'error') GROUP BY 1, 2) p
    USING (record_id, window_idx)"""
CTES["fx_eval"] = "SELECT * FROM fx_score WHERE label <> -1"
CTES["fx_eval_overlap"] = "SELECT * FROM fx_score_overlap WHERE label <> -1"
CTES["fx_duration"] = "SELECT record_id, duration_sec FROM fx_record WHERE user_id % 2 = 0"
CTES["fx_run1"] = """
    SELECT record_id, any_value(subject_id) AS subject_id, min(window_idx) AS first_idx,
      max(window_idx) AS last_idx, min(t_start_sec) AS start_sec, max(t_end_sec) AS end_sec,
      count(*) AS n_windows
    FROM (SELECT *, window_idx - row_number() OVER (PARTITION BY record_id ORDER BY window_idx) AS g
          FROM fx_eval WHERE pred) GROUP BY record_id, g"""
CTES["fx_run_overlap1"] = CTES["fx_run1"].replace("fx_eval", "fx_eval_overlap")
CTES["fx_scored_doc"] = """
    SELECT d.doc_id, d.source AS group_id, l.quality AS label, d.n_chars / 20000.0 AS score
    FROM documents d JOIN labels l USING (doc_id)"""
CTES["fx_signal"] = """
    SELECT vec_id, label::VARCHAR AS record_id, (vec_id // 4)::INTEGER AS window_idx,
      ['FP1-F7','F7-T7','FZ-CZ','CZ-PZ'][vec_id % 4 + 1] AS channel,
      embedding::DOUBLE[] AS samples FROM embeddings"""
CTES["fx_sample"] = """
    SELECT vec_id, record_id, window_idx, channel, unnest(samples) AS x,
      generate_subscripts(samples, 1) - 1 AS n FROM fx_signal"""
CTES["fx_dup"] = """
    SELECT d.doc_id AS row_index, md5(d.text) AS row_hash, l.quality
    FROM documents d LEFT JOIN labels l USING (doc_id)"""
CTES["fx_label_seq"] = """
    SELECT event_id AS row_index, (event_type = 'error')::INTEGER AS label FROM events"""
CTES["fx_ml"] = """
    SELECT vec_id, printf('w%06d', vec_id) AS window_uid, printf('g%02d', vec_id % 12) AS subject_id,
      (label = 5)::INTEGER AS label, """ + ", ".join(
    f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(VALUES)
) + " FROM embeddings"

ORDER = list(CTES)


def sql(body: str, **more: str) -> str:
    """``body`` with the views it names, directly or through each other, put before it."""
    import re

    views = {**CTES, **more}
    needed: set[str] = set()

    def visit(text: str):
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(views[name])

    visit(body)
    order = [n for n in list(CTES) + [m for m in more if m not in CTES] if n in needed]
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in order) + "\n" + body
