"""Queries: text and binary sources, channel labels, interval tables, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.fixed_values import CANONICAL_CHANNELS, ELECTRODES, NON_EEG_LABELS
from windrow.functions import text as tx
from windrow.operators import channels as ch
from windrow.operators import labels as lb
from windrow.operators import quality as ql
from windrow.operators import windows as wn
from windrow.plans import files as fl
from windrow.plans import fixtures as fx
from windrow.plans.catalog import query
from windrow.plans.fixtures import Tables, sql
from windrow.sources import annotations as an
from windrow.sources import headers as hd
from windrow.sources import textual as tt


@query(sql("SELECT rel FROM fx_file"))
def record_list(t: Tables):
    """A2: record list, trimmed, blanks dropped."""
    lines = fl.recordings(t).select(
        F.explode(F.array(F.concat(F.lit("  "), "rel", F.lit(" ")), F.lit(""), F.lit("   "))).alias("line")
    )
    return tt.record_list(lines)


@query(sql("""
    SELECT case_id, gender, CASE WHEN n % 5 = 0 THEN NULL ELSE n::DOUBLE + 0.5 END AS age
    FROM (SELECT DISTINCT case_id, user_id % 24 AS n, CASE WHEN user_id % 24 % 3 = 0 THEN NULL ELSE 'F' END AS gender
          FROM fx_record)"""))
def subject_info(t: Tables):
    """Subject info with blank lines, padded ages, bad ages."""
    n = F.col("user_id") % 24
    age = F.when(n % 5 == 0, "?").otherwise(F.concat(n.cast("string"), F.lit(".5 ")))
    line = F.concat_ws("\t", "case_id", F.when(n % 3 == 0, " ").otherwise("F"), F.concat(F.lit("  "), age))
    lines = fx.records(t).select(F.explode(F.array(line, F.lit(""), F.lit("Case\tGender\tAge"))).alias("line"))
    return tt.subject_info(lines.distinct(), prefix="c")


@query(sql("SELECT rel, sha256 FROM fx_sum"))
def checksum_list(t: Tables):
    """A10: checksum lines to path and digest."""
    return tt.checksum_list(fl.checksum_lines(t))


@query(sql("SELECT record_id, start_sec, end_sec FROM fx_interval"))
def interval_map(t: Tables):
    """JSON map of intervals back to rows."""
    spans = (
        fx.intervals(t)
        .groupBy("record_id")
        .agg(F.collect_list(F.array("start_sec", "end_sec")).alias("s"))
        .select(F.to_json(F.create_map("record_id", "s")).alias("value"))
    )
    return tt.interval_map(spans)


@query(sql("SELECT record_id, seizure_idx, start_sec, end_sec FROM fx_interval"))
def summary_intervals(t: Tables):
    """Intervals parsed back out of summary text."""
    return tt.summary_intervals(fl.summary_lines(t)).drop("file")


@query(sql("""
    SELECT r.record_id, count(i.record_id)::INTEGER AS n_declared,
      coalesce(max(CASE WHEN n > 1 AND seizure_idx = 2 AND i.user_id % 5 = 0 THEN
        'index mismatch: start labelled 2, end labelled 1; paired positionally as seizure 2' END), '') AS anomalies,
      NULL::VARCHAR AS error
    FROM fx_record r LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY record_id) AS n FROM fx_interval) i
      ON i.record_id = r.record_id GROUP BY 1"""))
def summary_blocks(t: Tables):
    """Declared counts, anomalies and errors of the summary blocks."""
    return tt.summary_blocks(fl.summary_lines(t)).select(
        "record_id", "n_declared", F.array_join("anomalies", "; ").alias("anomalies"), "error"
    )


OVERLAPPING = """
    SELECT DISTINCT a.record_id FROM fx_interval a JOIN fx_interval b
      ON a.record_id = b.record_id AND b.seizure_idx > a.seizure_idx AND b.start_sec <= a.end_sec"""


@query(sql("""
    SELECT record_id, seizure_idx, start_sec, end_sec FROM fx_interval
    WHERE record_id NOT IN (SELECT record_id FROM bad)""", bad=OVERLAPPING))
def annotation_intervals(t: Tables):
    """Intervals decoded from binary annotations."""
    return an.annotation_seconds(an.decode_annotations(fl.annotation_contents(t)))


@query(sql("SELECT 'root/' || record_id || '.edf.seizures' AS path, TRUE AS failed FROM bad", bad=OVERLAPPING))
def annotation_errors(t: Tables):
    """Malformed annotation files become rows with an error."""
    return an.decode_annotations(fl.annotation_contents(t)).where("error IS NOT NULL").select(
        "path", F.lit(True).alias("failed")
    )


@query(sql("""
    SELECT record_id, seizure_idx, round_even((start_sec * 256 + 128) / 256, 0)::BIGINT AS start_sec,
      round_even((end_sec * 256 + 64) / 256, 0)::BIGINT AS end_sec FROM fx_interval"""))
def sample_offsets_to_seconds(t: Tables):
    """Sample offsets to whole seconds, halves to even."""
    decoded = fx.intervals(t).select(
        F.col("record_id").alias("path"),
        "seizure_idx",
        (F.col("start_sec") * 256 + 128).alias("start_sample"),
        (F.col("end_sec") * 256 + 64).alias("end_sample"),
        F.lit(256.0).alias("hz"),
        F.lit(None).cast("string").alias("error"),
    )
    return an.annotation_seconds(decoded)


HEADER = """
    SELECT user_id, record_id, case_id, len(labels) AS ns, user_id % 5 + 720 AS n_records,
      (user_id % 2 + 1)::DOUBLE AS dur, user_id % 25 = 24 AS cut, user_id % 6 = 0 AS mixed,
      user_id % 4 = 0 AS longer, labels FROM fx_channels"""


@query(sql("""
    SELECT case_id || '/' || record_id || '.edf' AS rel, record_id, case_id, ns::INTEGER AS n_signals,
      n_records, dur AS record_duration_sec,
      CASE WHEN NOT cut THEN n_records * dur END AS duration_sec,
      CASE WHEN NOT cut THEN CASE WHEN mixed THEN -1.0 ELSE 256.0 END::DOUBLE END AS sample_rate,
      CASE WHEN NOT cut THEN mixed END AS mixed_sample_rates,
      (256 + 256 * ns)::INTEGER AS header_bytes,
      CASE WHEN NOT cut THEN 256 + 256 * ns + n_records * 2 * ((ns * 256 - CASE WHEN mixed THEN 128 ELSE 0 END) * dur)::BIGINT END AS expected_file_bytes,
      CASE WHEN NOT cut THEN NOT longer END AS size_matches_header,
      CASE WHEN cut THEN printf('header cut at byte %d of %d', 156 + 256 * ns, 256 + 256 * ns) END AS error
    FROM hx""", hx=HEADER))
def header_manifest(t: Tables):
    """Manifest rows from header bytes, size agreement, errors as rows."""
    return hd.manifest(fl.header_contents(t)).select(
        "rel", "record_id", "case_id", "n_signals",
        F.col("n_records").cast("long").alias("n_records"), "record_duration_sec",
        F.when(F.col("error").isNull(), F.col("duration_sec")).alias("duration_sec"),
        F.when(F.col("error").isNull(), F.col("sample_rate")).alias("sample_rate"),
        F.when(F.col("error").isNull(), F.col("mixed_sample_rates")).alias("mixed_sample_rates"),
        "header_bytes", "expected_file_bytes", "size_matches_header", "error",
    )


@query(sql("""
    SELECT case_id || '/' || record_id || '.edf' AS path, ns::INTEGER AS n_signals,
      CASE WHEN mixed THEN '128.0,256.0' ELSE '256.0' END AS rates, round(n_records * dur / 60, 6) AS minutes,
      (SELECT string_agg(trim(l), ',' ORDER BY i) FROM (SELECT unnest(labels) AS l, generate_subscripts(labels, 1) AS i)
        WHERE trim(l) NOT IN ('ECG', '-', 'VNS', 'CZ-CZ')) AS eeg_like
    FROM hx WHERE NOT cut""", hx=HEADER))
def rejected_file_description(t: Tables):
    """What a refused file holds."""
    out = hd.describe_rejected(hd.parse_headers(fl.header_contents(t)).where("error IS NULL"))
    return out.select(
        "path", "n_signals", F.array_join(F.transform("rates", lambda r: r.cast("string")), ",").alias("rates"),
        "minutes", F.array_join("eeg_like", ",").alias("eeg_like"),
    )


ELECTRODE_SQL = ", ".join(f"'{e}'" for e in ELECTRODES)
NON_EEG_SQL = ", ".join(f"'{e}'" for e in NON_EEG_LABELS)
LABEL_VIEWS = {
    "lb_one": r"""
        SELECT user_id, record_id, raw, pos, upper(regexp_replace(raw, '\s+', '', 'g')) AS norm
        FROM (SELECT user_id, record_id, unnest(labels) AS raw, generate_subscripts(labels, 1) AS pos FROM fx_channels)""",
    "lb_scalp": f"""
        SELECT *, regexp_full_match(norm, '[A-Z0-9]+-[A-Z0-9]+') AND split_part(norm, '-', 1) IN ({ELECTRODE_SQL})
          AND split_part(norm, '-', 2) IN ({ELECTRODE_SQL}) AND split_part(norm, '-', 1) <> split_part(norm, '-', 2) AS scalp
        FROM lb_one""",
    "lb_class": f"""
        SELECT *, CASE WHEN scalp AND row_number() OVER (PARTITION BY record_id, norm ORDER BY pos) = 1 THEN 'kept'
          WHEN scalp THEN 'duplicate' WHEN norm IN ({NON_EEG_SQL}) THEN 'non_eeg' ELSE 'unrecognised' END AS class
        FROM lb_scalp""",
}


@query(sql("SELECT record_id, pos::INTEGER - 1 AS pos, norm, scalp FROM lb_scalp", **LABEL_VIEWS))
def channel_labels(t: Tables):
    """Normalised labels and the allowlist test."""
    rows = fl.channel_lists(t).select("record_id", F.posexplode("labels").alias("pos", "raw"))
    norm = ch.normalise(F.col("raw"))
    return rows.select("record_id", "pos", norm.alias("norm"), ch.is_scalp(norm).alias("scalp"))


@query(sql("""
    SELECT record_id, class, string_agg(CASE WHEN class = 'kept' THEN norm ELSE raw END, '|' ORDER BY pos) AS labels
    FROM lb_class GROUP BY 1, 2""", **LABEL_VIEWS))
def channel_classes(t: Tables):
    """Labels kept, duplicate, non-EEG and unrecognised."""
    names = ["kept", "duplicate", "non_eeg", "unrecognised"]
    wide = ch.with_classes(fl.channel_lists(t)).select(
        "record_id", *[F.array_join(c, "|").alias(c) for c in names], *[F.size(c).alias(f"n_{c}") for c in names]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("labels"), F.col(f"n_{c}").alias("n")) for c in names])
    return wide.select("record_id", F.inline(rows)).where("n > 0").drop("n")


CANONICAL_SQL = "[" + ", ".join(f"'{c}'" for c in CANONICAL_CHANNELS) + "]"


@query(sql(f"""
    SELECT record_id, policy,
      array_to_string(CASE WHEN policy = 'fill_nan' THEN c WHEN len(miss) = 0 THEN c ELSE [] END, '|') AS selected,
      array_to_string(miss, '|') AS missing
    FROM (SELECT record_id, {CANONICAL_SQL} AS c, list_filter({CANONICAL_SQL}, lambda x: NOT list_contains(kept, x)) AS miss
          FROM (SELECT record_id, list(norm) AS kept FROM lb_class WHERE class = 'kept' GROUP BY 1)),
      (VALUES ('skip_file'), ('fill_nan')) v(policy)""", **LABEL_VIEWS))
def canonical_projection(t: Tables):
    """Canonical selection under both policies."""
    files = ch.with_classes(fl.channel_lists(t))
    rows = []
    for policy in ("skip_file", "fill_nan"):
        p = ch.project(F.col("kept"), CANONICAL_CHANNELS, policy)
        rows.append(
            F.struct(
                F.lit(policy).alias("policy"),
                F.array_join(p["selected"], "|").alias("selected"),
                F.array_join(p["missing"], "|").alias("missing"),
            )
        )
    return files.select("record_id", F.inline(F.array(*rows)))


@query(sql("""
    SELECT norm AS label, count(DISTINCT record_id) AS n_files,
      round(count(DISTINCT record_id) / (SELECT count(*) FROM fx_channels), 6) AS frac
    FROM lb_class WHERE class = 'kept' GROUP BY 1""", **LABEL_VIEWS))
def channel_presence(t: Tables):
    """Share of files that carry each label."""
    return ch.presence(ch.with_classes(fl.channel_lists(t)))


@query(sql("""
    SELECT norm AS label, row_number() OVER (ORDER BY count(DISTINCT record_id) DESC, norm)::INTEGER AS place
    FROM lb_class WHERE class = 'kept' GROUP BY 1
    HAVING count(DISTINCT record_id) / (SELECT count(*) FROM fx_channels) >= 0.95""", **LABEL_VIEWS))
def canonical_channels(t: Tables):
    """Labels present in at least 95% of files, in their order."""
    from pyspark.sql import Window

    chosen = ch.canonical_set(ch.with_classes(fl.channel_lists(t)))
    place = F.row_number().over(Window.orderBy(F.col("n_files").desc(), "label"))
    return chosen.select("label", place.alias("place"))


@query(sql(f"""
    SELECT record_id, CASE
        WHEN user_id % 7 = 0 AND user_id % 40 = 0 THEN 'missing_channels:FZ-CZ,CZ-PZ'
        WHEN user_id % 7 = 0 THEN 'missing_channels:FZ-CZ' WHEN user_id % 40 = 0 THEN 'missing_channels:CZ-PZ'
        WHEN user_id % 23 = 1 THEN 'no_usable_channels'
        WHEN user_id % 23 = 2 THEN 'unexpected_sample_rate:200.0'
        WHEN user_id % 23 = 3 THEN 'record_shorter_than_window' END AS reason
    FROM fx_record"""))
def refusals(t: Tables):
    """Why a recording is refused, null if it is not."""
    files = ch.with_classes(fl.channel_lists(t))
    u = F.col("user_id") % 23
    missing = ch.project(F.col("kept"), CANONICAL_CHANNELS)["missing"]
    usable = F.when(u == 1, 0).otherwise(F.size("kept"))
    rate = F.when(u == 2, 200.0).otherwise(256.0)
    n_windows = wn.window_count(F.when(u == 3, 100).otherwise(F.col("n_samples")), fx.SPEC)
    return files.select(
        "record_id", ql.refusal_reason(missing, usable, rate, 256.0, n_windows).alias("reason")
    )


@query(sql("""
    SELECT record_id || w AS rid, CASE WHEN w IN ('', 'a_1', '_07+') THEN NULL ELSE 'chb' || lpad((user_id % 24)::VARCHAR, 2, '0') END AS case_id
    FROM (SELECT *, unnest(['', 'a_1', '_07+']) AS w FROM fx_record)
    UNION ALL SELECT printf('chb%02d%s', user_id % 24, w), printf('chb%02d', user_id % 24)
    FROM (SELECT *, unnest(['_01', 'a_3', '_16+']) AS w FROM fx_record)"""))
def record_case(t: Tables):
    """B2, H1: case from a record id; null where the id does not fit."""
    tails = lambda *w: F.explode(F.array(*[F.lit(x) for x in w])).alias("w")
    r = fx.records(t)
    odd = r.select("record_id", tails("", "a_1", "_07+")).select(F.concat("record_id", "w").alias("rid"))
    good = r.select("user_id", tails("_01", "a_3", "_16+")).select(
        F.format_string("chb%02d%s", F.col("user_id") % 24, "w").alias("rid")
    )
    return odd.unionByName(good).select("rid", lb.case_of(F.col("rid")).alias("case_id"))


@query(sql("""
    SELECT record_id || '_' || printf('%06d', window_idx) AS window_uid, case_id, subject_id, 'abc' AS config_hash, 'events' AS source
    FROM fx_grid"""))
def stamped_windows(t: Tables):
    """Windows with case, subject, configuration hash and source."""
    registry = fx.records(t).select("case_id", "subject_id").distinct()
    records = fx.records(t).select("record_id", "case_id", "n_samples")
    return wn.cut_windows(wn.stamp_keys(records, registry, "abc", "events"), fx.SPEC).select(
        "window_uid", "case_id", "subject_id", "config_hash", "source"
    )


REGISTRY = """
    SELECT DISTINCT case_id, subject_id, CASE WHEN case_id <> 'c05' THEN CASE WHEN user_id % 24 % 3 = 0 THEN 'M' ELSE 'F' END END AS gender,
      CASE WHEN case_id <> 'c05' THEN (user_id % 24)::DOUBLE END AS age FROM fx_record"""


def _registry(t: Tables):
    cases = fx.records(t).select("case_id", "subject_id", (F.col("user_id") % 24).alias("n")).distinct()
    info = cases.where("case_id <> 'c05'").select(
        "case_id", F.when(F.col("n") % 3 == 0, "M").otherwise("F").alias("gender"), F.col("n").cast("double").alias("age")
    )
    return lb.with_demographics(cases.drop("n"), info)


@query(sql("SELECT * FROM rg", rg=REGISTRY))
def subject_registry(t: Tables):
    """Cases with subject and demographics, nulls where unknown."""
    return _registry(t)


@query(sql("""
    SELECT count(*) AS n_cases, count(DISTINCT subject_id) AS n_subjects,
      count(*) FILTER (case_id IN ('c00', 'c20')) AS n_shared,
      count(*) FILTER (case_id IN ('c00', 'c20') AND subject_id <> 's00') AS n_split_shared,
      count(*) FILTER (case_id = 'c05' AND gender IS NOT NULL) AS n_unknown_with_gender FROM rg""", rg=REGISTRY))
def registry_facts(t: Tables):
    """The facts the registry invariants are asserted on."""
    return lb.registry_facts(_registry(t), ["c00", "c20"], "s00", "c05")


@query(sql("""
    WITH a AS (SELECT record_id, count(*) AS n FROM fx_interval GROUP BY 1),
      b AS (SELECT record_id, count(*) AS n FROM fx_interval_b GROUP BY 1),
      c AS (SELECT coalesce(a.record_id, b.record_id) AS record_id, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb
            FROM a FULL JOIN b ON a.record_id = b.record_id),
      br AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY start_sec, end_sec) AS i FROM fx_interval_b)
    SELECT record_id, NULL::BIGINT AS seizure_idx,
      printf('%s: %d against %d intervals', record_id, na, nb) AS problem FROM c WHERE na <> nb
    UNION ALL
    SELECT x.record_id, x.seizure_idx, printf('%s: interval %d is %d..%d against %d..%d',
      x.record_id, x.seizure_idx, x.start_sec, x.end_sec, br.start_sec, br.end_sec)
    FROM fx_interval x JOIN c ON c.record_id = x.record_id AND na = nb
    JOIN br ON br.record_id = x.record_id AND br.i = x.seizure_idx
    WHERE abs(x.start_sec - br.start_sec) > 1 OR abs(x.end_sec - br.end_sec) > 1""".replace("WITH a AS", "SELECT * FROM (WITH a AS") + ")"))
def interval_disagreements(t: Tables):
    """Two interval sources compared per record and by position."""
    return lb.cross_validate(fx.intervals(t), fx.intervals_b(t))


@query(sql("""
    SELECT r.case_id, r.subject_id, i.record_id, i.seizure_idx, i.start_sec, i.end_sec,
      i.end_sec - i.start_sec AS duration_sec FROM fx_interval i JOIN fx_record r USING (record_id)"""))
def interval_table(t: Tables):
    """Numbered intervals with case, subject and positive duration."""
    raw = fx.raw_intervals(t).join(fx.records(t).select("record_id", "case_id"), "record_id")
    registry = fx.records(t).select("case_id", "subject_id").distinct()
    return lb.interval_table(raw.drop("user_id"), registry)


@query(sql("""
    SELECT (SELECT count(*) FROM fx_interval) AS n_from_summary, (SELECT count(DISTINCT record_id) FROM fx_interval) AS n_records_summary,
      (SELECT count(*) FROM fx_interval i JOIN fx_record r USING (record_id) WHERE case_id <> 'c23') AS n_without_case,
      (SELECT count(*) FROM fx_interval_b) AS n_from_annotations, (SELECT count(DISTINCT record_id) FROM fx_interval_b) AS n_records_annotations"""))
def interval_totals(t: Tables):
    """Totals per source, annotated records, total without one case."""
    a = fx.intervals(t).join(fx.records(t).select("record_id", "case_id"), "record_id")
    return lb.interval_totals(a, fx.intervals_b(t), "c23")


@query(sql("""
    SELECT r.case_id, count(*) AS n FROM fx_interval i JOIN fx_record r USING (record_id) GROUP BY 1"""))
def intervals_by_case(t: Tables):
    """Intervals per case."""
    return (
        fx.intervals(t).join(fx.records(t).select("record_id", "case_id"), "record_id")
        .groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    )


@query(sql("""
    SELECT record_id, case_id, CASE WHEN record_id IN (SELECT record_id FROM fx_interval) THEN 'annotated'
      WHEN regexp_matches(record_id, '^r0\\d+[02468]$') THEN 'annotated_seizure_free' ELSE 'unverifiable' END AS verdict
    FROM fx_record"""))
def truth_verdicts(t: Tables):
    """Annotated, annotated without events, or not verifiable."""
    return lb.truth_verdict(
        fx.records(t).select("record_id", "case_id"), fx.intervals(t), r"^r0\d+[02468]$"
    )


@query(sql("""
    SELECT rel, 'https://data.example/files/' || replace(rel, '+', '%2B') AS url,
      split_part(rel, '/', 1) AS folder, replace(split_part(rel, '/', 2), '.edf', '') AS stem FROM fx_file"""))
def file_paths(t: Tables):
    """H2, H4, H5: parent, stem and encoded URL of paths."""
    rel = F.col("rel")
    return fl.recordings(t).select(
        "rel",
        F.concat(F.lit(fl.BASE_URL), tx.quoted_path(rel)).alias("url"),
        tx.parent_folder(rel).alias("folder"),
        tx.file_stem(rel).alias("stem"),
    )
