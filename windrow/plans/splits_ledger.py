"""Queries: splits, sampling, repeats, ledger and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.operators import ledger as lg
from windrow.operators import quality as ql
from windrow.operators import splits as sp
from windrow.plans import files as fl
from windrow.plans import fixtures as fx
from windrow.plans.catalog import query
from windrow.plans.fixtures import Tables, sql
from windrow.sources import textual as tt

SEED = 42


def ring_views(frame: str, group: str, n_val: int) -> dict[str, str]:
    return {
        "ring": f"""
            SELECT g, (row_number() OVER (ORDER BY md5('{SEED}:' || g), g) - 1)::INTEGER AS fold_idx, count(*) OVER () AS n,
              row_number() OVER (ORDER BY md5('{SEED}:' || g), g) - 1 AS place
            FROM (SELECT DISTINCT {group}::VARCHAR AS g FROM {frame})""",
        "held": f"""
            SELECT a.fold_idx, b.g, CASE WHEN (b.place - a.place + a.n) % a.n = 0 THEN 'test' ELSE 'val' END AS role
            FROM ring a JOIN ring b ON (b.place - a.place + a.n) % a.n <= greatest(0, least({n_val}, a.n - 2))""",
    }


@query(sql("""
    SELECT fold_idx, g AS subject_id, role FROM held""",
    **ring_views("fx_record", "subject_id", 4)))
def fold_assignments(t: Tables):
    """Who is held out in every fold, and as what; all others train in it."""
    return sp.held_out(fx.records(t), "subject_id", 4, SEED).select("fold_idx", "subject_id", "role")


@query(sql("""
    SELECT fold_idx, count(*) FILTER (role = 'test') AS n_test, count(*) FILTER (role = 'val') AS n_val,
      string_agg(g, ',' ORDER BY g) FILTER (role = 'val') AS val_subjects,
      any_value(g) FILTER (role = 'test') AS test_subject,
      sum(w) FILTER (role = 'test')::BIGINT AS test_rows, sum(w) FILTER (role = 'val')::BIGINT AS val_rows
    FROM held JOIN (SELECT subject_id, count(*) AS w FROM fx_eval GROUP BY 1) c ON c.subject_id = held.g GROUP BY 1""",
    **ring_views("fx_eval", "subject_id", 4)))
def fold_composition(t: Tables):
    """Who is held out in each fold, with row counts by role."""
    frame = fx.stored_evaluated(t)
    folds = sp.held_out(frame, "subject_id", 4, SEED)
    counts = frame.groupBy("subject_id").agg(F.count(F.lit(1)).alias("w"))
    test, val = F.col("role") == "test", F.col("role") == "val"
    return folds.join(counts, "subject_id").groupBy("fold_idx").agg(
        F.count_if(test).alias("n_test"),
        F.count_if(val).alias("n_val"),
        F.array_join(F.array_sort(F.collect_list(F.when(val, F.col("subject_id")))), ",").alias("val_subjects"),
        F.max(F.when(test, F.col("subject_id"))).alias("test_subject"),
        F.sum(F.when(test, F.col("w"))).alias("test_rows"),
        F.sum(F.when(val, F.col("w"))).alias("val_rows"),
    )


@query(sql("""
    SELECT fold_idx, role, count(*) AS n, count(*) FILTER (label = 1) AS n_pos
    FROM fx_eval w JOIN held h ON h.g = w.subject_id GROUP BY 1, 2""", **ring_views("fx_eval", "subject_id", 4)))
def evaluation_rows_by_fold(t: Tables):
    """Held-out rows under each fold by role."""
    frame = fx.stored_evaluated(t)
    rows = sp.evaluation_rows(frame, sp.held_out(frame, "subject_id", 4, SEED), "subject_id")
    return rows.groupBy("fold_idx", "role").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_pos")
    )


UID = "record_id || '_' || printf('%06d', window_idx)"


@query(sql(f"""
    SELECT {UID} AS window_uid, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || {UID}), {UID})
      <= floor(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS role FROM fx_eval"""))
def random_window_split(t: Tables):
    """Seeded 80/20 split over windows, exactly int(0.8 n) for training."""
    split = sp.random_split(fx.evaluated(t), "window_uid", SEED, [("train", 0.8), ("test", 0.2)])
    return split.select("window_uid", "role")


@query(sql(f"""
    SELECT role, count(*) AS n FROM (
      SELECT CASE WHEN r <= floor(0.2::DOUBLE * n) THEN 'test' WHEN r <= floor(0.2::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'val' ELSE 'train' END AS role
      FROM (SELECT row_number() OVER (ORDER BY md5('{SEED}:' || vec_id), vec_id) AS r, count(*) OVER () AS n FROM fx_ml))
    GROUP BY 1"""))
def random_three_way_split(t: Tables):
    """Seeded 20/10/70 test, validation and training rows."""
    shares = [("test", 0.2), ("val", 0.1), ("train", 0.7)]
    split = sp.random_split(fx.learning_rows(t), "vec_id", SEED, shares)
    return split.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


PSEUDO = {
    "ps_run": """
        SELECT min(row_index) AS s, count(*) AS n, any_value(label) AS label, (SELECT max(row_index) FROM fx_label_seq) AS last
        FROM (SELECT *, row_index - row_number() OVER (PARTITION BY label ORDER BY row_index) AS g FROM fx_label_seq)
        GROUP BY label, g""",
    "ps_cut": "SELECT s + n // 2 AS c FROM ps_run WHERE label = 0 AND s > 0 AND s + n - 1 < last",
    "ps_group": """
        SELECT l.row_index, l.label, (count(c) OVER (ORDER BY l.row_index))::INTEGER AS pseudo_record
        FROM fx_label_seq l LEFT JOIN ps_cut ON c = l.row_index""",
}


@query(sql("SELECT * FROM ps_group", **PSEUDO))
def pseudo_records(t: Tables):
    """E5: groups cut at the middle of each interior run of label 0."""
    return sp.pseudo_records(fx.label_sequence(t))


@query(sql("SELECT fold_idx, g AS pseudo_record, role FROM held",
           **PSEUDO, **ring_views("ps_group", "pseudo_record", 4)))
def pseudo_group_folds(t: Tables):
    """Grouped folds over pseudo-records, test and validation groups of each."""
    return sp.held_out(sp.pseudo_records(fx.label_sequence(t)), "pseudo_record", 4, SEED)


@query(sql("""
    SELECT row_index, row_number() OVER (PARTITION BY row_hash ORDER BY row_index) > 1 AS is_repeat FROM fx_dup"""))
def repeated_rows(t: Tables):
    """Rows whose content occurred earlier."""
    return sp.mark_repeats(fx.hashed_documents(t)).select("row_index", "is_repeat")


@query(sql("""
    SELECT row_index FROM (SELECT *, row_number() OVER (PARTITION BY row_hash ORDER BY row_index) AS k FROM fx_dup) WHERE k = 1"""))
def deduplicated_rows(t: Tables):
    """First occurrences only."""
    return sp.mark_repeats(fx.hashed_documents(t)).where(~F.col("is_repeat")).select("row_index")


@query(sql("""
    SELECT (count(*) - count(DISTINCT row_hash))::BIGINT AS n_duplicates, count(DISTINCT row_hash) AS n_distinct FROM fx_dup"""))
def duplicate_row_count(t: Tables):
    """Repeats in the feature columns, on which the assertion is made."""
    return ql.duplicate_rows(fx.hashed_documents(t), ["row_hash"])


@query(sql(f"""
    SELECT w.subject_id, {UID} AS window_uid, label FROM fx_eval w WHERE label = 1
    UNION ALL
    SELECT subject_id, uid, 0 FROM (
      SELECT w.subject_id, {UID} AS uid, row_number() OVER (PARTITION BY w.subject_id
          ORDER BY md5('{SEED}:' || {UID}), {UID}) AS r, n_pos
      FROM fx_eval w JOIN (SELECT subject_id, count(*) FILTER (label = 1) AS n_pos FROM fx_eval GROUP BY 1) p
        ON p.subject_id = w.subject_id WHERE label = 0)
    WHERE r <= 10 * greatest(1, n_pos)"""))
def downsampled_negatives(t: Tables):
    """All positives and at most ten negatives per positive, seeded."""
    rows = sp.downsample_negatives(fx.stored_evaluated(t), 10, SEED, "window_uid", ["subject_id"])
    return rows.select("subject_id", "window_uid", "label")


SPREAD = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY rel) - 1 AS i,
        greatest(1, count(*) OVER (PARTITION BY subject_id) // 3) AS step FROM {work})
    WHERE i % step = 0 AND i // step < 3"""


@query(sql("SELECT subject_id, rel FROM sx", sx=SPREAD.replace("{work}", "fx_file")))
def even_spread_sample(t: Tables):
    """An even spread of three files per subject."""
    return sp.spread_sample(fl.recordings(t), "subject_id", "rel", 3).select("subject_id", "rel")


@query(sql("""
    SELECT case_id, record_id FROM fx_record WHERE case_id IN ('c03', 'c07', 'c11')
    ORDER BY record_id LIMIT 10"""))
def limited_cases(t: Tables):
    """The first ten records of chosen cases."""
    return (
        fx.records(t).where(F.col("case_id").isin("c03", "c07", "c11"))
        .select("case_id", "record_id").orderBy("record_id").limit(10)
    )


@query(sql("""
    SELECT record_id FROM fx_record WHERE record_id IN (SELECT record_id FROM fx_interval)"""))
def records_with_events(t: Tables):
    """Records that have an annotated interval."""
    return fx.records(t).select("record_id").join(
        fx.intervals(t).select("record_id"), "record_id", "left_semi"
    )


@query(sql("SELECT record_id, rel, state FROM fx_ledger"))
def latest_ledger(t: Tables):
    """K2: one row per record, the last written."""
    return lg.latest(fl.ledger(t)).select("record_id", "rel", "state")


@query(sql("SELECT state, count(*) AS n FROM fx_ledger GROUP BY 1"))
def ledger_states(t: Tables):
    """Records per ledger state."""
    return lg.state_counts(lg.latest(fl.ledger(t)))


@query(sql("SELECT record_id, state FROM fx_ledger WHERE state IN ('extracted', 'raw_deleted', 'skipped')"))
def finished_records(t: Tables):
    """Records the ledger counts as finished."""
    return lg.done(lg.latest(fl.ledger(t))).select("record_id", "state")


REMAINING = "SELECT * FROM fx_file WHERE user_id % 6 NOT IN (2, 3, 4)"


@query(sql("SELECT rel, size_bytes FROM rx", rx=REMAINING))
def remaining_work(t: Tables):
    """Files whose record is not finished."""
    return lg.remaining(fl.recordings(t), lg.latest(fl.ledger(t))).select("rel", "size_bytes")


@query(sql("SELECT subject_id, rel FROM sx", rx=REMAINING, sx=SPREAD.replace("{work}", "rx")))
def remaining_work_sample(t: Tables):
    """An even spread of the remaining files per subject."""
    work = lg.remaining(fl.recordings(t), lg.latest(fl.ledger(t)))
    return sp.spread_sample(work, "subject_id", "rel", 3).select("subject_id", "rel")


@query(sql("""
    SELECT record_id, case_id, array_to_string(list_filter([
        CASE WHEN user_id % 10 = 0 THEN 'checksum_verified' END, CASE WHEN user_id % 15 = 0 THEN 'n_samples' END,
        CASE WHEN user_id % 14 = 0 THEN 'channel_labels' END, CASE WHEN user_id % 9 = 0 THEN 'channel_stats' END,
        CASE WHEN user_id % 16 = 0 THEN 'features_path' END], lambda x: x IS NOT NULL), ',') AS missing_fields
    FROM fx_ledger WHERE case_id NOT IN ('c01', 'c12', 'c17')
      AND (user_id % 10 = 0 OR user_id % 15 = 0 OR user_id % 14 = 0 OR user_id % 9 = 0 OR user_id % 16 = 0)"""))
def delete_audit(t: Tables):
    """Records whose raw data may not go yet, with the unrecorded fields."""
    out = lg.delete_audit(lg.latest(fl.ledger(t)), keep=fl.KEEP)
    return out.withColumn("missing_fields", F.array_join("missing_fields", ","))


HOURS = """
    SELECT l.subject_id, sum(c.n) * 10 / 3600 AS interictal_hours
    FROM fx_ledger l JOIN fx_label_count c ON c.record_id = l.record_id AND c.label = 0
    WHERE state IN ('extracted', 'raw_deleted') GROUP BY 1"""


@query(sql("SELECT subject_id, round(interictal_hours, 6) AS interictal_hours FROM hx", hx=HOURS))
def interictal_hours(t: Tables):
    """Hours of quiet windows held per subject."""
    registry = fx.records(t).select("case_id", "subject_id").distinct()
    return lg.interictal_hours(lg.latest(fl.ledger(t)), registry)


@query(sql("""
    SELECT count(*) FILTER (done) AS records_extracted, count(*) AS records_available,
      count(*) FILTER (state = 'skipped') AS records_skipped, count(*) FILTER (state = 'failed') AS records_failed,
      round(sum(duration_sec) FILTER (done) / 3600, 6) AS hours, sum(p) FILTER (done)::BIGINT AS n_ictal,
      sum(q) FILTER (done)::BIGINT AS n_interictal, sum(g) FILTER (done)::BIGINT AS n_guard,
      sum(p + q + g) FILTER (done)::BIGINT AS windows,
      round(sum(p) FILTER (done) / sum(p + q) FILTER (done), 6) AS positive_rate
    FROM (SELECT l.*, state IN ('extracted', 'raw_deleted') AS done, p, q, g FROM fx_ledger l JOIN (
      SELECT record_id, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q, count(*) FILTER (label = -1) AS g
      FROM fx_window GROUP BY 1) c USING (record_id))"""))
def provenance_totals(t: Tables):
    """Records by state, windows by label, hours and positive rate."""
    return lg.provenance(lg.latest(fl.ledger(t)))


@query(sql("""
    SELECT count(*) AS total, count(*) FILTER (state = 'skipped') AS in_skipped_records,
      count(*) FILTER (state <> 'skipped') AS reachable FROM fx_interval JOIN fx_ledger USING (record_id)"""))
def interval_accounting(t: Tables):
    """Annotated intervals lost in skipped records."""
    return lg.interval_accounting(fx.intervals(t), lg.latest(fl.ledger(t)))


TIERS = """
    SELECT s.*, tier FROM sx s JOIN (
      SELECT subject_id, (least((row_number() OVER (ORDER BY coalesce(h, 0), subject_id) - 1)
          // greatest(1, count(*) OVER () // 4), 3) + 1)::INTEGER AS tier
      FROM (SELECT DISTINCT rx.subject_id, hx.interictal_hours AS h FROM rx LEFT JOIN hx ON hx.subject_id = rx.subject_id)) USING (subject_id)"""


@query(sql("""
    SELECT tier, count(DISTINCT subject_id) AS n_subjects, count(*) AS n_records, sum(size_bytes)::BIGINT AS total_bytes
    FROM tx GROUP BY 1""", rx=REMAINING, hx=HOURS,
    sx=SPREAD.replace("{work}", "rx").replace("// 3", "// 6").replace("< 3", "< 6"), tx=TIERS))
def priority_tiers(t: Tables):
    """remaining files in tiers, subjects with least coverage first."""
    state = lg.latest(fl.ledger(t))
    registry = fx.records(t).select("case_id", "subject_id").distinct()
    work = lg.remaining(fl.recordings(t), state)
    return lg.tier_totals(lg.priority_tiers(work, lg.interictal_hours(state, registry)))


@query(sql("""
    SELECT (floor((sum(size_bytes) OVER (ORDER BY case_id, f.rel) - size_bytes) / 40000000000) + 1)::INTEGER AS batch,
      f.rel, size_bytes, 'https://data.example/files/' || replace(f.rel, '+', '%2B') AS url, coalesce(sha256, '') AS sha256
    FROM fx_file f LEFT JOIN fx_sum s ON s.rel = f.rel"""))
def work_list(t: Tables):
    """Download work list in batches of a size budget."""
    sums = tt.checksum_list(fl.checksum_lines(t))
    return lg.work_list(fl.recordings(t), sums, 40_000_000_000, fl.BASE_URL)


@query(sql("""
    SELECT f.rel, coalesce(s.sha256 = sha256(f.rel), FALSE) AS checksum_verified,
      CASE WHEN s.sha256 <> sha256(f.rel) THEN 'failed' ELSE 'downloaded' END AS state,
      CASE WHEN s.sha256 <> sha256(f.rel) THEN 'checksum_mismatch' END AS reason
    FROM fx_file f LEFT JOIN fx_sum s ON s.rel = f.rel"""))
def checksum_verdicts(t: Tables):
    """C11, H8: file digests against the list."""
    files = fl.recordings(t).select("rel", F.sha2(F.col("rel").cast("binary"), 256).alias("digest"))
    return lg.checksum_verdict(files, tt.checksum_list(fl.checksum_lines(t))).drop("digest")
