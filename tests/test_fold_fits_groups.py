"""Trees over few blocks are grown where all their bins lie, those over many blocks from sums: the same scores."""

import pyarrow as pa
from pyspark.sql import functions as F

from test_fold_fits import COLUMNS, FITS, rows, scores  # noqa: F401
from windrow.operators import fold_fits as ff


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    found = run()
    spark.sparkContext.setJobGroup("", "")
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_trees_over_few_blocks_need_no_job_per_level(spark, rows, monkeypatch):  # noqa: F811
    trees = [f for f in FITS if f.name in ("hgb", "rf")]
    few, jobs = jobs_of(spark, "few", lambda: scores(rows, trees, size=70))
    monkeypatch.setattr(ff, "GATHERED", 0)
    many, more = jobs_of(spark, "many", lambda: scores(rows, trees, size=70))
    assert few == many and jobs < 30 < more


def test_a_fold_is_scored_from_the_rows_it_holds_out(spark, rows, monkeypatch):  # noqa: F811
    """What meets the models is the held-out rows alone, not a copy of every block for each model."""
    seen = []
    real = ff.held_slices

    def kept(blocks, facts):
        found = real(blocks, facts)
        seen.append(found.select(F.sum(F.length("labels")).alias("n"), F.count(F.lit(1)).alias("slices")).head())
        return found

    monkeypatch.setattr(ff, "held_slices", kept)
    scores(rows, FITS, size=70)
    assert seen[0]["n"] == 240 and seen[0]["slices"] <= 16


def test_pieces_of_work_read_the_blocks_without_a_shuffle(spark, rows):  # noqa: F811
    """Eight pieces on all rows: what is shuffled once for each of them would be eight copies of the table."""
    facts, _, blocks, _ = ff.laid_out(rows, COLUMNS, F.array(F.lit(True)), F.array(F.lit(1).cast("tinyint")), 1, FITS, 7, "window_uid", 70)
    seen = ff.pieces_of(blocks, facts, 8, lambda piece, b, numbers, sizes: pa.table({"piece": [piece], "rows": [len(b.labels)], "blocks": [len(numbers)]}), "piece long, rows long, blocks long")
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    got = sorted(map(tuple, seen.collect()))
    assert [g[0] for g in got] == list(range(8)) and {g[1] for g in got} == {240} and len({g[2] for g in got}) == 1


def test_more_pieces_than_tasks(rows, monkeypatch):  # noqa: F811
    trees = [f for f in FITS if f.name in ("hgb", "rf")]
    each = scores(rows, trees, size=70)
    monkeypatch.setattr(ff, "TASKS", 3)
    assert scores(rows, trees, size=70) == each


def test_values_are_stored_only_where_fits_ask_for_them(rows):  # noqa: F811
    every = F.array(F.lit(True)), F.array(F.lit(1).cast("tinyint"))
    for name, valued in (("rf", False), ("logreg", True)):
        blocks = ff.laid_out(rows, COLUMNS, *every, 1, [ff.Fit(0, name)], 7, "window_uid", 70)[2]
        assert {r["values"] is not None for r in blocks.collect()} == {valued}


def test_blocks_are_stored_without_page_sized_buffers(rows):  # noqa: F811
    """Snappy's buffers outside the heap are as large as a page, which rows of megabytes make as large as a file."""
    every = F.array(F.lit(True)), F.array(F.lit(1).cast("tinyint"))
    for name in ("rf", "logreg"):
        for table in ff.laid_out(rows, COLUMNS, *every, 1, [ff.Fit(0, name)], 7, "window_uid", 70)[1:3]:
            assert all(f.endswith(".zstd.parquet") for f in table.inputFiles())


def test_a_million_rows_need_no_job_per_level():
    assert 1_000_000 <= ff.GATHERED * ff.BLOCK
