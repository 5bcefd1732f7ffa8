import collections
import zlib

import pytest

from windrow.llm import interleave as il


def check(rows, source_rows, shards=24):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in source_rows
    )
    counts = collections.Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[k] for k in range(shards)) <= 1
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    total = collections.Counter(r.source for r in rows)
    for (shard, source), n in collections.Counter((r.shard, r.source) for r in rows).items():
        assert abs(n - total[source] / shards) < 2, (shard, source)


@pytest.mark.parametrize("cell", [1, 7, 2048])
def test_messy_rows(messy, messy_rows, cell):
    check(il.interleaved(messy, il.Settings(cell=cell)).collect(), messy_rows)


def test_hot_source_over_many_cells(make_docs):
    rows = [(k, f"t{k}", "en", "hot" if k % 3 else f"c{k % 5}", None, 0, "", 0.0, 0) for k in range(3000)]
    check(il.interleaved(make_docs(rows), il.Settings(cell=50)).collect(), rows)


def test_same_rows_same_shards_under_any_partitioning(messy):
    a = il.interleaved(messy).collect()
    b = il.interleaved(messy.coalesce(1)).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    drop = lambda rows: sorted(((r.doc_id, r.size, r.shard, r.slot) for r in rows), key=key)
    assert drop(a) == drop(b)


def test_empty_table(no_docs):
    assert il.interleaved(no_docs).count() == 0


def test_only_dataframe_functions(messy):
    plan = il.interleaved(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
