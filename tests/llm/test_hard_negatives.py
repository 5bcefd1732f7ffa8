import math
import random

import duckdb
import numpy as np
import pytest

from windrow.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, key int, pack int, score double, members string"


def brute(rows, anchors, s):
    kept = []
    for r in rows:
        vec_id, v, label = r[:3]
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out, done = [], set()
    for a, va, la in kept:
        if a not in anchors or a in done:
            continue
        done.add(a)
        scored = [(sum(x * y for x, y in zip(va, v)), i, label) for i, v, label in kept if i != a]
        positives = sorted(((-p, i) for p, i, label in scored if label == la))[: s.positives]
        for minus, i in positives:
            p = -minus
            fit = sorted((-n, j) for n, j, label in scored if label != la and s.lowest * p <= 100 * n <= s.highest * p)
            out += [(a, i, k, j, p, -n) for k, (n, j) in enumerate(fit[: s.negatives], 1)]
    return sorted(out)


def random_rows(n, dims, seed, spread=0.3):
    r = random.Random(seed)
    centre = [[r.gauss(0, 0.3) for _ in range(dims)] for _ in range(4)]
    return [
        (k, [c + r.gauss(0, spread) for c in centre[r.randrange(4)]], r.randrange(10) if k % 9 else 3, 1, 2, 0.5, "x") for k in range(n)
    ]


def anchor_rows(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "vec_id long")


@pytest.mark.parametrize("dims,settings", [(64, hn.Settings()), (13, hn.Settings(pack=37, set=3, tile=2)), (1, hn.Settings(pack=50))])
def test_equals_brute_force(spark, dims, settings):
    rows = random_rows(260, dims, dims)
    rows += [(900 + k, rows[k][1], rows[k][2], 1, 2, 0.5, "x") for k in range(40)]  # ties under other ids
    anchors = [r[0] for r in rows if r[0] % 10 == 0]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, hn.mined(frame, anchor_rows(spark, anchors), settings).collect()))
    want = brute(rows, set(anchors), settings)
    assert got == want and len(want) > (0 if dims == 1 else 50)


def test_messy_rows(spark):
    rows = random_rows(60, 8, 5)
    odd = [None, [], [1.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8, [0.5] * 20, [-1.0] * 3, [300.0] * 8]
    rows += [(100 + k, v, 3, 1, 2, 0.5, "x") for k, v in enumerate(odd)]
    rows += [(None, [1.0] * 8, 3, 1, 2, 0.5, "x"), (200, [1.0] * 8, None, 1, 2, 0.5, "x"), (-14, [0.25] * 8, -4, 1, 2, 0.5, "x")]
    anchors = [0, 3, 9, 18, 36, 101, 102, 106, 107, 108, 200, -14, 5000]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(map(tuple, hn.mined(frame, anchor_rows(spark, anchors + [0])).collect()))
    assert got == brute(rows, set(anchors), hn.Settings())


def test_repeated_rows_are_candidates_each_and_anchors_once(spark):
    rows = [(1, [1.0], 0), (1, [1.0], 0), (2, [1.0], 0), (2, [1.0], 0), (3, [0.75], 1), (3, [0.75], 1), (4, [0.7], 1)]
    frame = spark.createDataFrame([(*r, 1, 2, 0.5, "x") for r in rows], SCHEMA)
    got = sorted(map(tuple, hn.mined(frame, anchor_rows(spark, [1])).collect()))
    one = [(1, 2, 1, 3, 65536, 49152), (1, 2, 2, 3, 65536, 49152), (1, 2, 3, 4, 65536, 45824)]
    assert got == sorted(one + one)


def test_lookups_give_the_inner_product():
    r = np.random.default_rng(2)
    for top in (1, 2, 200, 1 << 27):
        a, c = r.integers(-top, top, (7, 24)), r.integers(-top, top, (50, 24))
        a[0], c[0], c[1] = -top, -top, 0
        assert (hn.scores(hn.tables_of(a), hn.planes_of(c)) == (c.astype(object) @ a.T.astype(object))).all()


def test_too_large_components_end_with_an_error(spark):
    with pytest.raises(OverflowError):
        hn.checked(np.full((1, 64), 1 << 40), np.zeros((42, 8, 1), np.uint8))


def test_sql_gives_the_same(spark, tmp_path):
    rows = random_rows(300, 64, 11)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(map(tuple, hn.op13_hard_negatives(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(hn.ORACLE).fetchall()) and got


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert hn.mined(frame, frame).collect() == []


def test_tasks_are_bounded_whatever_the_number_of_pieces(spark):
    """The driver keeps something for each task; 260 rows in packs of 5 and sets of 2 make thousands of pieces."""
    rows = random_rows(260, 5, 3)
    s = hn.Settings(pack=5, set=2, tasks=7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    packed = hn.stored(hn.packs(hn.usable(df), s), "packs")
    anchors = hn.usable(df).selectExpr("vec_id AS anchor_id", "label", "v", "array(0L) AS asked")
    work = hn.pieces(anchors, packed, s)
    assert work.rdd.getNumPartitions() <= 7 and work.count() >= 52 * 100
    got = sorted(tuple(r) for r in hn.mined(df, anchor_rows(spark, range(0, 260, 10)), s).collect())
    assert got == brute(rows, set(range(0, 260, 10)), s)


def test_a_thousand_anchors_share_a_copy_of_the_candidates(spark):
    """A pack is shuffled once for each set; sets of 256 anchors sent it four times."""
    rows = random_rows(1000, 3, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(1)
    packed = hn.packs(hn.usable(df), hn.Settings())
    anchors = hn.usable(df).selectExpr("vec_id AS anchor_id", "label", "v", "array(0L) AS asked")
    assert hn.pieces(anchors, packed, hn.Settings()).count() == 1
