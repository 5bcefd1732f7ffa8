import itertools
import random
import re

import duckdb
import pytest

from windrow.llm import substring_dedup as sd


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, n=13):
    smallest = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - n + 1):
            if doc is not None:
                key = tuple(w[i : i + n])
                smallest[key] = min(smallest.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - n + 1):
            if doc is not None and smallest[tuple(w[i : i + n])] < doc:
                gone.update(range(i, i + n))
        out.append((doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.fixture(scope="module")
def rows():
    """Texts that share passages of 11 to 60 words at all shifts, with copies and near copies."""
    r = random.Random(4)
    vocabulary = [f"v{k}" for k in range(400)]
    passages = [[r.choice(vocabulary) for _ in range(n)] for n in (11, 12, 13, 14, 19, 25, 60, 60)]
    texts = []
    for _ in range(120):
        body = [r.choice(vocabulary) for _ in range(r.randint(0, 30))]
        for p in r.sample(passages, r.randint(0, 3)):
            lo = r.randint(0, 6)
            body += p[lo:] + [r.choice(vocabulary) for _ in range(r.randint(0, 9))]
        texts.append(r.choice([" ", "\n", " \t"]).join(body))
    texts += [texts[5], texts[5] + " tail", "a " * 40, "a " * 13, "a " * 12]
    order = list(range(1000, 1000 + len(texts)))
    r.shuffle(order)
    return [(k, t, "en", "s", None, 1, "x", 0.5, 2) for k, t in zip(order, texts)]


def test_difference_cover_has_every_difference():
    found = {(a - b) % sd.PERIOD for a, b in itertools.product(sd.COVER, repeat=2)}
    assert found == set(range(sd.PERIOD))
    assert sd.Settings().anchor + sd.PERIOD - 1 == sd.Settings().window


@pytest.mark.parametrize("bucket", [4 << 20, 700])
def test_equals_brute_force(make_docs, rows, messy_rows, bucket):
    source = rows + messy_rows
    got = [tuple(r) for r in sd.deduplicated(make_docs(source), sd.Settings(bucket=bucket)).collect()]
    assert sorted(map(key, got)) == sorted(map(key, brute([r[:2] for r in source])))


def test_sql_gives_the_same(make_docs, rows, messy_rows, spark, tmp_path):
    make_docs(rows + messy_rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(key, con.execute(sd.ORACLE).fetchall()))
    got = sd.op11_substring_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(key, map(tuple, got))) == want


def test_only_live_anchors_have_windows_sent(rows):
    """Windows without a shared anchor are never candidates."""
    body = [r[1].encode() for r in rows[:40]]
    row = {"bucket": 0, "doc_ids": [r[0] for r in rows[:40]], "sizes": [len(b) for b in body], "body": b"".join(body)}
    b = sd.Bucket(row, sd.Settings())
    at, distinct, back = b.anchors()
    shared = b.shared(at, len(distinct), back)
    assert 0 < shared.sum() < len(distinct)
    assert len(b.candidates(shared)[0]) < b.inside(13).sum()
    assert len(b.candidates(np_false(len(distinct)))[0]) == 0


def np_false(n):
    import numpy as np

    return np.zeros(n, bool)


def test_empty_table(no_docs):
    assert sd.deduplicated(no_docs).collect() == []


def test_parts_do_not_grow_with_the_table():
    """Ten times as much text goes to more parts, each judged in as much memory as before."""
    s = sd.Settings()
    for size in (1 << 30, 10 << 30, 100 << 30):
        assert size >> s.bits(size) <= 8 << 20
    assert 1 << s.bits(1000) == s.parts


def test_many_parts_give_the_same(make_docs, rows, messy_rows):
    source = rows + messy_rows
    few, many = (sd.deduplicated(make_docs(source), sd.Settings(bucket=700, part=part)).collect() for part in (8 << 20, 100))
    assert sorted(map(key, map(tuple, few))) == sorted(map(key, map(tuple, many)))


def test_bodies_are_compressed_while_spark_holds_them(make_docs, rows):
    stored = sd.bucketed(make_docs([(k, "the same words again " * 50, *r[2:]) for k, r in enumerate(rows)]), sd.Settings()).collect()
    assert all(len(r["body"]) < sum(r["sizes"]) / 4 for r in stored)
    assert sum(sum(r["sizes"]) for r in stored) == len(rows) * 1050
