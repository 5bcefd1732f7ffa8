import collections
import random
import re

import numpy as np
import pytest

from windrow.llm import components as cc
from windrow.llm import occurrence_join as oj

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0] is None, r[0] or 0, len(sets[i]), least.get(find(i), -1)) for i, r in enumerate(rows))


def found(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def near_copies(seed=3):
    """Groups of near copies at all degrees, chains, and passages that many texts share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    line = " ".join(word() for _ in range(14))
    texts = []
    for _ in range(12):
        body = [word() for _ in range(r.randint(8, 120))]
        for _ in range(r.randint(1, 12)):
            own = list(body)
            for _ in range(r.randint(0, max(1, len(own) // 25))):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own).title() if r.random() < 0.2 else " ".join(own))
            if r.random() < 0.5:
                body = own  # a chain
    texts += [line + " " + " ".join(word() for _ in range(r.randint(1, 30))) for _ in range(60)]
    texts += [texts[0]] * 5
    return [(500 + k, t, "en", "s", None, 0, "", 0.0, 0) for k, t in enumerate(texts)]


@pytest.mark.parametrize("settings", [oj.Settings(), oj.Settings(least=2, frequent=50, share=1.0, chunk=4, group=40), oj.Settings(frequent=0, chunk=7)])
def test_equals_brute_force(messy_rows, make_docs, settings):
    rows = messy_rows + near_copies()
    assert found(oj.grouped(make_docs(rows), settings)) == brute(rows)


def test_a_list_without_links_inside(make_docs):
    """All texts share most rare shingles, no pair links: the lists are searched, nothing joins."""
    r = random.Random(6)
    core = [f"c{k}" for k in range(60)]
    rows = []
    for k in range(60):
        rows.append((k, " ".join(core + [f"u{k}x{i}" for i in range(12)]), "en", "s", None, 0, "", 0.0, 0))
    r.shuffle(rows)
    got = found(oj.grouped(make_docs(rows), oj.Settings(chunk=8)))
    assert got == brute(rows)


def test_t_occurrence_equals_counting():
    r = np.random.default_rng(1)
    for _ in range(60):
        query = np.unique(r.integers(0, 80, r.integers(1, 60)).astype(np.uint64))
        sets = [np.unique(r.integers(0, 80, r.integers(1, 60)).astype(np.uint64)) for _ in range(r.integers(1, 30))]
        least = np.array([r.integers(1, 30) for _ in sets])
        want = [len(np.intersect1d(query, x)) for x in sets]
        assert oj.t_occurrence(query, sets, least).tolist() == [w if w >= t else 0 for w, t in zip(want, least)]


def test_bitmaps_never_refuse_a_link():
    r = np.random.default_rng(2)
    s = oj.Settings()
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * r.uniform(0.7, 1))], r.integers(0, 1 << 63, r.integers(0, 60), dtype=np.uint64)]))
        a, b = sorted((a, b), key=len)
        same = len(np.intersect1d(a, b))
        if 100 * same >= 80 * (len(a) + len(b) - same):
            n = np.array([len(a), len(b)])
            assert oj.Bitmaps([oj.bitmap(a), oj.bitmap(b)]).possible(n, np.array([0]), np.array([1]), s)[0].all()


def test_stage_keeps_one_row_of_each_group(messy_rows, make_docs, messy):
    rows = messy_rows + near_copies() + [(501, "another text under a used id", "en", "s", None, 0, "", 0.0, 0)]
    kept = oj.one_of_each(make_docs(rows))
    assert kept.columns == messy.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert set(got.values()) == {1} and set(got) <= {r[:2] for r in rows}
    distinct = sorted({r[:2] for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    named = [(k, text) for k, (_, text) in enumerate(distinct)]  # rows as vertices of their own
    groups = collections.defaultdict(list)
    for _, k, _, root in brute([(k + 1, t) for k, t in named]):
        groups[root].append(distinct[k - 1])
    for members in groups.values():
        stay = [m for m in members if m in got]
        assert len(stay) == 1
        ids = [m[0] for m in members if m[0] is not None]
        assert stay[0][0] == (min(ids) if ids else None)


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(1, 40)]
    star = [(100, 100 + k) for k in range(1, 50)] + [(120, 120)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{100 + k: 100 for k in range(50)}}


def test_empty_table(no_docs):
    assert oj.grouped(no_docs).count() == 0 and oj.one_of_each(no_docs).count() == 0
