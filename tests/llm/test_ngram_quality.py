import collections
import random
import re

import numpy as np
import pytest

from windrow.llm import ngram_quality as nq


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


@pytest.fixture(scope="module")
def labelled(make_docs, spark):
    r = random.Random(1)
    good = [" ".join(r.choice("river stone light bread green".split()) for _ in range(40)) for _ in range(60)]
    bad = [" ".join(r.choice("river stone light bread green".split()) + "###" for _ in range(40)) for _ in range(60)]
    texts = [t for pair in zip(good, bad) for t in pair]
    docs = make_docs([(k, t, "en", "s", None, 0, "", 0.0, 0) for k, t in enumerate(texts)])
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(len(texts)) if k % 3], "doc_id long, quality int, toxic int")
    return docs, labels


def test_base_counts_equal_brute_force(messy, messy_rows, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = nq.quality_rules(messy, none).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    want = sorted(((r[0], *brute(r[1])) for r in messy_rows), key=key)
    assert sorted(((r.doc_id, *r[1:7]) for r in got), key=key) == want
    assert all(r.kept == (not r.base_failed) for r in got)  # no labels: base rules alone


def test_learns_unlabelled_rows(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in nq.quality_rules(docs, labels).collect()}
    unseen = [k for k in got if k % 3 == 0]
    assert all(got[k].kept == (k % 2 == 0) for k in unseen)
    assert all(0 <= r.quality_prob <= 1 for r in got.values())


@pytest.mark.parametrize("shift, spread", [(0, 1e-3), (0, 1), (5, 30), (-200, 400)])
def test_calibration_rises_with_the_margin(shift, spread):
    """Also where the margins of both labels are far apart."""
    labels = np.arange(40) % 2
    margin = shift + spread * (labels + np.linspace(0, 0.5, 40))
    slope, at = nq.calibration(margin, labels)
    p = nq.sigmoid(slope * margin + at)
    assert slope > 0 and p[labels == 1].min() > 0.5 > p[labels == 0].max()


def test_one_class_of_labels_leaves_the_base_rules(labelled):
    docs, labels = labelled
    assert all(r.kept for r in nq.quality_rules(docs, labels.where("quality = 1")).collect())


def test_empty_table(no_docs, labelled):
    assert nq.quality_rules(no_docs, labelled[1]).count() == 0


@pytest.mark.parametrize("last", [None, "", " \n"])
def test_a_fitted_model_scores_texts_without_words(labelled, messy_rows, spark, last):
    """Also where such a text ends a block, and each text as if it were alone."""
    docs, labels = labelled
    rows = [(1000 + k, r[1]) for k, r in enumerate(messy_rows)] + [(2000, last)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in nq.quality_rules(docs.select("doc_id", "text").unionByName(odd), labels).collect()}
    assert len(got) == docs.count() + len(rows) and got[2000].n_words == 0 and not got[2000].kept
    same = {}
    for k, text in rows:
        same.setdefault(text, set()).add(round(got[k].quality_prob, 9))
    assert all(len(p) == 1 for p in same.values()) and same.get("", same[last]) == same[None]


def test_margins_of_a_block_equal_those_of_its_texts(messy_rows):
    weights = np.random.default_rng(2).normal(size=1 << 12)
    texts = [r[1] for r in messy_rows] + ["a b", None, "one", ""]
    ((_, _, whole),) = nq.blocks(nq.pa.array(texts))
    alone = [nq.margins(b, weights, 12)[0] for t in texts for _, _, b in nq.blocks(nq.pa.array([t], nq.pa.string()))]
    assert np.allclose(nq.margins(whole, weights, 12), alone)
