import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from windrow.llm import maxent_lm as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def check_base(got, rows, crc_of):
    held = lambda k: crc_of(k) % 10 == 0
    c = collections.Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        t = tokens(r[1])
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        want.append((r[0] is None, r[0] or 0, held(r[0]), len(t), sum(c[x] > 0 for x in t), n, round(base, 6)))
    have = [(r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    for a, b in zip(sorted(have), sorted(want), strict=True):
        assert a[:-1] == b[:-1] and abs(a[-1] - b[-1]) <= 2e-6 * max(1, abs(b[-1]))


def test_base_score_equals_brute_force(messy, messy_rows, crc_of):
    for s in (lm.Settings(), lm.Settings(lookups=30, vocabulary=8, anchors=4)):
        got = lm.scored(messy, s).collect()
        check_base(got, messy_rows, crc_of)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_model_learns_order(make_docs):
    """Texts in which the word before tells the next: the model beats counts on held-out texts."""
    r = random.Random(7)
    follow = {f"w{k}": [f"w{(3 * k + j) % 40}" for j in (1, 2)] for k in range(40)}
    rows = []
    for k in range(300):
        word, out = f"w{r.randrange(40)}", []
        for _ in range(80):
            out.append(word)
            word = r.choice(follow[word])
        rows.append((k, " ".join(out), "en", "s", None, 0, "", 0.0, 0))
    got = [x for x in lm.scored(make_docs(rows), lm.Settings(stride=1, rounds=3)).collect() if x.held_out]
    assert got and sum(x.score for x in got) > 0.9 * sum(x.base_score for x in got)


def test_probabilities_of_all_words_sum_to_one():
    """Class factor times word factor over the vocabulary, other words and the unseen one."""
    r = np.random.default_rng(3)
    counts, s = r.integers(5, 90, 30), lm.Settings(clusters=2, bands=3)
    words = np.arange(10, 40, dtype=np.uint64)
    classes = lm.classes_of(words, counts, r.random((30, 4)), s)
    width = s.clusters * s.bands + 2
    mass = np.bincount(classes, counts, width)
    rest = np.array([3, 2, 1])
    p_class = lm.chances(r.normal(size=(1, width)))[0]
    inside = sum(p_class[c] * n / mass[c] for c, n in zip(classes, counts))
    other = p_class[-1] * (sum((rest + s.alpha) / (rest.sum() + s.alpha * 4)) + s.alpha / (rest.sum() + s.alpha * 4))
    used = p_class[:-1][mass[:-1] > 0].sum() + p_class[-1]
    assert abs(inside + other - used) < 1e-9


def test_features_stay_inside_a_text():
    h = np.array([5, 6, 0, 7, 0], np.uint64)
    whole = lm.features(h, np.array([0, 3, 5]), 10)
    assert (whole[3:] == lm.features(h[3:], np.array([0, 2]), 10)).all()


def test_no_training_rows(no_docs, make_docs, crc_of):
    assert lm.scored(no_docs).count() == 0
    held = next(k for k in range(1000) if crc_of(k) % 10 == 0)
    (row,) = lm.scored(make_docs([(held, "a b", "en", "s", None, 0, "", 0.0, 0)])).collect()
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 3) and abs(row.base_score) < 1e-9


def test_every_position_is_learned_from(make_docs):
    """Each n-gram and skip feature of every training document has moved its row of the table."""
    texts = [f"a{k} b{k} c{k}" for k in range(40)]  # four tokens each, with the end
    docs = make_docs([(k, t, "en", "s", None, 0, "", 0.0, 0) for k, t in enumerate(texts)]).select("doc_id", "text")
    ((_, _, block),) = lm.blocks(pa.array(texts))
    h, first = lm.token_stream(block)
    lexicon, s = lm.Lexicon(np.unique(h)), lm.Settings()
    classes, bias = np.arange(lexicon.size + 1) % 5, np.zeros(5, np.float32)
    moved = (lm.trained(docs, lexicon, classes, bias, 160, s) != 0).any(1)
    assert moved[lm.features(h, first, s.bits)].all()


def test_scores_do_not_depend_on_partitions(make_docs):
    """Several trainers, dealt by document: the same scores from one partition, three and eleven."""
    r = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 50))), "en", "s", None, 0, "", 0.0, 0) for k in range(200)]
    s = lm.Settings(trainer=700, batch=128)
    found = [sorted((x.doc_id, x.score) for x in lm.scored(make_docs(rows).repartition(n), s).collect()) for n in (1, 3, 11)]
    assert found[0] == found[1] == found[2]


def test_step_follows_the_plain_gradient():
    """One step against sums over positions, class by class."""
    r = np.random.default_rng(5)
    n, width, size = 90, 6, 16
    rows, target = r.integers(0, size, (n, 4)), r.integers(0, width, n)
    w, bias = r.normal(size=(size, width)).astype(np.float32), r.normal(size=width).astype(np.float32)
    speed = np.full(size, 1e-3, np.float32)
    want, grown = w.astype(float).copy(), speed.astype(float).copy()
    z = np.array([sum(w[k].astype(float) for k in x) + bias for x in rows])
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    p[np.arange(n), target] -= 1
    for k in range(size):
        hits = [p[i] for i in range(n) for x in rows[i] if x == k]
        if hits:
            g = np.sum(hits, axis=0) / math.sqrt(len(hits))
            grown[k] += (g**2).sum()
            want[k] -= 0.3 * g / math.sqrt(grown[k])
    lm.step(w, speed, rows.astype(np.uint16), target, bias, 0.3)
    assert np.allclose(w, want, atol=1e-4) and np.allclose(speed, grown, rtol=1e-3)


def test_score_equals_brute_force(make_docs, crc_of):
    """Class chance times word chance of every token, from the same weights, by plain Python."""
    r = random.Random(9)
    rows = [(k, " ".join(r.choice("a b c d e f".split()) for _ in range(r.randint(0, 12))), "en", "s", None, 0, "", 0.0, 0) for k in range(60)]
    s = lm.Settings(anchors=2, clusters=1, bands=1, rounds=1)
    got = {x.doc_id: x.score for x in lm.scored(make_docs(rows), s).collect()}
    counts = collections.Counter(t for k, text, *_ in rows if crc_of(k) % 10 for t in tokens(text))
    # one class for words, one for the end, an empty one for the rest
    texts = [text for k, text, *_ in rows if crc_of(k) % 10]
    named = {t: lm.token_stream(b)[0] for t in "abcdef" for _, _, b in lm.blocks(pa.array([t]))}
    hashes = np.array([named[t][0] for t in "abcdef"] + [lm.END], np.uint64)
    order = sorted(range(7), key=lambda i: (-counts["abcdef"[i] if i < 6 else None], int(hashes[i].view(np.int64))))
    lexicon = lm.Lexicon(hashes[order])
    classes = np.array([1 if i == 6 else 0 for i in order] + [2])
    mass = np.array([sum(counts[c] for c in "abcdef"), counts[None], 0])
    bias = np.log((mass + 0.5) / (mass.sum() + 1.5)).astype(np.float32)
    docs = make_docs(rows).where(F.col("doc_id").isin([k for k, *_ in rows if crc_of(k) % 10])).select("doc_id", "text")
    weights = lm.trained(docs, lexicon, classes, bias, int(mass.sum()), s)
    assert len(texts) > 30
    for k, text, *_ in rows:
        ((_, _, block),) = lm.blocks(pa.array([text]))
        h, first = lm.token_stream(block)
        want = 0.0
        for at, t in zip(lm.features(h, first, s.bits), tokens(text)):
            z = sum(weights[x].astype(float) for x in at) + bias
            c = 1 if t is None else 0
            want += math.log10(math.exp(z[c]) / sum(map(math.exp, z))) + math.log10(counts[t] / mass[c])
        assert abs(got[k] - want) < 1e-4 * max(1, abs(want))
