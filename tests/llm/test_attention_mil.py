import random

import numpy as np
import pyarrow as pa

from windrow.llm import attention_mil as am
from windrow.llm.textblock import blocks


def labelled(make_docs, spark, n=160, start=0):
    r = random.Random(2)
    word = lambda: r.choice("river stone light bread green house".split())
    texts = []
    for k in range(n):
        passages = [" ".join(word() for _ in range(64)) for _ in range(4)]
        if k % 2:  # one bad passage somewhere makes the document bad
            passages[r.randrange(4)] = " ".join(word().upper() + "!!" for _ in range(64))
        texts.append(" ".join(passages))
    docs = make_docs([(start + k, t, "en", "s", None, 0, "", 0.0, 0) for k, t in enumerate(texts)])
    return docs, spark.createDataFrame([(start + k, 1 - k % 2, 0) for k in range(n)], "doc_id long, quality int, toxic int")


def test_gradients_equal_differences():
    s = am.Settings(bits=4, width=3, gate=2)
    r = np.random.default_rng(0)
    x, shapes = r.random((7, 16)), r.random((7, am.SHAPES))
    first, y = np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    w = {k: v.astype(float) for k, v in am.start_weights(s).items()}

    def loss():
        h = np.tanh(x @ w["grams"] + shapes @ w["shapes"] + w["bias"])
        p = am.logistic(am.attended(h, first, w)[3] @ w["out"] + w["shift"])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, g in am.gradients(x, shapes, first, y, w).items():
        at = tuple(0 for _ in w[k].shape)
        kept, step = w[k][at], 1e-6
        w[k][at] = kept + step
        up = loss()
        w[k][at] = kept - step
        down = loss()
        w[k][at] = kept
        assert abs((up - down) / (2 * step) - g[at]) < 1e-6, k


def test_every_word_is_in_a_passage():
    ((_, _, b),) = blocks(pa.array(["a " * 130, "", "b"]))
    found = am.bags(b, am.Settings())
    assert np.diff(found.first).tolist() == [3, 1, 1]
    assert found.shapes[:, -1].tolist() == [1.0, 1.0, 2 / 64, 0.0, 1 / 64] or np.allclose(found.shapes[:, -1], [1, 1, 2 / 64, 0, 1 / 64])


def test_held_out_accuracy(make_docs, spark, crc_of):
    docs, labels = labelled(make_docs, spark)
    got = am.classified(docs, labels, am.Settings(epochs=25)).collect()
    assert all(r.held_out == (crc_of(r.doc_id) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in held) >= 0.9 * len(held)
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_messy_rows_and_stage(messy, messy_rows, make_docs, spark):
    docs, labels = labelled(make_docs, spark, 40, 1000)
    got = am.classified(messy.unionByName(docs), labels).collect()
    assert len(got) == len(messy_rows) + 40 and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (13, 14, 15, 16)}
    assert len(empty) == 1  # null, empty and blank texts are the same bag
    kept = am.accepted(messy.unionByName(docs), labels)
    assert kept.columns == messy.columns
    assert kept.count() == sum(r.predicted for r in got)


def test_without_labels_and_rows(messy, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in am.classified(messy, none).collect()} == {1}
    assert am.classified(no_docs, none).count() == 0 and am.accepted(no_docs, none).count() == 0


def test_fit_holds_narrow_bags_and_fits_the_same_weights():
    """Bags come block by block: the same weights as from one block, without its wide arrays over all bytes."""
    import tracemalloc

    r = random.Random(4)
    texts = ["".join(r.choice("abcdefgh #A1") for _ in range(3000)) for _ in range(1200)] + ["", "a"]
    s = am.Settings(epochs=0)
    (_, _, block), = blocks(pa.array(texts, pa.large_string()), 1 << 62)
    whole = am.bags(block, s)
    tracemalloc.start()
    am.fit(texts, np.arange(len(texts)) % 2, s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35 * block.size
    b = am.bags_of(texts, s)
    for name in ("buckets", "passage", "sizes", "shapes", "first"):
        assert np.array_equal(getattr(b, name), getattr(whole, name))
