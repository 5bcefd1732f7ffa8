import collections
import re

import numpy as np
import pyarrow as pa

from windrow.llm import textblock as tb

TEXTS = ["", "one", " two  words\t", "É ñ word É ñ word", None, "a b c d e f g h a b c d e f g h", "line\nline\n\nother\n  \nline"]


def block(texts):
    ((lo, hi, b),) = tb.blocks(pa.array(texts, pa.string()))
    assert (lo, hi) == (0, len(texts))
    return b


def test_words_and_hashes_follow_the_text():
    b = block(TEXTS)
    starts, ends, first = b.words()
    h = b.span_hashes(starts, ends)
    found = [h[a:z] for a, z in zip(first[:-1], first[1:])]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    assert [len(x) for x in found] == [len(x) for x in words]
    by_word = {}
    for hs, ws in zip(found, words):
        for x, w in zip(hs, ws):
            assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_words_do_not_cross_texts():
    b = block(["ab", "cd", "", "ef"])
    starts, ends, first = b.words()
    assert [bytes(b.buf[a:z]) for a, z in zip(starts, ends)] == [b"ab", b"cd", b"ef"]
    assert first.tolist() == [0, 1, 2, 2, 3]


def test_small_blocks_equal_one_block():
    texts = [t or "" for t in TEXTS] * 20
    whole = block(texts)
    sizes = np.diff(whole.words()[2]).tolist()
    parts = [n for _, _, b in tb.blocks(pa.array(texts), 16) for n in np.diff(b.words()[2]).tolist()]
    assert parts == sizes


def test_sliced_arrays_are_read_at_their_offset():
    a = pa.array(["xx", "one two", None, "three"]).slice(1)
    ((_, _, b),) = tb.blocks(a)
    assert np.diff(b.words()[2]).tolist() == [2, 0, 1]


def test_windows_count_like_tuples():
    h = np.array([1, 2, 3, 1, 2, 3, 1], np.uint64)
    got = collections.Counter(tb.windows(h, 3).tolist())
    want = collections.Counter(tuple(h[i : i + 3].tolist()) for i in range(5))
    assert sorted(got.values()) == sorted(want.values())
    assert len(tb.windows(h, 8)) == 0


def test_no_texts_no_blocks():
    assert list(tb.blocks(pa.array([], pa.string()))) == []
