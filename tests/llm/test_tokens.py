import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from windrow.llm import open_windows as ow
from windrow.llm import simple8b as s8
from windrow.llm.tokens import encoded, encoder, known_path
from windrow.llm.textblock import blocks

BYTES, WORDS = known_path("byte_bpe_50k.json"), known_path("word_bpe_49k.json")


def library(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(list(texts), add_special_tokens=False)]


def cached(path, spaced, texts):
    out = []
    for _, _, b in blocks(pa.array(texts, pa.string())):
        ids, edge = encoder(path, spaced).encode(b)
        out += [ids[a:z].tolist() for a, z in zip(edge[:-1], edge[1:])]
    return out


PIECES = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\x1c", "a", "The", "don't", "'s", "12", "3.5", "é", "É", "é", "́", "日本", "!!", "#", "<|endoftext|>", "’", "🙂", "​", "ſ", "İ"])


@pytest.mark.parametrize("path, spaced", [(BYTES, True), (WORDS, False)])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=5))
def test_ids_equal_the_library(path, spaced, texts):
    assert cached(path, spaced, texts) == library(path, texts)


def test_bounded_table_keeps_ids_right():
    e = encoder.__wrapped__(BYTES, True)
    e.room = 50
    texts = [f"word{k} and other{k} text" for k in range(60)]
    for at in range(0, 60, 7):
        ((_, _, b),) = blocks(pa.array(texts[at : at + 7]))
        ids, edge = e.encode(b)
        assert [ids[a:z].tolist() for a, z in zip(edge[:-1], edge[1:])] == library(BYTES, texts[at : at + 7])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 70) | st.integers(0, 60_000), max_size=3000))
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    words, offsets = s8.pack(x)
    assert s8.unpack(words).tolist() == ids
    for k in range(len(offsets)):
        assert s8.run_of(words, offsets, k).tolist() == ids[k * s8.RUN : (k + 1) * s8.RUN]


def test_simple8b_fills_words():
    assert len(s8.pack(np.ones(960, np.uint64))[0]) == 16  # 60 one-bit ids a word
    assert len(s8.pack(np.full(960, 50_000, np.uint64))[0]) == 320  # 16 bits: 3 of 20


def expected(rows, path, end):
    ids = library(path, [r[1] or "" for r in rows])
    return [(r[0], np.array([*x, end], "<u4")) for r, x in zip(rows, ids)]


@pytest.mark.parametrize("block", [1, 500, 1 << 16])
def test_files_hold_all_ids_in_order(messy, messy_rows, tmp_path, block, spark):
    s8.write(messy, str(tmp_path / "ids"), s8.Settings(BYTES, block=block))
    got = s8.read(spark, str(tmp_path / "ids")).orderBy("start").collect()
    rows = sorted(messy_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (doc_id, ids) in zip(got, expected(rows, BYTES, 2), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_files_of_an_empty_table(no_docs, tmp_path, spark):
    s8.write(no_docs, str(tmp_path / "ids"), s8.Settings(BYTES))
    assert s8.read(spark, str(tmp_path / "ids")).count() == 0


def packed_ok(rows, source, s):
    ids = {}
    for doc_id, x in expected(source, s.tokenizer, s.end):
        ids.setdefault((doc_id, len(x), zlib.crc32(x.tobytes())), []).append(x)
    left = {}
    for r in rows:
        left.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for (doc_id, n, _), xs in ids.items():
        x = xs[0]
        for r in left[doc_id, n]:
            part = x[r.start : r.start + r.length]
            if zlib.crc32(part.tobytes()) == r.ids_crc32:
                break
        else:
            raise AssertionError(doc_id)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= s.length
    return windows


@pytest.mark.parametrize("windows, merged", [(1, 2), (4, 2), (32, 16)])
def test_packing_covers_every_id_once(messy, messy_rows, windows, merged):
    s = ow.Settings(WORDS, length=64, windows=windows, merged=merged)
    rows = ow.packed(messy.repartition(5), s).collect()
    packed_ok(rows, messy_rows, s)
    for r in messy_rows:
        n = len(library(WORDS, [r[1] or ""])[0]) + 1
        own = sorted({(p.start, p.length) for p in rows if p.doc_id == r[0] and p.doc_tokens == n})
        assert own[0][0] == 0 and sum(k for _, k in own) == n


def test_packing_wastes_little(make_docs):
    rows = [(k, "alpha beta gamma " * (1 + (k * 37) % 200), "en", "s", None, 0, "", 0.0, 0) for k in range(600)]
    s = ow.Settings(WORDS)
    w = packed_ok(ow.packed(make_docs(rows), s).collect(), rows, s)
    tokens = sum(r.length for v in w.values() for r in v)
    assert tokens / (len(w) * s.length) > 0.95


def test_packing_an_empty_table(no_docs):
    assert ow.packed(no_docs, ow.Settings(WORDS)).count() == 0


def by_default(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch(list(texts), add_special_tokens=False)]


SPECIAL = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>"])


@pytest.mark.parametrize("path, spaced", [(BYTES, True), (WORDS, False)])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(PIECES | SPECIAL, max_size=12).map("".join), min_size=1, max_size=5))
def test_ids_of_the_queries_equal_the_library_by_default(path, spaced, texts):
    """Special tokens in a text have the ids the library gives them without any switch."""
    got = [ids.tolist() for _, ids in encoded(pa.array(texts, pa.string()), path, spaced, 7)]
    assert got == [[*x, 7] for x in by_default(path, texts)]


def test_special_tokens_in_files_and_sequences(make_docs, tmp_path, spark):
    texts = ["a b <|endoftext|> c", "<|startoftext|>a<|endoftext|>", "plain"]
    docs = make_docs([(k, t, "en", "s", None, 0, "", 0.0, 0) for k, t in enumerate(texts)])
    s8.write(docs, str(tmp_path / "ids"), s8.Settings(BYTES))
    want = [np.array([*x, s8.Settings(BYTES).end], "<u4") for x in by_default(BYTES, texts)]
    got = s8.read(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert want[0][:-1].tolist() == [64, 275, 220, 50256, 269]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(k, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(want)]
    s = ow.Settings(WORDS)
    rows = {r.doc_id: r for r in ow.packed(docs, s).collect()}
    for k, x in enumerate(by_default(WORDS, texts)):
        ids = np.array([*x, s.end], "<u4")
        assert (rows[k].doc_tokens, rows[k].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def plain_words(ids):
    """Greedy coding, one word after the other."""
    out, k = [], 0
    while k < len(ids):
        end = min(len(ids), (k // s8.RUN + 1) * s8.RUN)
        for s, (count, width) in enumerate(zip(s8.COUNTS.tolist(), s8.WIDTHS.tolist())):
            if k + count <= end and all(x < 1 << width for x in ids[k : k + count]):
                out.append(s << 60 | sum(x << j * width for j, x in enumerate(ids[k : k + count])))
                k += count
                break
        else:
            out += [s8.ESCAPE << 60, ids[k]]
            k += 1
    return out


def test_few_narrow_ids_are_found_by_their_runs(monkeypatch):
    """The words are those of the greedy walk; a width that few ids have needs no running total over all of them."""
    rng = np.random.default_rng(4)
    ids = rng.integers(1 << 12, 50_000, 5000).astype(np.uint64)
    for at, size, top in [(0, 61, 2), (900, 70, 4), (1010, 40, 200), (3000, 500, 2), (4990, 10, 8)]:
        ids[at : at + size] = rng.integers(0, top, size)
    ids[rng.random(5000) < 0.01] = 1 << 62
    totals = []
    real = np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda x, *a, **k: (totals.append(len(x)), real(x, *a, **k))[1])
    words, _ = s8.pack(ids)
    assert words.tolist() == plain_words(ids.tolist())
    assert sum(n == 5000 for n in totals) <= 5 and s8.unpack(words).tolist() == ids.tolist()
    for part in (ids[:0], ids[:1], ids[:61], np.zeros(130, np.uint64)):
        assert s8.pack(part)[0].tolist() == plain_words(part.tolist())
