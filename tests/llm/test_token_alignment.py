import collections
import hashlib
import random

import pytest

from windrow.llm import token_alignment as ta
from windrow.llm.tokens import known_path

A, B = known_path("byte_bpe_50k.json"), known_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return ta.Pair(A, B)


def brute_groups(pair, text):
    """Groups of a whole text by the bytes of all its tokens; None without tokens."""
    if not text:
        return None
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    want = (" " + text).encode()
    if b"".join(pair.a_bytes[k] for k in a) != want or b"".join(pair.b_bytes[k] for k in b) != want:
        return None

    def ends(ids, size):
        out, at = [], 0
        for k in ids:
            at += len(size[k])
            out.append(at)
        return out

    ea, eb = ends(a, pair.a_bytes), ends(b, pair.b_bytes)
    groups, i, j = [], 0, 0
    for c in sorted(set(ea) & set(eb)):
        x, y = ea.index(c, i) + 1, eb.index(c, j) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return groups


def brute(pair, rows):
    found = [brute_groups(pair, t) for _, t in rows]
    held = collections.Counter()
    for g in found:
        held.update({(x, y) for left, right in g or [] for x in left for y in right})
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (doc, _), g in zip(rows, found):
        if g is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for left, right in g for x in left for y in right]
        body = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in g)
        out.append((doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
                    sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links),
                    hashlib.sha256(body.encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


ODD = [
    "café naïve 日本語 \U0001d4b3\U0001d4b3 x", "a▁b stays without tokens", "tab\tand\r\nreturn;\r\n}\r", "\n\n  lead", "trail  \n ",
    "wide space　here   x", "<|endoftext|> <s> </s> <0x41> <unk>", "\x00\x01 zero", "x" * 900, "\U0001f600" * 40, " ", "\n", "‍́é",
    "    indented    code(){ return  'a'; }", "ßßß Straße Δια привет", "\v\f x", "don't we'll I'M 1234567",
]


def test_equals_brute_force_over_whole_texts(pair, make_docs, messy_rows):
    rows = messy_rows + [(500 + k, t, "en", "s", None, 0, "", 0.0, 0) for k, t in enumerate(ODD + ODD[:3])]
    for room, bucket in ((500_000, 4 << 20), (40, 200)):
        got = [tuple(r) for r in ta.aligned(make_docs(rows), ta.Settings(A, B, bucket, room)).collect()]
        assert sorted(map(key, got)) == sorted(map(key, brute(pair, [r[:2] for r in rows])))


def test_random_texts_of_many_scripts(pair, make_docs):
    r = random.Random(3)
    pool = "abc de\n\tXY,.;'\"09" + "éßаб中文\U0001f600\U0001d4b3́▁ \r"
    rows = [(k, "".join(r.choice(pool) for _ in range(r.randint(1, 60))), "en", "s", None, 0, "", 0.0, 0) for k in range(400)]
    got = [tuple(x) for x in ta.aligned(make_docs(rows), ta.Settings(A, B)).collect()]
    assert sorted(map(key, got)) == sorted(map(key, brute(pair, [x[:2] for x in rows])))


def test_byte_fallback_and_split_characters_are_cut_by_bytes(pair):
    """A character that A cuts in bytes and B spells in bytes: cuts lie inside the character."""
    text = " \U0001d4b3"
    n_a, n_b, n_groups, _ = pair.align([text]).totals[0]
    assert n_groups > 2 and n_a >= 3 and n_b >= 4


def test_empty_table(no_docs):
    assert ta.aligned(no_docs, ta.Settings(A, B)).collect() == []
