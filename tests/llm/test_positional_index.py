import collections
import hashlib
import random
import re

import pytest

from windrow.llm import positional_index as pi

LOWER = str.maketrans(pi.UPPER, pi.UPPER.lower())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items):
    w, hit, names = words(text), set(), set()
    for name, body in items:
        x = words(body)
        size = min(10, len(x))
        for window in {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if x else ():
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) == window:
                    hit.update(range(i, i + size))
                    names.add(name)
    listed = ",".join(sorted(str(n) for n in names if n is not None))
    return len(w), len(hit), sum(n is not None for n in names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items():
    r = random.Random(8)
    vocabulary = [f"t{k}" for k in range(60)] + ["the", "of", "É"]
    return [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(10, 30)))) for k in range(12)] + [
        (12, "the the the the the the the the the the the the"), (13, "Two words"), (14, "one"), (15, ""), (16, None),
        (None, "nameless item of its own " * 3), (13, "Two words"), (2, "a second text under the same id for good measure yes"),
    ]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def contaminated_rows(items):
    r = random.Random(9)
    texts = []
    for k in range(30):
        body = words(r.choice(items[:12])[1])
        at = r.randrange(len(body) - 9)
        middle = body[at : at + r.randint(8, 14)]
        if k % 5 == 0:
            middle[4] = "changed"
        texts.append("Before, " * r.randint(0, 3) + " ".join(middle).upper().replace(" ", r.choice([" ", "-", "\n"])) + ". After")
    texts += ["the " * 30, "two WORDS two words", "x two-words", "one", "nameless item of its own " * 4, items[0][1] + " " + items[0][1]]
    return [(100 + k, t, "en", "s", None, 0, "", 0.0, 0) for k, t in enumerate(texts)]


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, *r[1:6]) for r in df.collect()))


@pytest.mark.parametrize("rarest", [1, 2, 3])
def test_equals_brute_force(messy_rows, make_docs, items, benchmark, rarest):
    source = messy_rows + contaminated_rows(items)
    got = rows_of(pi.contaminated(make_docs(source), benchmark, pi.Settings(rarest=rarest)))
    assert got == sorted((r[0] is None, r[0] or 0, *brute(r[1], items)) for r in source)


def test_stage_keeps_clean_rows_as_they_are(messy_rows, make_docs, items, benchmark):
    source = messy_rows + contaminated_rows(items)
    kept = pi.clean(make_docs(source), benchmark)
    want = collections.Counter(tuple(r) for r in source if not brute(r[1], items)[4])
    assert collections.Counter(tuple(r) for r in kept.collect()) == want


def test_near_matches_are_counted(make_docs, spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    # the second text makes the changed word a frequent one, so rarer ones are looked up
    texts = [item.replace("gamma", "other"), "gamma " * 50]
    docs = make_docs([(k, t, "en", "s", None, 0, "", 0.0, 0) for k, t in enumerate(texts)])
    got = pi.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.contaminated, r.n_near) for r in got) == [(0, False, 1), (1, False, 0)]


def test_empty_tables(messy, messy_rows, no_docs, benchmark, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert pi.contaminated(no_docs, benchmark).count() == 0
    got = pi.contaminated(messy, none).collect()
    assert len(got) == len(messy_rows) and not any(r.contaminated for r in got)


def test_only_dataframe_functions(messy, benchmark):
    plan = pi.contaminated(messy, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
