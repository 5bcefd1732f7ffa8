import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node string, score double, n int"
LONG = " ".join(f"w{k % 700}" for k in range(30_000))


def crc(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def rows_of(texts, lang="en", start=1):
    return [(start + k, t, lang, f"s{k % 3}", None, 1, "x", 0.5, 2) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def crc_of():
    return crc


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with names inside the operators."""

    def make(rows):
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def messy_rows():
    """Null ids and texts, empty and odd texts, one very long, ties and repeated rows."""
    r = random.Random(5)
    prose = [" ".join(r.choice("alpha beta gamma delta the of to and Zug Haus".split()) for _ in range(r.randint(1, 60))) for _ in range(12)]
    odd = [None, "", " ", "\n\n \t", "one", "É É É", "a b c d", " lead and trail \n", "x" * 3000, "日本語 テキスト", "a\nb\na\nb\na", LONG]
    rows = rows_of(prose + odd)
    rows.append((None, "no id here at all", None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None))
    return rows + [rows[3], rows[3], rows[12]]


@pytest.fixture(scope="session")
def messy(make_docs, messy_rows):
    return make_docs(messy_rows)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
