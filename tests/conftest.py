import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from windrow.session import local_session

    s = local_session(8, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def windows(spark):
    """Window frames: ``windows({"a": "0110"}, length, stride)`` with the string as predictions."""

    def make(records, length=10.0, stride=10.0, skip=(), subject=None, source="s", labels=None):
        rows = []
        for rid, marks in records.items():
            for i, m in enumerate(marks):
                if (rid, i) in skip:
                    continue
                label = int((labels or {}).get(rid, marks)[i])
                rows.append(
                    (rid, subject or rid, i, i * stride, i * stride + length, label, m == "1", float(m == "1"), source)
                )
        return spark.createDataFrame(
            rows,
            "record_id string, subject_id string, window_idx int, t_start_sec double, t_end_sec double, "
            "label int, pred boolean, score double, source string",
        )

    return make


@pytest.fixture
def truth(spark):
    def make(spans):
        rows = [(r, i, a, b) for r, list_ in spans.items() for i, (a, b) in enumerate(list_, 1)]
        return spark.createDataFrame(rows, "record_id string, seizure_idx long, start_sec long, end_sec long")

    return make
