"""Binary annotation files: 16-bit words that mark interval onsets and offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.fixed_values import (
    ANNOTATION_CODES as CODE,
)
from windrow.fixed_values import ANNOTATION_DEFAULT_HZ, ANNOTATION_RATE_PATTERN
from windrow.functions.text import strip_edf

SCHEMA = (
    "path string, seizure_idx long, start_sample long, end_sample long, hz double, error string"
)
PAYLOAD = (CODE["SUB"], CODE["CHN"], CODE["NUM"], CODE["AUX"])


def marks(content: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Clock rate and the (code, sample) marks of one file, up to its end word."""
    words = np.frombuffer(content, "<u2", count=len(content) // 2)
    hz, clock, at, found = ANNOTATION_DEFAULT_HZ, 0, 0, []
    while at < len(words):
        code, value = int(words[at]) >> 10, int(words[at]) & 1023
        at += 1
        if code == CODE["END"] and value == 0:
            break
        if code == CODE["SKIP"]:
            if at + 2 > len(words):
                raise ValueError("the file ends inside a skip")
            high, low = words[at : at + 2]
            clock += int(np.int16(high)) * 65536 + int(low)
            at += 2
        elif code == CODE["AUX"]:
            text = content[2 * at : 2 * at + value].decode("ascii", "replace")
            rate = re.search(ANNOTATION_RATE_PATTERN, text)
            hz = float(rate.group(1)) if rate else hz
            at += (value + 1) // 2
        elif code not in PAYLOAD:
            clock += value
            if code in (CODE["ONSET"], CODE["OFFSET"]):
                found.append((code, clock))
    return hz, found


def spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Onset and offset marks paired; they must alternate and move forward."""
    if len(found) % 2 and found[-1][0] == CODE["ONSET"]:
        raise ValueError(f"unterminated onset at sample {found[-1][1]}")
    out = []
    for (c0, s0), (c1, s1) in zip(found[::2], found[1::2]):
        if c0 != CODE["ONSET"] or c1 != CODE["OFFSET"]:
            raise ValueError(f"onset and offset do not alternate at sample {s0}")
        if s1 <= s0:
            raise ValueError(f"offset {s1} <= onset {s0}")
        out.append((s0, s1))
    if len(found) % 2:
        raise ValueError(f"offset without onset at sample {found[-1][1]}")
    return out


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                hz, found = marks(bytes(content))
                rows += [
                    (path, i, a, b, hz, None) for i, (a, b) in enumerate(spans(found), start=1)
                ]
            except ValueError as e:
                rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
        out = pd.DataFrame(rows, columns=["path", "seizure_idx", "start_sample", "end_sample", "hz", "error"])
        yield out.astype({"seizure_idx": "Int64", "start_sample": "Int64", "end_sample": "Int64", "hz": "Float64"})


def annotation_files(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.seizures")
        .load(root)
        .select("path", "content")
    )


def decode_annotations(files: DataFrame) -> DataFrame:
    """Sample intervals per file; a malformed file becomes one row with its error."""
    return files.select("path", "content").mapInPandas(_decode, SCHEMA)


def annotation_seconds(decoded: DataFrame) -> DataFrame:
    """Intervals in whole seconds, halves to even as in the other source."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.seizures$", "")
    second = lambda c: F.bround(F.col(c) / F.col("hz"), 0).cast("long")
    return decoded.where("error IS NULL").select(
        strip_edf(name).alias("record_id"),
        "seizure_idx",
        second("start_sample").alias("start_sec"),
        second("end_sample").alias("end_sec"),
    )
