"""Packing: bounded-space online packing into sequences of a fixed length.

Method: every task reads its documents in order and keeps a fixed number of open windows. A document
of a full window or more gives full sequences; its rest goes into the open window it fills best; when
it fits none and no more windows may be opened, the fullest one is emitted. At the end of a task its
open windows are left over; leftovers of a few tasks at a time are merged (largest piece first, best
fit) and what stays open goes to the next level, until one group is left. A group is bounded by tasks
merged x open windows, whatever the input; there are as many levels as the logarithm of the tasks.

The pieces of each level are written to a table, so a lost executor repeats its tasks only and ids of
sequences never change afterwards. Defined cases: a null or empty text is one piece with the end id
alone; repeated rows are packed once each; no documents, no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.frames import stored
from windrow.llm.registry import query, table
from windrow.llm.tokens import encoded, known_path

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
ROWS = PIECE + ", sequence_id long, offset long, open boolean, part long"
NAMES = [c.split()[0] for c in ROWS.split(", ")]


@dataclass(frozen=True)
class Settings:
    tokenizer: str = ""  # path of the tokenizer file
    end: int = 1
    length: int = 2048
    windows: int = 32  # open windows of a task
    merged: int = 16  # tasks whose leftovers are merged together
    spaced: bool = False  # whether the tokenizer has ids for white space


@dataclass
class Packer:
    """Open windows of one task. ``rows`` collects the pieces of windows that are done."""

    s: Settings
    base: int
    next: int = 0
    windows: list[list] = field(default_factory=list)  # [tokens, pieces]
    rows: list[tuple] = field(default_factory=list)

    def emit(self, window: list, left: bool, part: int) -> None:
        at = 0
        for piece in window[1]:
            self.rows.append((*piece, self.base + self.next, at, left, part))
            at += piece[2]
        self.next += 1

    def place(self, piece: tuple, part: int) -> None:
        size, best, fullest = piece[2], None, None
        for w in self.windows:
            if w[0] + size <= self.s.length and (best is None or w[0] > best[0]):
                best = w
            if fullest is None or w[0] > fullest[0]:
                fullest = w
        if best is None:
            if len(self.windows) >= self.s.windows:
                self.emit(fullest, False, part)
                self.windows.remove(fullest)
            best = [0, []]
            self.windows.append(best)
        best[0] += size
        best[1].append(piece)
        if best[0] == self.s.length:
            self.emit(best, False, part)
            self.windows.remove(best)

    def close(self, left: bool, part: int) -> None:
        for w in self.windows:
            self.emit(w, left, part)
        self.windows = []

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pieces(doc_id: int | None, ids: np.ndarray, length: int) -> Iterator[tuple]:
    body, n = ids.astype("<u4"), len(ids)
    for at in range(0, n, length):
        part = body[at : at + length]
        yield doc_id, at, len(part), zlib.crc32(part.tobytes()), n


def packed(documents: DataFrame, s: Settings) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(s, part << 32)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, tokens in encoded(batch.column(1), s.tokenizer, s.spaced, s.end):
                for piece in pieces(ids[row], tokens, s.length):
                    packer.place(piece, part)
            yield batch_of(packer.taken())
        packer.close(True, part)
        yield batch_of(packer.taken())

    schema = pa.schema([(c.split()[0], pa.bool_() if c.endswith("boolean") else pa.int64()) for c in ROWS.split(", ")])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def merge(level: int, last: bool):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            group = int(rows["part"].iloc[0]) // s.merged
            packer = Packer(s, (level << 58) | (group << 32))
            order = rows.sort_values(["length", "doc_id", "start", "ids_crc32", "sequence_id", "offset"], ascending=[False] + [True] * 5)
            # all windows may stay open while pieces are placed; the fullest are emitted at the end
            wide = Packer(Settings(s.tokenizer, s.end, s.length, 1 << 62), packer.base)
            for r in order[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype(object).itertuples(index=False):
                wide.place(tuple(None if pd.isna(x) else int(x) for x in r), group)
            wide.windows.sort(key=lambda w: -w[0])
            stay = 0 if last else s.windows
            for k, w in enumerate(wide.windows):
                wide.emit(w, k >= len(wide.windows) - stay, group)
            out = pd.DataFrame(wide.rows, columns=NAMES)
            return out.astype({n: "Int64" for n in NAMES if n != "open"})

        return run

    rows = stored(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, ROWS), "packed")
    done, level = [rows.where(~F.col("open"))], 1
    top = rows.agg(F.max("part")).first()[0] or 0
    while True:
        last = top < s.merged
        left = rows.where(F.col("open")).withColumn("group", F.expr(f"part div {s.merged}"))
        rows = stored(left.groupBy("group").applyInPandas(merge(level, last), ROWS), "packed")
        done.append(rows.where(~F.col("open")))
        if last:
            break
        top, level = top // s.merged, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open", "part")


@query()
def op9_open_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packed(table(spark, folder, "documents"), Settings(known_path("word_bpe_49k.json")))
