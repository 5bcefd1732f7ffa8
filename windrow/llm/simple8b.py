"""Token-ID output: Simple-8b word-aligned coding in a table of blocks.

File format: a Parquet folder; every row is a block of whole documents in ascending ``doc_id`` order.

    part      long          rank of the range of ids the block belongs to
    first     long          ids of the part before the block
    doc_ids   array<long>   documents of the block
    lengths   array<long>   ids of each, end id included
    words     binary        little-endian 64-bit words
    offsets   binary        little-endian 32-bit word index at which each run of ``RUN`` ids begins

A word has a selector in its top 4 bits and 60 bits of payload: ``COUNTS[s]`` ids of ``WIDTHS[s]`` bits,
the first lowest. Selector ``ESCAPE`` announces one id over 60 bits wide, which follows as a plain word.
Each run of 1024 ids starts a new word, so a reader decodes any run alone, and all runs at once.

Documents are dealt out by ranges of ``doc_id`` and sorted inside; texts are encoded after that, so
ids are never shuffled. Ids before a part come from the sums of parts (one row per part). Defined
cases: a null or empty text is the end id alone; a null ``doc_id`` sorts first; repeated rows are written
each, ordered by text; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.llm.frames import new_folder
from windrow.llm.registry import query, table
from windrow.llm.tokens import encoded, known_path

# Fixed values of the published code: ids per word and bits per id, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 14
RUN = 1024

BLOCK = pa.schema(
    [("part", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
     ("words", pa.binary()), ("offsets", pa.binary())]
)
BLOCK_SQL = "part long, first long, doc_ids array<long>, lengths array<long>, words binary, offsets binary"


@dataclass(frozen=True)
class Settings:
    tokenizer: str = ""
    end: int = 2
    block: int = 1 << 16  # ids after which a block is closed


def limit(s: int) -> np.uint64:
    """The least id too wide for selector ``s``."""
    return np.uint64(1 << int(WIDTHS[s]))


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids, and the word at which each run begins. All runs are walked side by side."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    run_start = np.arange(0, n, RUN)
    run_end = np.minimum(run_start + RUN, n)
    index = np.arange(n)
    left = np.minimum((index // RUN + 1) * RUN, n) - index
    choice = np.full(n, ESCAPE, np.int8)
    for s in range(len(COUNTS) - 1, -1, -1):
        narrow = ids < limit(s)
        few = np.count_nonzero(narrow)
        if few == n:
            choice[left >= COUNTS[s]] = s
            continue
        if 4 * few < n:  # runs of the few narrow ids
            at = np.flatnonzero(narrow)
            last = np.flatnonzero(np.append(np.diff(at) != 1, True)[: len(at)])
            ahead = at[last][np.searchsorted(last, np.arange(len(at)))] - at + 1
            choice[at[(ahead >= COUNTS[s]) & (left[at] >= COUNTS[s])]] = s
            continue
        wide = np.zeros(n + 1, np.int32)
        np.cumsum(~narrow, out=wide[1:])
        end = np.minimum(index + COUNTS[s], n)
        choice[(left >= COUNTS[s]) & (wide[end] == wide[:-1])] = s
    step = np.append(COUNTS, 1)
    at, stop, taken = run_start, run_end, []
    while len(at):
        taken.append(at)
        at = at + step[choice[at]]
        inside = at < stop
        at, stop = at[inside], stop[inside]
    where = np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
    chosen = choice[where]
    escaped = chosen == ESCAPE
    place = np.arange(len(where)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(where) + int(escaped.sum()), np.uint64)
    for s in range(len(COUNTS)):
        own = np.flatnonzero(chosen == s)
        word = np.full(len(own), np.uint64(s) << np.uint64(60))
        for k in range(COUNTS[s]):
            word |= ids[where[own] + k] << np.uint64(k * WIDTHS[s])
        words[place[own]] = word
    words[place[escaped]] = np.uint64(ESCAPE) << np.uint64(60)
    words[place[escaped] + 1] = ids[where[escaped]]
    return words, place[np.searchsorted(where, run_start)].astype(np.uint32)


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of whole runs of words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    plain = np.zeros(len(words), bool)
    for k in np.flatnonzero(selector == ESCAPE):
        if not plain[k]:
            plain[k + 1] = True
    marker = (selector == ESCAPE) & ~plain
    size = np.append(COUNTS, [0, 0])[selector]
    size[plain], size[marker] = 1, 0
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    out[start[plain]] = words[plain]
    for s in range(len(COUNTS)):
        own = np.flatnonzero((selector == s) & ~plain)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[start[own] + k] = (words[own] >> np.uint64(k * WIDTHS[s])) & mask
    return out


def run_of(words: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The ids of run ``k`` alone."""
    end = int(offsets[k + 1]) if k + 1 < len(offsets) else len(words)
    return unpack(words[int(offsets[k]) : end])


def write(documents: DataFrame, folder: str, s: Settings) -> None:
    """Write the ids of all documents into ``folder``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = size = 0
        names, parts = [], []

        def block() -> pa.RecordBatch:
            words, offsets = pack(np.concatenate(parts))
            row = [part, first, names, [len(p) for p in parts], words.astype("<u8").tobytes(), offsets.astype("<u4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK)], schema=BLOCK)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, tokens in encoded(batch.column(1), s.tokenizer, True, s.end):
                names.append(ids[row])
                parts.append(tokens)
                size += len(tokens)
                if size >= s.block:
                    yield block()
                    first, size = first + size, 0
                    names, parts = [], []
        if names:
            yield block()

    rows = documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
    rows.sortWithinPartitions("doc_id", "text").mapInArrow(encode, BLOCK_SQL).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of ``folder``."""
    stored = spark.read.schema(BLOCK_SQL).parquet(folder)
    schema = "part long, doc_id long, start long, n_tokens long, ids_crc32 long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8")).astype("<u4").tobytes()
                lengths = np.array(row["lengths"], np.int64)
                edge = np.concatenate([[0], np.cumsum(lengths)])
                check = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(lengths), pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(edge[:-1] + row["first"]), pa.array(lengths), pa.array(check, pa.int64())],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    sums = stored.groupBy("part").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return stored.mapInArrow(decode, schema).join(before, "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


@query()
def op3_simple8b(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids written to Simple-8b files and read back, per document."""
    target = new_folder(spark, "simple8b")
    write(table(spark, folder, "documents"), target, Settings(known_path("byte_bpe_50k.json")))
    return read(spark, target)
