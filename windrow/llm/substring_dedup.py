"""Substring deduplication by difference-cover anchors.

Method: ``COVER`` is a difference cover of the residues modulo ``PERIOD``: for any two positions some shift
below the period brings both onto cover positions. A window of 13 words holds a run of 7 words at each
shift, so any two equal windows share an *aligned* anchor, a run of 7 words that begins at a cover position
of both documents. Only these runs (three of seven positions) are hashed and looked for corpus-wide. Around
anchors that two documents share, the match is extended: the whole windows there are hashed and the smallest
document of each is found.

Texts lie in buckets of a few MB, stored once. A bucket sends its distinct hashes, cut by their leading bits
into parts, and gets one bit back for each, in the order sent; so no hash, however common, has more rows than
there are buckets, and what goes back is an eighth of a byte per hash. A part is judged by one task at a time, so
parts grow in number and not in size. Anchors travel as 32 bits after the
part's own: a chance agreement only has windows compared that would not need it. Windows travel as 64 bits;
two different windows agree with a chance of 2**-64.

Defined cases: a null text has no words; texts shorter than a window lose nothing; a null ``doc_id`` is not
compared with any, so nothing is removed from or because of it; rows of equal ``doc_id`` are not smaller than
each other, so repeated rows keep or lose the same words; an empty table gives no rows. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.memory import give_back
from windrow.llm.frames import new_folder, stored
from windrow.llm.registry import query, table
from windrow.llm.textblock import blocks, owners, windows

PERIOD = 7
COVER = (0, 1, 3)  # every difference modulo 7 lies between two of these
BUCKET_SQL = "bucket long, doc_ids array<long>, sizes array<long>, body binary"
BUCKET = pa.schema(
    [("bucket", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("body", pa.large_binary())]
)
RESULT_SQL = "doc_id long, n_words long, n_removed long, kept string"


@dataclass(frozen=True)
class Settings:
    window: int = 13
    bucket: int = 4 << 20  # bytes of text after which a bucket is closed
    part: int = 8 << 20  # bytes of text whose hashes one part holds at most, on average
    parts: int = 64  # at least so many parts, a power of two

    @property
    def anchor(self) -> int:
        return self.window - PERIOD + 1

    def bits(self, size: int) -> int:
        """Leading bits of a hash that name its part, for so many bytes of text."""
        return max(self.parts - 1, size // self.part).bit_length()


def single(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Buckets one at a time, their bodies unpacked; what a worker does not hold any more goes back between them."""
    for batch in batches:
        for k in range(len(batch)):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row | {"body": pa.decompress(row["body"], sum(row["sizes"]), "zstd", asbytes=True)}
            give_back()


def bucketed(documents: DataFrame, s: Settings) -> DataFrame:
    """The texts in stored buckets, one row each; bodies stay compressed wherever Spark holds or shuffles them."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, bodies, size = [], [], 0

        def row() -> pa.RecordBatch:
            cells = [number, ids, [len(b) for b in bodies], pa.compress(b"".join(bodies), "zstd", asbytes=True)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(cells, BUCKET)], schema=BUCKET)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for k, text in enumerate(pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")):
                ids.append(names[k])
                bodies.append(text.as_py())
                size += len(bodies[-1])
                if size >= s.bucket:
                    yield row()
                    number, ids, bodies, size = number + 1, [], [], 0
        if ids:
            yield row()

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    folder = new_folder(documents.sparkSession, "buckets")
    rows.mapInArrow(gather, BUCKET_SQL).write.option("compression", "zstd").parquet(folder)
    return documents.sparkSession.read.schema(BUCKET_SQL).parquet(folder)


class Bucket:
    """Word hashes of a bucket's texts: which document and which place of it each word has."""

    def __init__(self, row: dict, s: Settings):
        self.s, self.key = s, row["bucket"]
        ids = row["doc_ids"]
        self.named = np.array([k is not None for k in ids], bool)
        self.ids = np.array([0 if k is None else k for k in ids], np.int64)
        self.names, self.body = ids, row["body"]
        self.edge = np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))])
        texts = pa.Array.from_buffers(
            pa.large_binary(), len(ids), [None, pa.py_buffer(self.edge.astype("<i8").tobytes()), pa.py_buffer(self.body)]
        ).cast(pa.large_string())
        hashes, own, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, _, block in blocks(texts):
            starts, ends, first = block.words()
            hashes.append(block.span_hashes(starts, ends))
            mine = owners(first, len(starts))
            own.append(mine + lo)
            place.append(np.arange(len(starts)) - first[:-1][mine])
        self.hashes, self.own, self.place = map(np.concatenate, (hashes, own, place))

    def inside(self, n: int) -> np.ndarray:
        """Whether ``n`` words of one named document begin at each word from which ``n`` words are left."""
        m = max(len(self.own) - n + 1, 0)
        return (self.own[:m] == self.own[n - 1 :][:m]) & self.named[self.own[:m]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words at which anchors begin; the distinct anchors, ascending; the number of each word's anchor."""
        n = self.s.anchor
        begins = self.inside(n) & np.isin(self.place[: max(len(self.own) - n + 1, 0)] % PERIOD, COVER)
        at = np.flatnonzero(begins)
        distinct, back = np.unique(windows(self.hashes, n)[at], return_inverse=True)
        return at, distinct, back

    def shared(self, at: np.ndarray, n: int, back: np.ndarray) -> np.ndarray:
        """Which of ``n`` distinct anchors several documents of this bucket hold."""
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, back, self.ids[self.own[at]])
        np.maximum.at(high, back, self.ids[self.own[at]])
        return low < high

    def candidates(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words at which windows around live anchors begin; distinct windows; each word's window; smallest id."""
        at, _, back = self.anchors()
        n = self.s.window
        inside = self.inside(n)
        hit = np.zeros(len(self.own) + 1, np.int64)
        hit[1:][at[live[back]]] = 1
        total = np.cumsum(hit)
        m = len(inside)
        near = total[PERIOD:][:m] > total[:m] if m else np.zeros(0, bool)
        begin = np.flatnonzero(inside & near)
        distinct, back = np.unique(windows(self.hashes, n)[begin], return_inverse=True)
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(low, back, self.ids[self.own[begin]])
        return begin, distinct, back, low

    def covered(self, live: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Whether each word is to be removed, given the bits of both rounds."""
        begin, _, back, low = self.candidates(live)
        repeated = begin[earlier[back] | (low[back] < self.ids[self.own[begin]])]
        step = np.zeros(len(self.own) + 1, np.int64)
        np.add.at(step, repeated, 1)
        np.add.at(step, repeated + self.s.window, -1)
        return np.cumsum(step)[:-1] > 0


def sliced(distinct: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Part, begin and end of the ascending hashes of each part that has some."""
    part = (distinct >> np.uint64(64 - bits)).astype(np.int64)
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    return list(zip(part[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(part)]))


def packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def joined(parts: list[dict] | None, distinct: np.ndarray, bits: int) -> np.ndarray:
    """The bits of all parts of a bucket, one for each of its distinct hashes."""
    got = {p["part"]: p["flags"] for p in parts or []}
    cut = [np.unpackbits(np.frombuffer(got[p], np.uint8), count=z - a) for p, a, z in sliced(distinct, bits)]
    return np.concatenate(cut).astype(bool) if cut else np.zeros(0, bool)


def returned(spark: SparkSession, sent: DataFrame, judge, name: str) -> DataFrame:
    """Judge each part's hashes over all buckets; ``bucket, <name>``: the flags of a bucket's parts."""

    def one_part(t: pa.Table) -> pa.Table:
        found = judge(t)
        give_back()
        return found

    flags = sent.groupBy("part").applyInArrow(one_part, "bucket long, part long, flags binary")
    return stored(flags.groupBy("bucket").agg(F.collect_list(F.struct("part", "flags")).alias(name)), name)


def per_bucket(table: pa.Table, distinct: np.ndarray, sizes: list[int]) -> pa.Table:
    """Flags over all hashes of a part, cut by bucket."""
    edge = np.concatenate([[0], np.cumsum(sizes)])
    cut = [packed(distinct[a:z]) for a, z in zip(edge[:-1], edge[1:])]
    return pa.table({"bucket": table["bucket"], "part": table["part"], "flags": pa.array(cut, pa.binary())})


def live_anchors(table: pa.Table) -> pa.Table:
    """An anchor is live if two documents of a bucket or two buckets hold it."""
    arrays = [np.frombuffer(v.as_buffer(), "<u4") for v in table["hashes"]]
    shared = [np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8), count=len(a)) for v, a in zip(table["shared"], arrays)]
    _, back, many = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    return per_bucket(table, (many > 1)[back] | np.concatenate(shared).astype(bool), [len(a) for a in arrays])


def earlier_windows(table: pa.Table) -> pa.Table:
    """Whether another bucket holds the window in a document with a smaller id."""
    arrays = [np.frombuffer(v.as_buffer(), "<u8") for v in table["hashes"]]
    low = np.concatenate([np.frombuffer(v.as_buffer(), "<i8") for v in table["low"]])
    _, back = np.unique(np.concatenate(arrays), return_inverse=True)
    first = np.full(int(back.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, back, low)
    return per_bucket(table, first[back] < low, [len(a) for a in arrays])


def deduplicated(documents: DataFrame, s: Settings | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every document: what stays, words joined by one space."""
    s = s or Settings()
    spark = documents.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max(s.bucket, 4 << 20)))  # a row is a bucket: one or two at a time
    buckets = bucketed(documents, s)
    size = buckets.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")).alias("n")).head()["n"] or 0  # one row
    bits = s.bits(size)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single(batches):
            b = Bucket(row, s)
            at, distinct, back = b.anchors()
            shared = b.shared(at, len(distinct), back)
            low = ((distinct << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
            cut = sliced(distinct, bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.key] * len(cut), pa.int64()), pa.array([p for p, _, _ in cut], pa.int64()),
                 pa.array([low[a:z].tobytes() for _, a, z in cut], pa.binary()),
                 pa.array([packed(shared[a:z]) for _, a, z in cut], pa.binary())],
                ["bucket", "part", "hashes", "shared"],
            )

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single(batches):
            b = Bucket(row, s)
            _, distinct, _, low = b.candidates(joined(row["live"], b.anchors()[1], bits))
            cut = sliced(distinct, bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.key] * len(cut), pa.int64()), pa.array([p for p, _, _ in cut], pa.int64()),
                 pa.array([distinct[a:z].astype("<u8").tobytes() for _, a, z in cut], pa.binary()),
                 pa.array([low[a:z].astype("<i8").tobytes() for _, a, z in cut], pa.binary())],
                ["bucket", "part", "hashes", "low"],
            )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single(batches):
            b = Bucket(row, s)
            live = joined(row["live"], b.anchors()[1], bits)
            gone = b.covered(live, joined(row["earlier"], b.candidates(live)[1], bits))
            first = np.searchsorted(b.own, np.arange(len(b.ids) + 1))
            lost = np.add.reduceat(np.append(gone, False), first[:-1]) * (first[1:] > first[:-1]) if len(b.ids) else first[:0]
            step = max(1, int(len(b.ids) * (1 << 20) // max(len(b.body), 1)))
            for lo in range(0, len(b.ids), step):
                kept = []
                for d in range(lo, min(lo + step, len(b.ids))):
                    words = b.body[b.edge[d] : b.edge[d + 1]].split()
                    kept.append(b" ".join(compress(words, ~gone[first[d] : first[d + 1]]) if lost[d] else words))
                hi = lo + len(kept)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.names[lo:hi], pa.int64()), pa.array(np.diff(first)[lo:hi], pa.int64()),
                     pa.array(lost[lo:hi], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    anchors = buckets.mapInArrow(send_anchors, "bucket long, part long, hashes binary, shared binary")
    live = returned(spark, anchors, live_anchors, "live")
    lit = buckets.join(live, "bucket", "left")
    found = lit.mapInArrow(send_windows, "bucket long, part long, hashes binary, low binary")
    earlier = returned(spark, found, earlier_windows, "earlier")
    return lit.join(earlier, "bucket", "left").mapInArrow(keep, RESULT_SQL)


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS run
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT run, min(doc_id) AS first FROM runs GROUP BY run),
gone AS (
  SELECT r, list(DISTINCT p) AS places FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM runs JOIN firsts USING (run) WHERE first < doc_id)
  GROUP BY r),
words AS (SELECT r, doc_id, w, coalesce(places, []) AS places FROM docs LEFT JOIN gone USING (r)),
cut AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS kept
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM docs) t
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT r AS q, unnest(places) AS p FROM gone) g WHERE g.q = t.r AND g.p = t.p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN cut USING (r)
"""


@query(ORACLE)
def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of windows that an earlier document holds too are removed, per document."""
    return deduplicated(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
