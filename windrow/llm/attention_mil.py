"""Quality classifier: attention-based multiple-instance learning over passages.

Method: a document is a bag of passages of 64 words. Each passage is encoded by a learned layer over
hashed byte trigrams and a few shape figures; gated attention, learned from the document labels alone,
weighs the passages; the weighted sum of the encodings is the document, and a logistic output scores
it. All weights are trained end to end by Adam in NumPy on a bounded sample of labelled rows
(``Settings.sample``). Every passage of every whole text is encoded when scoring, in Arrow batches and
without a shuffle.

Defined cases: null and empty texts are bags of one empty passage and get that bag's score; repeated
rows are scored alike; without labels of both classes every score is the share of label 1, or 1 if
there are no labels. Only ``doc_id``, ``text`` and ``quality`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.frames import bounded_sample, crc_of_id
from windrow.llm.registry import query, table
from windrow.llm.textblock import Block, blocks, give_back, owners, table_of

SYMBOLS = table_of(b"#*$%&|<>!")
UPPER = table_of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = table_of(b"0123456789")
SHAPES = 7


@dataclass(frozen=True)
class Settings:
    sample: int = 2500  # labelled rows the model is fitted on, at most
    folds: int = 5  # rows whose crc32(doc_id) is 0 modulo this are never learned from
    words: int = 64  # words of a passage
    bits: int = 11
    width: int = 16
    gate: int = 8
    epochs: int = 8
    batch: int = 64
    rate: float = 0.01
    threshold: float = 0.3


@dataclass
class Bags:
    """Passages of a block: trigram buckets with owner, shape figures, first passage of each text."""

    buckets: np.ndarray
    passage: np.ndarray
    sizes: np.ndarray
    shapes: np.ndarray
    first: np.ndarray


def bags(block: Block, s: Settings) -> Bags:
    starts, ends, first = block.words()
    n_words = np.diff(first)
    count = np.maximum(1, -(-n_words // s.words))
    begin = np.concatenate([[0], np.cumsum(count)])
    total = int(begin[-1])
    doc = owners(first, len(starts))
    own = begin[doc] + (np.arange(len(starts)) - first[doc]) // s.words
    words = np.bincount(own, minlength=total)
    filled = words > 0
    # an empty passage spans no bytes
    lo, hi = np.zeros(total, np.int64), np.zeros(total, np.int64)
    edge = np.searchsorted(own, np.flatnonzero(filled))
    lo[filled] = starts[edge]
    hi[filled] = ends[edge + words[filled] - 1]

    buckets, _, _ = block.grams(3, s.bits, 3)
    size = np.maximum(hi - lo - 2, 0)
    passage = np.repeat(np.arange(total), size)
    at = np.arange(len(passage)) - np.repeat(np.cumsum(size) - size, size) + lo[passage]

    h = block.span_hashes(starts, ends)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    _, one = np.unique(h ^ (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    body = block.buf[: block.size]

    def share(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags)])
        return (run[hi] - run[lo]) / np.maximum(hi - lo, 1)

    some = np.maximum(words, 1)
    shapes = np.stack(
        [
            np.bincount(own, same, total) / some,
            1 - np.bincount(own[one], minlength=total) / some,
            share(SYMBOLS[body]) * 4,
            share(UPPER[body]) * 2,
            share(DIGIT[body]) * 2,
            (hi - lo) / some / 10,
            words / s.words,
        ],
        1,
    )
    return Bags(buckets[at], passage, size, shapes.astype(np.float32), begin)


def bags_of(texts: list[str], s: Settings) -> Bags:
    """Bags of many texts, made block by block and kept in narrow numbers."""
    parts = []
    for _, _, block in blocks(pa.array(texts, pa.large_string())):
        b = bags(block, s)
        kind = np.uint16 if s.bits <= 16 else np.uint32
        parts.append(Bags(b.buckets.astype(kind), b.passage.astype(np.int32), b.sizes, b.shapes, b.first))
    begin = np.cumsum([0] + [len(b.sizes) for b in parts])
    return Bags(
        np.concatenate([b.buckets for b in parts]), np.concatenate([b.passage + np.int32(lo) for b, lo in zip(parts, begin)]),
        np.concatenate([b.sizes for b in parts]), np.concatenate([b.shapes for b in parts]),
        np.concatenate([[0], *(b.first[1:] + lo for b, lo in zip(parts, begin))]),
    )


def dense(b: Bags, lo: int, hi: int, edge: np.ndarray, bits: int) -> np.ndarray:
    """Root relative bucket frequencies of passages ``lo..hi``, one row each."""
    own = slice(edge[lo], edge[hi])
    flat = ((b.passage[own].astype(np.int64) - lo) << bits) + b.buckets[own]
    x = np.bincount(flat, minlength=(hi - lo) << bits).astype(np.float32).reshape(hi - lo, -1)
    np.sqrt(x, out=x)
    x /= np.sqrt(np.maximum(b.sizes[lo:hi], 1))[:, None].astype(np.float32)
    return x


def start_weights(s: Settings, seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    return {
        "grams": draw(1 << s.bits, s.width) * 4, "shapes": draw(SHAPES, s.width), "bias": np.zeros(s.width, np.float32),
        "tanh": draw(s.width, s.gate), "gate": draw(s.width, s.gate), "attend": draw(s.gate, 1)[:, 0],
        "out": draw(s.width, 1)[:, 0], "shift": np.zeros(1, np.float32),
    }


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def encoded(b: Bags, w: dict[str, np.ndarray], s: Settings, step: int = 512) -> np.ndarray:
    """Encodings of all passages, a few hundred dense rows at a time."""
    edge = np.concatenate([[0], np.cumsum(b.sizes)])
    out = np.empty((len(b.sizes), s.width), np.float32)
    for lo in range(0, len(out), step):
        hi = min(lo + step, len(out))
        out[lo:hi] = dense(b, lo, hi, edge, s.bits) @ w["grams"]
    return np.tanh(out + b.shapes @ w["shapes"] + w["bias"])


def attended(h: np.ndarray, first: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the gate, the attention weights, and the weighted encoding of each text."""
    t, g = np.tanh(h @ w["tanh"]), logistic(h @ w["gate"])
    e = (t * g) @ w["attend"]
    size = np.diff(first)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), size))
    a = e / np.repeat(np.add.reduceat(e, first[:-1]), size)
    return t, g, a, np.add.reduceat(a[:, None] * h, first[:-1], axis=0)


def score_block(block: Block, w: dict[str, np.ndarray], s: Settings) -> np.ndarray:
    b = bags(block, s)
    return logistic(attended(encoded(b, w, s), b.first, w)[3] @ w["out"] + w["shift"]).astype(float)


def gradients(x: np.ndarray, shapes: np.ndarray, first: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the mean log loss of a batch of texts whose passages are the rows of ``x``."""
    h = np.tanh(x @ w["grams"] + shapes @ w["shapes"] + w["bias"])
    t, g, a, z = attended(h, first, w)
    size = np.diff(first)
    d_out = (logistic(z @ w["out"] + w["shift"]) - y) / len(y)
    d_z = np.repeat(d_out[:, None] * w["out"], size, axis=0)
    d_a = (d_z * h).sum(1)
    d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, first[:-1]), size))
    d_gated = d_e[:, None] * w["attend"]
    d_t, d_g = d_gated * g * (1 - t * t), d_gated * t * g * (1 - g)
    d_h = (a[:, None] * d_z + d_t @ w["tanh"].T + d_g @ w["gate"].T) * (1 - h * h)
    return {
        "grams": x.T @ d_h, "shapes": shapes.T @ d_h, "bias": d_h.sum(0), "tanh": h.T @ d_t, "gate": h.T @ d_g,
        "attend": (t * g).T @ d_e, "out": z.T @ d_out, "shift": d_out.sum(keepdims=True),
    }


def fit(texts: list[str], y: np.ndarray, s: Settings, seed: int = 5) -> dict[str, np.ndarray]:
    b = bags_of(texts, s)
    edge = np.concatenate([[0], np.cumsum(b.sizes)])
    w, r = start_weights(s), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    for _ in range(s.epochs):
        order = r.permutation(len(y))
        for at in range(0, len(order), s.batch):
            docs = order[at : at + s.batch]
            x = np.concatenate([dense(b, b.first[d], b.first[d + 1], edge, s.bits) for d in docs])
            shapes = np.concatenate([b.shapes[b.first[d] : b.first[d + 1]] for d in docs])
            first = np.concatenate([[0], np.cumsum(np.diff(b.first)[docs])])
            step += 1
            for k, g in gradients(x, shapes, first, y[docs], w).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                w[k] -= s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in w.items()}


def train(documents: DataFrame, labels: DataFrame, s: Settings) -> dict[str, np.ndarray]:
    """Weights fitted in one task on the bounded sample; only they come to the driver."""
    usable = labels.where(F.col("quality").isin(0, 1) & (crc_of_id(F.col("doc_id")) % s.folds != 0))
    chosen = bounded_sample(usable.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", s.sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    names = list(start_weights(s))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"doc_id": [], "text": [], "quality": []})])
        rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
        y = rows.quality.to_numpy(float)
        if len(set(y)) == 2:
            w = fit([t or "" for t in rows.text], y.astype(np.float32), s)
        else:
            w = {k: np.zeros_like(x) for k, x in start_weights(s).items()}
            w["shift"][:] = 60 * (2 * y.mean() - 1) if len(y) else 60
        del rows
        give_back()
        yield pd.DataFrame({k: [x.tobytes()] for k, x in w.items()})

    row = rows.repartition(1).mapInPandas(learn, ", ".join(f"{k} binary" for k in names)).first()
    start = start_weights(s)
    if row is None:
        w = {k: np.zeros_like(x) for k, x in start.items()}
        w["shift"][:] = 60
        return w
    return {k: np.frombuffer(row[k], np.float32).reshape(start[k].shape) for k in names}


def classified(documents: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    s = s or Settings()
    return _scored(documents, train(documents, labels, s), s)


def _scored(documents: DataFrame, weights: dict[str, np.ndarray], s: Settings) -> DataFrame:
    model = documents.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.columns[:-1]
            for lo, hi, block in blocks(batch.column(batch.num_columns - 1)):
                p = score_block(block, model.value, s)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in kept), pa.array(p), pa.array(p >= s.threshold).cast(pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows = documents.select(F.col("doc_id").cast("long"), (crc_of_id(F.col("doc_id")) % s.folds == 0).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def accepted(documents: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """The documents, all columns as they are, whose predicted quality is 1."""
    s = s or Settings()
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, s))
    at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [score_block(block, model.value, s) >= s.threshold for _, _, block in blocks(batch.column(at))]
            if verdicts:
                yield batch.filter(pa.array(np.concatenate(verdicts)))

    return documents.mapInArrow(keep, documents.schema)


@query()
def op5_attention_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document by attention over its passages."""
    return classified(table(spark, folder, "documents"), table(spark, folder, "labels"))
