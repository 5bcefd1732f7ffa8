"""Quality rules: logistic regression over hashed word and character n-grams.

Method: every text is a bag of hashed word unigrams and bigrams and of byte 3- and 4-grams, each
family taken as relative frequencies. A logistic regression over the 2**18 buckets is trained on a
bounded sample of labelled rows (``Settings.sample``, the only bounded thing), its margin is turned
into a probability by Platt's sigmoid fitted on the fifth of the sample the weights have not seen,
and texts are scored in Arrow batches against fixed thresholds, in one pass with the counted base
rules. Nothing is shuffled but the sample.

Defined cases: null and empty texts have no words, so they fail the base rules; repeated rows are
scored alike; a table without usable labels (none, or one class only) gives the base rules alone
(probability 1). Only ``doc_id``, ``text`` and ``quality`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.frames import bounded_sample
from windrow.llm.registry import query, table
from windrow.llm.textblock import SPACE, Block, blocks, mixed, owners, table_of, windows

SYMBOLS = table_of(b"#*$%&|<>")
REPEATED = 0  # bucket of a word that follows itself


@dataclass(frozen=True)
class Settings:
    sample: int = 2500  # labelled rows the model is fitted on, at most
    bits: int = 18
    steps: int = 80
    rate: float = 0.4
    decay: float = 1e-5
    threshold: float = 0.3  # least probability of quality 1 that is kept
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8


def families(block: Block, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of each n-gram family with the first and last-plus-one index of each text."""
    starts, ends, first = block.words()
    h = block.span_hashes(starts, ends)
    shift = np.uint64(64 - bits)
    single = (h >> shift).astype(np.uint32)
    pairs = (mixed(h[:-1] * np.uint64(3) + h[1:]) >> shift).astype(np.uint32)
    pairs[h[:-1] == h[1:]] = REPEATED
    opening = np.minimum(first[:-1], len(pairs))  # a wordless text after the last word has no pair to begin at
    return [
        (single, first[:-1], first[1:]),
        (pairs, opening, np.maximum(first[1:] - 1, opening)),
        block.grams(3, bits, 1),
        block.grams(4, bits, 2),
    ]


def margins(block: Block, weights: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(block.n)
    for buckets, lo, hi in families(block, bits):
        total = np.zeros(len(buckets) + 1)
        np.cumsum(weights[buckets], out=total[1:])
        out += (total[hi] - total[lo]) / np.maximum(hi - lo, 1)
    return out


def sparse_rows(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compressed rows of relative frequencies: pointers, buckets, values."""
    sizes, cols, vals = [], [], []
    for _, _, block in blocks(texts):
        parts = families(block, bits)
        for d in range(block.n):
            own, weight = [], []
            for buckets, lo, hi in parts:
                k = int(hi[d] - lo[d])
                if k > 0:
                    found, count = np.unique(buckets[lo[d] : hi[d]], return_counts=True)
                    own.append(found)
                    weight.append((count / k).astype(np.float32))
            sizes.append(sum(map(len, own)))
            cols += own
            vals += weight
    ptr = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    empty = [np.zeros(0, np.uint32)], [np.zeros(0, np.float32)]
    return ptr, np.concatenate(cols or empty[0]), np.concatenate(vals or empty[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(texts: pa.Array, labels: np.ndarray, unseen: np.ndarray, s: Settings) -> tuple[np.ndarray, float, float]:
    """Weights, and slope and shift of the calibration fitted on the ``unseen`` rows."""
    ptr, cols, vals = sparse_rows(texts, s.bits)
    row = np.repeat(np.arange(len(labels)), np.diff(ptr))
    seen = ~unseen if (~unseen).any() else np.ones(len(labels), bool)
    share = np.where(labels == 1, 0.5 / max(1, (labels[seen] == 1).sum()), 0.5 / max(1, (labels[seen] == 0).sum())) * seen
    w, m, v = (np.zeros(1 << s.bits) for _ in range(3))
    for step in range(1, s.steps + 1):
        margin = np.bincount(row, vals * w[cols], len(labels))
        slope = share * (sigmoid(margin) - labels)
        g = np.bincount(cols, vals * slope[row], 1 << s.bits) + s.decay * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    margin = np.bincount(row, vals * w[cols], len(labels))
    return w, *calibration(margin[unseen] if unseen.any() else margin, labels[unseen] if unseen.any() else labels)


def calibration(margin: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Platt's sigmoid with his smoothed targets, by Newton steps halved until the loss falls."""
    good, bad = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(float(np.abs(margin).max(initial=0)), 1e-9)
    x = np.stack([margin / scale, np.ones(len(margin))], 1)
    theta = np.array([0.0, np.log((good + 1) / (bad + 1))])
    loss = lambda t: float((np.logaddexp(0, x @ t) - target * (x @ t)).sum())
    for _ in range(steps):
        p = sigmoid(x @ theta)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (p - target))
        size = 1.0
        while size > 1e-9 and loss(theta - size * move) > loss(theta):
            size /= 2
        theta = theta - size * move if size > 1e-9 else theta
        if size <= 1e-9 or np.abs(size * move).max() < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def train(documents: DataFrame, labels: DataFrame, s: Settings) -> tuple[np.ndarray, float, float] | None:
    """Fit in one task on the bounded sample; the driver gets the weights only."""
    chosen = bounded_sample(
        labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", s.sample
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        rows = pd.concat(frames) if frames else pd.DataFrame({"doc_id": [], "text": [], "quality": []})
        rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
        y = rows.quality.to_numpy(float)
        if len(set(y)) == 2:
            unseen = rows.doc_id.to_numpy(np.int64) % 5 == 0
            if len(set(y[unseen])) < 2:
                unseen[:] = False
            w, slope, shift = fit(pa.array(rows.text.tolist(), pa.large_string()), y, unseen, s)
            yield pd.DataFrame({"weights": [w.astype(np.float32).tobytes()], "slope": [slope], "shift": [shift]})

    found = rows.repartition(1).mapInPandas(learn, "weights binary, slope double, shift double").collect()
    return (np.frombuffer(found[0].weights, np.float32).astype(float), found[0].slope, found[0].shift) if found else None


def base_counts(block: Block, window: int) -> dict[str, np.ndarray]:
    """Counts of the base rules per text."""
    starts, ends, first = block.words()
    body = block.buf[: block.size]
    solid = ~SPACE[body]
    h = block.span_hashes(starts, ends)
    doc = owners(first, len(starts))
    where = mixed(np.arange(block.n, dtype=np.uint64) + np.uint64(1))

    lo, hi = block.lines()
    worded = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    lo, hi = lo[worded], hi[worded]
    line_doc = np.searchsorted(block.offs, lo, "right") - 1
    _, kept = np.unique(block.span_hashes(lo, hi) ^ where[line_doc], return_index=True)
    lines = np.bincount(line_doc, minlength=block.n) - np.bincount(line_doc[kept], minlength=block.n)

    run = windows(h, window)
    at = np.flatnonzero(doc[: len(run)] == doc[window - 1 :][: len(run)]) if len(run) else np.zeros(0, int)
    _, back, count = np.unique(run[at] ^ where[doc[at]], return_inverse=True, return_counts=True)
    at = at[count[back] > 1]
    edge = np.zeros(len(h) + 1, np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + window, 1)
    repeated = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=block.n)
    return {
        "n_words": np.diff(first),
        "word_chars": block.per_doc(solid & ((body & 0xC0) != 0x80)),
        "n_symbols": block.per_doc(SYMBOLS[body]),
        "n_dup_lines": lines,
        "n_repeat_words": repeated,
    }


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, quality_prob double"
)


def quality_rules(documents: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """Base counts, calibrated probability of good quality and the verdict for every document."""
    s = s or Settings()
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, s))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi, block in blocks(texts):
                base = base_counts(block, s.window)
                failed = (base["n_words"] < s.min_words) | (100 * base["n_repeat_words"] > s.max_repeat_percent * base["n_words"])
                p = np.ones(block.n)
                if fitted is not None:
                    p = sigmoid(fitted[1] * margins(block, fitted[0], s.bits) + fitted[2])
                columns = [ids.slice(lo, hi - lo).cast(pa.int64()), *(pa.array(v, pa.int64()) for v in base.values())]
                columns += [pa.array(failed), pa.array(~failed & (p >= s.threshold)), pa.array(p)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(score, SCHEMA)


@query()
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts, probability of good quality and verdict of every document."""
    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
