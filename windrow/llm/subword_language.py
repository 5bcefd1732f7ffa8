"""Language ID: averaged hashed subword embeddings with a linear softmax.

Method: a text is the mean of the embeddings of its hashed words and byte 2-, 3- and 4-grams (lower
case); a linear softmax over that mean names the language. Both tables are trained by stochastic
gradient descent in NumPy on a bounded sample of documents (``Settings.sample``), each seen whole and
as a short excerpt. A temperature fitted on the sampled documents that the descent has not seen
calibrates the probability; a text whose best probability is below ``reject_below`` is rejected.
For scoring, embeddings times softmax weights make one small table, so a whole text costs one look-up
per subword.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and is rejected; repeated
rows are scored alike; without any labelled text every text is ``und``. Only ``doc_id``, ``text`` and,
for learning, ``lang`` are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.frames import bounded_sample, crc_of_id
from windrow.llm.registry import query, table
from windrow.llm.textblock import Block, blocks, table_of

UNKNOWN = "und"
LATIN = table_of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Settings:
    sample: int = 3000  # documents the model is fitted on, at most
    folds: int = 4
    held_out: int = 2  # rows whose crc32(doc_id) leaves this remainder are never learned from
    bits: int = 15
    width: int = 16
    epochs: int = 5
    batch: int = 32
    rate: float = 2.0
    excerpt: int = 12  # words of the short excerpts
    reject_below: float = 0.5


def subwords(block: Block, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    starts, ends, first = block.words()
    words = (block.span_hashes(starts, ends) >> np.uint64(64 - bits)).astype(np.uint32)
    return [(words, first[:-1], first[1:]), *(block.grams(n, bits, 10 + n) for n in (2, 3, 4))]


def logits(block: Block, weights: np.ndarray, bits: int) -> np.ndarray:
    """Mean over all subwords of their rows of ``weights``."""
    out = np.zeros((block.n, weights.shape[1]))
    count = np.zeros(block.n)
    for buckets, lo, hi in subwords(block, bits):
        count += hi - lo
        for k in range(weights.shape[1]):
            run = np.zeros(len(buckets) + 1)
            np.cumsum(weights[:, k][buckets], out=run[1:])
            out[:, k] += run[hi] - run[lo]
    return out / np.maximum(count, 1)[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def lettered(texts: pa.Array, lo: int, block: Block) -> np.ndarray:
    """Whether each text of the block has a letter; only texts without Latin ones are looked at singly."""
    found = block.per_doc(LATIN[block.buf[: block.size]]) > 0
    for d in np.flatnonzero(~found & (np.diff(block.offs) > 0)):
        found[d] = any(c.isalpha() for c in texts[lo + int(d)].as_py())
    return found


def excerpt(text: str, words: int, r: np.random.Generator) -> str:
    parts = text.split()
    at = int(r.integers(0, max(1, len(parts) - words + 1)))
    return " ".join(parts[at : at + words])


def fit(texts: list[str], langs: list[str], unseen: np.ndarray, s: Settings, seed: int = 11) -> dict:
    """Names, table of subword logits, and temperature."""
    r = np.random.default_rng(seed)
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    lowered = [t.lower() for t in texts]
    short = [excerpt(t, s.excerpt, r) for t in lowered]
    cells, values, ptr = [], [], [0]
    for _, _, block in blocks(pa.array(lowered + short, pa.large_string())):
        parts = subwords(block, s.bits)
        for d in range(block.n):
            own = np.concatenate([b[lo[d] : hi[d]] for b, lo, hi in parts])
            found, count = np.unique(own, return_counts=True)
            cells.append(found)
            values.append((count / max(1, len(own))).astype(np.float32))
            ptr.append(ptr[-1] + len(found))
    cells, values, ptr = np.concatenate(cells), np.concatenate(values), np.array(ptr)
    y2, unseen2 = np.tile(y, 2), np.tile(unseen, 2)
    embed = (r.normal(size=(1 << s.bits, s.width)) * 0.1).astype(np.float32)
    out = np.zeros((s.width, len(names)), np.float32)
    train = np.flatnonzero(~unseen2 & (np.diff(ptr) > 0))
    steps = max(1, s.epochs * -(-len(train) // s.batch))
    done = 0
    for _ in range(s.epochs):
        order = r.permutation(train)
        for at in range(0, len(order), s.batch):
            docs = order[at : at + s.batch]
            size = np.diff(ptr)[docs]
            pick = np.repeat(ptr[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            own, val, doc = cells[pick], values[pick], np.repeat(np.arange(len(docs)), size)
            x = np.stack([np.bincount(doc, val * embed[own, k], len(docs)) for k in range(s.width)], 1)
            slope = softmax(x @ out)
            slope[np.arange(len(docs)), y2[docs]] -= 1
            rate = s.rate * (1 - done / steps)
            done += 1
            back = slope @ out.T / len(docs)
            out -= rate * (x.T @ slope / len(docs)).astype(np.float32)
            for k in range(s.width):
                embed[:, k] -= rate * len(docs) * np.bincount(own, val * back[doc, k], 1 << s.bits).astype(np.float32)
    weights = (embed @ out).astype(np.float64)

    check = np.flatnonzero(unseen2 & (np.diff(ptr) > 0)) if (unseen2 & (np.diff(ptr) > 0)).any() else train
    scores = np.stack([np.bincount(np.repeat(np.arange(len(y2)), np.diff(ptr)), values * weights[cells, k], len(y2)) for k in range(len(names))], 1)[check]
    loss = lambda t: -np.log(softmax(scores * t)[np.arange(len(check)), y2[check]] + 1e-300).mean()
    sharp = min(np.exp(np.linspace(-2, 3, 51)), key=loss)
    return {"names": names, "weights": weights * sharp}


def train(documents: DataFrame, s: Settings) -> dict:
    """The model, fitted in one task on the bounded sample."""
    usable = documents.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_of_id(F.col("doc_id")) % s.folds != s.held_out)
    ).select("doc_id", "lang")
    chosen = bounded_sample(usable.groupBy("doc_id").agg(F.min("lang").alias("lang")), "doc_id", s.sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"doc_id": [], "text": [], "lang": []})])
        rows = rows.dropna(subset=["text"]).drop_duplicates("doc_id").sort_values("doc_id")
        if len(rows):
            unseen = rows.doc_id.to_numpy(np.int64) % 5 == 0
            yield pd.DataFrame({"model": [pickle.dumps(fit(rows.text.tolist(), rows.lang.tolist(), unseen, s))]})

    found = rows.repartition(1).mapInPandas(learn, "model binary").collect()
    return pickle.loads(found[0].model) if found else {"names": [], "weights": np.zeros((1 << s.bits, 0))}


def judged(texts: pa.Array, model: dict, s: Settings) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """First and end row, predicted names and scores, block by block."""
    names = model["names"]
    lowered = pc.utf8_lower(texts)
    for lo, hi, block in blocks(lowered):
        known = lettered(lowered, lo, block) if names else np.zeros(block.n, bool)
        best, score = np.zeros(block.n, int), np.zeros(block.n)
        if names:
            p = softmax(logits(block, model["weights"], s.bits))
            best, score = p.argmax(1), p.max(1)
        yield lo, hi, [names[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0)


def identified(documents: DataFrame, s: Settings | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` of every document."""
    s = s or Settings()
    model = documents.sparkSession.sparkContext.broadcast(train(documents, s))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, names, scores in judged(batch.column(2), model.value, s):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(names, pa.string()),
                     pa.array(scores), pa.array(scores >= s.reject_below)],
                    ["doc_id", "held_out", "lang_pred", "score", "accepted"],
                )

    rows = documents.select(
        F.col("doc_id").cast("long"), (crc_of_id(F.col("doc_id")) % s.folds == s.held_out).alias("held_out"), "text"
    )
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def accepted(documents: DataFrame, s: Settings | None = None) -> DataFrame:
    """The documents, all columns as they are, whose language is not rejected."""
    s = s or Settings()
    model = documents.sparkSession.sparkContext.broadcast(train(documents, s))
    at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [x for _, _, _, x in judged(batch.column(at), model.value, s)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= s.reject_below))

    return documents.mapInArrow(keep, documents.schema)


@query()
def op8_subword_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, and whether it is accepted."""
    return identified(table(spark, folder, "documents"))
