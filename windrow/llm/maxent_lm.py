"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

Method: P(word | history) = P(class | history) x P(word | class). The class factor is a softmax whose
logits are sums of rows of one hashed table, a row per n-gram feature (the word before, the two words
before) and skip feature (the second and the third word before); it is trained by distributed
gradient updates: in every round each trainer takes AdaGrad steps through its share of the corpus from
the common weights, and the changes are averaged in a tree. Shares are dealt by document hash and hold about
``trainer`` tokens each, so they, and the scores, depend on the corpus and not on cores or partitions, and
a trainer's time does not grow with the corpus. The word factor has one indicator per word, for
which relative frequency is the maximum-entropy solution. Words are classed by the company they keep
(clusters of co-occurrence with the commonest words) and by frequency; words beyond the model's
vocabulary share one class, inside which smoothed corpus counts decide, so unseen words have a
probability too. Scoring is one pass over sparse NumPy batches.

What is gathered grows with the corpus: counts of all words of all training documents, and gradients
over all positions of every training document (``stride`` 1). Counts of the ``lookups`` most frequent words
(16 bytes each, so bounded) and the weights are broadcast; all other words are joined with their counts
by shuffle, (document, word) pairs aggregated first. Words are known by 64-bit hashes.

Defined cases: a null or empty text is the end token alone; repeated rows are scored alike; without
training documents the counts are 0 and the model is the base law. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.frames import crc_of_id, long_columns, stored
from windrow.llm.registry import query, table
from windrow.llm.textblock import Block, blocks, lower_ascii, mixed, owners

TREE = 64  # changes of weights that are added up in one step
BODY = "block int, sender int, body binary"
END = np.uint64(0)  # stands for the end token; no word hashes to it but by a 2**-64 chance


@dataclass(frozen=True)
class Settings:
    folds: int = 10  # rows whose crc32(doc_id) is 0 modulo this are held out
    lookups: int = 1 << 18  # most frequent words whose counts go to every task
    vocabulary: int = 1 << 14  # most frequent words that have a class of their own
    anchors: int = 96  # commonest words whose company tells the classes
    clusters: int = 8
    bands: int = 8  # frequency bands of a cluster
    bits: int = 14  # rows of the hashed table
    rounds: int = 2
    stride: int = 1  # a round learns from every so-many-th position of its documents; 1 is all of them
    trainer: int = 1 << 23  # tokens of a trainer's share in a round
    batch: int = 4096
    rate: float = 0.3
    alpha: float = 0.1


def token_stream(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each closed by the end token, and where each text begins."""
    block = Block(lower_ascii(block.buf), block.offs)
    starts, ends, first = block.words()
    h = block.span_hashes(starts, ends)
    h[h == END] = np.uint64(1)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(back, np.concatenate(counts), len(found)).astype(np.int64)


def word_counts(training: DataFrame) -> DataFrame:
    """``word, count`` of all training tokens; a task sends each of its words once per 64 blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def taken() -> pa.RecordBatch:
            k, c = summed(keys, counts)
            keys.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["word", "count"])

        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                k, c = np.unique(token_stream(block)[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                if len(keys) == 64:
                    yield taken()
        if keys:
            yield taken()

    return training.select("text").mapInArrow(count, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts above the lowest count level that leaves at most ``most`` words, in falling order."""
    level = F.floor(F.log2("count") * 8).cast("int")
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level)
    least, total = None, 0
    for r in levels:  # at most 8 levels per doubling
        total += r.n
        if total > most:
            break
        least = r.level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words, seen = long_columns(counts.where(level >= least).select("word", "count"))
    order = np.lexsort((words, -seen))
    return words[order].view(np.uint64), seen[order]


class Lexicon:
    """Ids of known words by falling count; ``size`` stands for any other word."""

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        order = np.argsort(words, kind="stable")
        self.sorted, self.ids = words[order], order

    def find(self, words: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, words), self.size - 1)
        return np.where(self.sorted[at] == words, self.ids[at], self.size)


def gathered(rows: DataFrame, width: int, senders: int) -> dict[int, np.ndarray]:
    """Sums of binary rows of doubles by block, in a tree over ``sender``; blocks are as many as the model has."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sender")
        total = sum(np.frombuffer(b, "<f8") for b in rows.body)
        return pd.DataFrame({"block": rows.block[:1], "sender": rows.sender[:1] // TREE, "body": [total.tobytes()]})

    while True:
        rows = rows.groupBy("block", F.floor(F.col("sender") / TREE).alias("__next")).applyInPandas(add, BODY)
        senders = -(-senders // TREE)
        if senders <= 1:
            return {r.block: np.frombuffer(r.body, "<f8").reshape(-1, width) for r in rows.collect()}


def sent(matrix: np.ndarray, sender: int, rows: int = 512) -> pa.RecordBatch:
    parts = [(k // rows, matrix[k : k + rows].astype("<f8").tobytes()) for k in range(0, len(matrix), rows)]
    cells = [pa.array([p[0] for p in parts], pa.int32()), pa.array([sender] * len(parts), pa.int32()), pa.array([p[1] for p in parts], pa.binary())]
    return pa.RecordBatch.from_arrays(cells, ["block", "sender", "body"])


def company(training: DataFrame, words: np.ndarray, anchors: int) -> np.ndarray:
    """How often each word stands within two places of each of the commonest words."""
    lexicon = training.sparkSession.sparkContext.broadcast(Lexicon(words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        total = np.zeros(known.size * anchors)
        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                h, first = token_stream(block)
                ids, doc = known.find(h), owners(first, len(h))
                for gap in (1, 2):
                    for a, b in ((ids[:-gap], ids[gap:]), (ids[gap:], ids[:-gap])):
                        both = np.flatnonzero((a < known.size) & (b < anchors) & (doc[gap:] == doc[:-gap]))
                        total += np.bincount(a[both] * anchors + b[both], minlength=len(total))
        yield sent(total.reshape(-1, anchors), TaskContext.get().partitionId())

    # whole numbers, so the sums are the same however texts are spread
    tasks = max(1, training.sparkSession.sparkContext.defaultParallelism)
    parts = gathered(training.select("text").coalesce(tasks).mapInArrow(count, BODY), anchors, tasks)
    return np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.zeros((0, anchors))


def clustered(vectors: np.ndarray, k: int, steps: int = 20) -> np.ndarray:
    """Spherical k-means from spread-out starts; the first words are the most frequent ones."""
    x = np.sqrt(vectors)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centers, near = [x[0]], x @ x[0]
    for _ in range(1, min(k, len(x))):
        pick = int(np.argmin(near[: min(len(x), 512)]))
        centers.append(x[pick])
        near = np.maximum(near, x @ x[pick])
    centers = np.array(centers)
    for _ in range(steps):
        own = (x @ centers.T).argmax(1)
        for c in range(len(centers)):
            if (own == c).any():
                centers[c] = x[own == c].mean(0)
                centers[c] /= max(np.linalg.norm(centers[c]), 1e-9)
    return (x @ centers.T).argmax(1)


def classes_of(words: np.ndarray, counts: np.ndarray, vectors: np.ndarray, s: Settings) -> np.ndarray:
    """Class of each vocabulary word: cluster and band of equal mass; end and other words have their own."""
    out = np.zeros(len(words), np.int64)
    if len(words):
        cluster = clustered(vectors, s.clusters)
        for c in range(s.clusters):
            own = np.flatnonzero(cluster == c)
            mass = np.cumsum(counts[own])
            if len(own):
                out[own] = c * s.bands + np.minimum(s.bands * (mass - counts[own]) // mass[-1], s.bands - 1)
    out[words == END] = s.clusters * s.bands
    return out


def features(h: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """Rows of the hashed table for each position: bigram, trigram, and two skips."""
    n, shift = len(h), np.uint64(64 - bits)
    at = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    before = []
    for k in (1, 2, 3):
        word = np.zeros(n, np.uint64)
        word[k:] = h[:-k] if k < n else 0
        word[at < k] = np.uint64(2)
        before.append(word)
    salted = lambda x, k: mixed(x + np.uint64(k * 0x9E3779B97F4A7C1)) >> shift
    pair = before[0] * np.uint64(0xD6E8FEB86659FD93) + before[1]
    return np.stack([salted(before[0], 1), salted(pair, 2), salted(before[1], 3), salted(before[2], 4)], 1).astype(np.int64)


def logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights[rows[:, 0]]
    out += bias
    for k in range(1, rows.shape[1]):
        out += weights[rows[:, k]]
    return out


def chances(z: np.ndarray) -> np.ndarray:
    """Probabilities of the classes, in place of their logits."""
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def log_chance(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log probability of each row's own class; the logits are used up."""
    z -= z.max(1, keepdims=True)
    mine = z[np.arange(len(z)), own]
    np.exp(z, out=z)
    return mine - np.log(z.sum(1))


def run_sums(x: np.ndarray, edge: np.ndarray, size: np.ndarray, short: int = 16) -> np.ndarray:
    """Sums of runs of rows: short runs side by side, long ones each on its own."""
    out = x[edge]
    open_ = np.flatnonzero((size > 1) & (size <= short))
    k = 1
    while len(open_):
        out[open_] += x[edge[open_] + k]
        k += 1
        open_ = open_[size[open_] > k]
    for q in np.flatnonzero(size > short).tolist():
        out[q] = x[edge[q] : edge[q] + size[q]].sum(0)
    return out


def step(w: np.ndarray, speed: np.ndarray, rows: np.ndarray, target: np.ndarray, bias: np.ndarray, rate: float) -> None:
    """One AdaGrad step; a table row's gradient is the sum over its positions by the root of their number."""
    slope = chances(logits(w, bias, rows))
    slope[np.arange(len(rows)), target] -= 1
    key = rows.T.ravel()
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size, found = np.diff(np.append(edge, len(key))), key[edge]
    g = run_sums(slope[order % len(rows)], edge, size)
    g /= np.sqrt(size).astype(np.float32)[:, None]
    now = speed[found] + np.einsum("ij,ij->i", g, g)
    speed[found] = now
    g *= (rate / np.sqrt(now))[:, None]
    w[found] -= g


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """Trainer and texts of each run of rows of one trainer."""
    for batch in batches:
        trainer = batch.column(0).to_numpy()
        edge = [*np.flatnonzero(np.diff(trainer, prepend=-1)).tolist(), len(trainer)]
        for a, z in zip(edge[:-1], edge[1:]):
            yield int(trainer[a]), batch.column(1).slice(a, z - a)


def trained(training: DataFrame, lexicon: Lexicon, classes: np.ndarray, bias: np.ndarray, tokens: int, s: Settings) -> np.ndarray:
    """The hashed table after ``rounds`` of averaged local steps, each over its own share of documents."""
    spark, width = training.sparkSession, len(bias)
    trainers = max(1, round(tokens / s.rounds / s.trainer))
    weights = np.zeros((1 << s.bits, width), np.float32)
    kind = np.uint16 if s.bits <= 16 else np.int64  # short keys are sorted by counting
    for round_ in range(s.rounds):
        start = spark.sparkContext.broadcast((lexicon, classes, bias, weights))
        deal = F.xxhash64("doc_id", "text", F.lit(31))
        share = training.where(F.pmod(deal, F.lit(s.rounds)) == round_).select(
            F.pmod(F.shiftright(deal, 8), F.lit(trainers)).cast("int").alias("trainer"), "text", deal.alias("at")
        )
        share = share.repartition(trainers, "trainer").sortWithinPartitions("trainer", "at", "text").select("trainer", "text")

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            known, class_of, shift, common = start.value
            trainer, steps = None, 0
            w = speed = None

            def change() -> pa.RecordBatch:
                return sent(np.concatenate([w - common, np.full((1, width), float(steps > 0), np.float32)]), trainer)

            for own, texts in runs_of(batches):
                if own != trainer:
                    if trainer is not None:
                        yield change()
                    trainer, steps = own, 0
                    w, speed = common.copy(), np.full(len(common), 1e-3, np.float32)
                for _, _, block in blocks(texts):
                    h, first = token_stream(block)
                    chosen = np.random.default_rng(steps).permutation(np.arange((7 * steps) % s.stride, len(h), s.stride))
                    rows, target = features(h, first, s.bits)[chosen].astype(kind), class_of[known.find(h)][chosen]
                    for at in range(0, len(chosen), s.batch):
                        step(w, speed, rows[at : at + s.batch], target[at : at + s.batch], shift, s.rate)
                        steps += 1
            if trainer is not None:
                yield change()

        parts = gathered(share.mapInArrow(learn, BODY), width, trainers)
        start.unpersist()
        if parts:
            total = np.concatenate([parts[k] for k in sorted(parts)])
            weights = (weights + total[:-1] / max(1.0, float(total[-1, 0]))).astype(np.float32)
    return weights


def scored(documents: DataFrame, s: Settings | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    s = s or Settings()
    spark = documents.sparkSession
    held_out = crc_of_id(F.col("doc_id")) % s.folds == 0
    training = documents.where(~held_out).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(word_counts(training), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    words, seen = most_frequent(counts, s.lookups)
    own = min(s.vocabulary, len(words))
    lexicon = Lexicon(words[:own])
    vectors = company(training, words[:own], min(s.anchors, own)) if own else np.zeros((0, 1))
    width = s.clusters * s.bands + 2
    classes = np.append(classes_of(words[:own], seen[:own], vectors, s), width - 1)
    mass = np.bincount(classes[:-1], seen[:own], width)
    rest, kinds = total - int(seen[:own].sum()), distinct - own
    mass[-1] = rest
    bias = np.log((mass + 0.5) / (mass.sum() + 0.5 * width)).astype(np.float32)
    weights = trained(training, lexicon, classes, bias, int(total), s)
    inside = np.log10(seen[:own] / mass[classes[:-1]]) if own else np.zeros(0)
    below, below_rest = np.log10(total + s.alpha * (distinct + 1)), np.log10(rest + s.alpha * (kinds + 1))
    model = spark.sparkContext.broadcast((Lexicon(words), lexicon, seen, classes, bias, weights, inside))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vocabulary, seen, classes, bias, weights, inside = model.value
        part, done = TaskContext.get().partitionId() << 33, 0
        base_of = np.append(np.log10(seen + s.alpha) - below, 0.0)
        word_of = np.concatenate([inside, np.log10(seen[len(inside) :] + s.alpha) - below_rest, [0.0]])
        for batch in batches:
            for lo, hi, block in blocks(batch.column(2)):
                h, first = token_stream(block)
                found, back = np.unique(h, return_inverse=True)
                ids, own = known.find(found)[back], classes[vocabulary.find(found)][back]
                rows = features(h, first, s.bits)
                log_class = np.empty(len(h))
                for at in range(0, len(h), s.batch):
                    log_class[at : at + s.batch] = log_chance(logits(weights, bias, rows[at : at + s.batch]), own[at : at + s.batch])
                sums = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has its end token
                rare = np.flatnonzero(ids == known.size)
                doc = owners(first, len(h))[rare]
                order = np.lexsort((h[rare], doc))
                doc, rare = doc[order], h[rare][order]
                new = np.ones(len(rare), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (rare[1:] != rare[:-1])
                edge = np.flatnonzero(new)
                times = np.diff(np.append(edge, len(rare)))
                list_at = np.searchsorted(doc[edge], np.arange(block.n + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(rare[edge].view(np.int64)), pa.array(times)], ["word", "times"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part + done + np.arange(block.n)), *(c.slice(lo, hi - lo) for c in batch.columns[:2]),
                        pa.array(np.diff(first)), pa.array(sums((ids < known.size).astype(np.int64))), pa.array(sums(base_of[ids])),
                        pa.array(sums(log_class / np.log(10) + word_of[ids])), pa.ListArray.from_arrays(pa.array(list_at), pairs),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )
                done += block.n

    rows = documents.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(
        score,
        "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
        "rare array<struct<word:long,times:long>>",
    )
    rows = stored(rows, "scored")
    pairs = rows.select("row", F.inline("rare")).join(counts, "word", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    more = pairs.groupBy("row").agg(
        F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * (F.log10(F.col("count") + s.alpha) - float(below))).alias("base"),
        F.sum(F.col("times") * (F.log10(F.col("count") + s.alpha) - float(below_rest))).alias("own"),
    )
    none = F.lit(0)
    return rows.drop("rare").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", none)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("base", none)).alias("base_score"),
        (F.col("score") + F.coalesce("own", none)).alias("score"),
    )


@query()
def op7_maxent_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under the counts and under the model."""
    return scored(table(spark, folder, "documents"))
