"""Hard-negative mining: exact inner products by the method of the Four Russians.

Method: components become integers. A candidate's integers are cut into bit planes, and in each plane the
bits of eight dimensions make one byte. An anchor has, for every eight dimensions, a table of its 256 subset
sums. A plane's part of the score is the sum of the tables' entries under the candidate's bytes; planes are
added from the sign plane down, the sum doubling at each step. So scores are whole and exact.

Candidates are packed into packs and anchors into sets of bounded size; each (set, pack) is one row and one
piece of work, joined by equality, so neither side is collected or broadcast whole and both grow only in
number. Packs and sets are large and tasks bounded in number, as the driver keeps something for each task and a pack
is shuffled once for each set. A piece keeps, per anchor, a few of the best rows; the pieces' winners are merged by key. A first
round scores rows of the anchor's label for its positives; the second scores the rest against the bounds
those positives give.

Defined cases: rows with a null id, label or vector, or any null or non-finite component take no part;
vectors of unequal length count as zero beyond their end; rows with the anchor's own id are never its
positives or negatives; repeated rows are candidates each, and a repeated anchor mines once; fewer rows than
asked for give fewer results; an empty table gives none. Scores are 64-bit: where the bound of the sums could
pass that, the job ends with an error and not with a wrong score. Only ``vec_id``, ``embedding`` and ``label``
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.functions.memory import give_back
from windrow.llm.frames import stored
from windrow.llm.registry import query, table

GROUP = 8  # dimensions whose bits make one byte
BATCH = str(4 << 20)  # bytes of one batch on its way to a Python worker


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 3
    lowest: int = 50  # percent of the positive's score a negative must reach
    highest: int = 95  # and must not pass
    pack: int = 32_768  # candidates of a pack
    set: int = 2048  # anchors of a set
    tile: int = 64  # anchors whose tables are looked up side by side
    tasks: int = 1024  # at most so many tasks score the pieces, however many there are


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, with labels changed and components as integers."""
    rows = embeddings.select(
        F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>").alias("v")
    )
    infinite = F.lit(float("inf"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of integers, zero beyond a vector's end."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and np.abs(flat).max() >= 2.0**62:
        raise OverflowError("a component is too large for scores of 64 bits")
    wide = -(-max(int(size.max(initial=0)), 1) // GROUP) * GROUP
    out = np.zeros((len(size), wide), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of the two's complement, ``[plane, group, row]``, the sign plane last."""
    most = int(np.maximum(values, ~values).max(initial=0)).bit_length() + 1
    n, wide = values.shape
    out = np.empty((most, wide // GROUP, n), np.uint8)
    for k in range(most):
        bits = (values >> k & 1).astype(np.uint8).reshape(n, -1, GROUP)
        out[k] = np.packbits(bits, axis=2, bitorder="little")[:, :, 0].T
    return out


def tables_of(anchors: np.ndarray) -> np.ndarray:
    """Subset sums ``[group, byte, anchor]`` of each eight components."""
    n, wide = anchors.shape
    parts = anchors.reshape(n, wide // GROUP, GROUP)
    out = np.zeros((wide // GROUP, 256, n), np.int64)
    for k in range(GROUP):
        out[:, 1 << k : 2 << k] = out[:, : 1 << k] + parts[:, :, k].T[:, None, :]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products ``[row, anchor]`` by lookups and shifted adds."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    for k in range(len(planes) - 1, -1, -1):
        if k < len(planes) - 1:
            total += total
        for g in range(tables.shape[0]):
            part = tables[g].take(planes[k, g], axis=0)
            if k == len(planes) - 1:
                total -= part
            else:
                total += part
    return total


def checked(anchors: np.ndarray, planes: np.ndarray) -> np.dtype:
    """The integer type whose range no partial sum can leave."""
    bound = int(np.abs(anchors).sum(axis=1, dtype=object).max(initial=0)) << len(planes)
    if bound >= 1 << 62:
        raise OverflowError("components are too large for scores of 64 bits")
    return np.dtype(np.int32 if bound < 1 << 30 else np.int64)


def packs(rows: DataFrame, s: Settings) -> DataFrame:
    """``pack, ids, labels, groups, planes``: candidates in packs, one row each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def row(t: pa.Table) -> pa.RecordBatch:
            planes = planes_of(matrix(t["v"].combine_chunks()))
            cells = [[number], [t["vec_id"].to_numpy().astype("<i8").tobytes()], [t["label"].to_numpy().astype("<i4").tobytes()], [planes.shape[1]], [planes.tobytes()]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], ["pack", "ids", "labels", "groups", "planes"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= s.pack:
                t = pa.Table.from_batches(held)
                while len(t) >= s.pack:
                    yield row(t.slice(0, s.pack))
                    t, number = t.slice(s.pack), number + 1
                held = t.to_batches()
        if sum(map(len, held)):
            yield row(pa.Table.from_batches(held))

    return rows.mapInArrow(pack, "pack long, ids binary, labels binary, groups long, planes binary")


def pieces(anchors: DataFrame, packed: DataFrame, s: Settings) -> DataFrame:
    """One row for each set of anchors with each pack. ``anchors``: ``anchor_id, label, v, asked``.

    Both sides are repeated by the other's count of blocks, so the equality join meets each pair once.
    """
    n_sets = max(1, -(-anchors.count() // s.set))
    member = F.struct("anchor_id", "label", "v", "asked")
    sets = anchors.groupBy(F.pmod(F.xxhash64("anchor_id"), F.lit(n_sets)).alias("anchor_set")).agg(F.collect_list(member).alias("members"))
    names = packed.select("pack")
    each = sets.join(names.withColumn("anchor_set", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1)))), "anchor_set")
    work = each.join(packed, "pack")
    return work.repartition(max(1, min(n_sets * packed.count(), s.tasks)), "anchor_set", "pack")


def single(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pieces one at a time; a task may have several."""
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]
            give_back()


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i4")
    return ids, labels, np.frombuffer(row["planes"], np.uint8).reshape(-1, row["groups"], len(ids))


def tiles(row: dict, same: bool, s: Settings) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Each anchor of a piece with ids and scores of the rows of its label (or of all other labels)."""
    ids, labels, planes = unpacked(row)
    by_label: dict[int, list[dict]] = {}
    for m in row["members"]:
        by_label.setdefault(m["label"], []).append(m)
    for label, members in by_label.items():
        rows = np.flatnonzero((labels == label) == same)
        own = np.ascontiguousarray(planes[:, :, rows])
        wide = own.shape[1] * GROUP
        for lo in range(0, len(members), s.tile):
            some = members[lo : lo + s.tile]
            values = np.zeros((len(some), max(wide, max(len(m["v"]) for m in some))), np.int64)
            for k, m in enumerate(some):
                values[k, : len(m["v"])] = m["v"]
            values = values[:, :wide]  # beyond the candidates' end all products are zero
            found = scores(tables_of(values).astype(checked(values, own)), own)
            for k, m in enumerate(some):
                other = ids[rows] != m["anchor_id"]
                yield m, ids[rows][other], found[other, k].astype(np.int64)


def best(ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best, higher scores first, ties by smaller id."""
    if len(score) > most:
        least = np.partition(score, len(score) - most)[len(score) - most]
        near = np.flatnonzero(score >= least)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))][:most]


def first_per(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each key with their ``rank``; pieces sent at most ``most`` each."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= most)


def mined(embeddings: DataFrame, anchors: DataFrame, s: Settings | None = None) -> DataFrame:
    """Positives and hard negatives of the rows whose ``vec_id`` is in ``anchors``.

    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    s = s or Settings()
    embeddings.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)  # a row is a piece: one or a few at a time
    rows = usable(embeddings)
    packed = stored(packs(rows, s), "packs")
    chosen = rows.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi").dropDuplicates(["vec_id"])
    chosen = stored(chosen.select(F.col("vec_id").alias("anchor_id"), "label", "v", F.array().cast("array<long>").alias("asked")), "anchors")

    def score_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single(batches):
            out = []
            for m, ids, score in tiles(row, True, s):
                out += [(m["anchor_id"], int(ids[k]), int(score[k])) for k in best(ids, score, s.positives)]
            yield from rows_out(out, ["anchor_id", "positive_id", "positive_score"])

    near = pieces(chosen, packed, s).mapInArrow(score_positives, "anchor_id long, positive_id long, positive_score long")
    order = [F.desc("positive_score"), "positive_id"]
    positives = stored(first_per(near, ["anchor_id"], order, s.positives).drop("rank"), "positives")
    asked = positives.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("asked"))
    queries = stored(chosen.drop("asked").join(asked, "anchor_id"), "queries")

    def score_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single(batches):
            out = []
            for m, ids, score in tiles(row, False, s):
                for p in m["asked"]:
                    if p < 0:
                        continue  # the lower bound lies above the upper one
                    low, high = -(-s.lowest * p // 100), s.highest * p // 100
                    fit = np.flatnonzero((score >= low) & (score <= high))
                    fit = fit[best(ids[fit], score[fit], s.negatives)]
                    out += [(m["anchor_id"], p, int(ids[k]), int(score[k])) for k in fit]
            yield from rows_out(out, ["anchor_id", "positive_score", "negative_id", "negative_score"])

    schema = "anchor_id long, positive_score long, negative_id long, negative_score long"
    found = pieces(queries, packed, s).mapInArrow(score_negatives, schema)
    order = [F.desc("negative_score"), "negative_id"]
    negatives = first_per(found, ["anchor_id", "positive_score"], order, s.negatives)
    return positives.join(negatives, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def rows_out(rows: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


ORACLE = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM sound a JOIN sound r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""


@query(ORACLE)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth vector."""
    rows = table(spark, folder, "embeddings")
    return mined(rows, rows.where(F.col("vec_id") % 50 == 0))
