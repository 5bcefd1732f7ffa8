"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes.

Method: the tokenizers library gives the characters each token covers, sentencepiece the characters of
each piece; where both end a token at a whole character lies a coarse cut. Between two coarse cuts that
hold characters of several bytes or byte-fallback pieces, the tokens' decoded bytes give the finer cuts.
The cuts make groups; a token of A and one of B in one group are linked. (The installed sentencepiece
has no immutable proto any more; ``offset_mapping`` gives the same spans in characters.)

Neither tokenizer joins bytes across the start of ASCII white space, so a text is aligned unit by unit
(white space and the word after it), each distinct unit once per worker while a bounded table has room.
Texts with white space beyond space, tab and line feed, or with a unit whose bytes do not come back,
are aligned whole.

Documents go through in buckets of a few MB. A bucket keeps its distinct id pairs and, per document, how
often each one is linked; only (bucket, pair) rows are shuffled to be counted, and each bucket gets the
counts of its own pairs back. So no pair has more rows than there are buckets, and a bucket's list is
bounded by its bytes.

Defined cases: null and empty texts, and texts whose joined bytes of either side differ from space and
text, have zeros and an empty ``groups_sha256``; special tokens in a text are plain text; repeated rows are
documents of their own in the counts; a null ``doc_id`` stays null; an empty table gives no rows. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import gc
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.frames import new_folder, stored
from windrow.llm.registry import query, table
from windrow.llm.textblock import Block, blocks, owners
from windrow.llm.tokens import Encoder, known_path

SPACE_SIGN = "▁"
BUCKET = pa.schema(
    [("bucket", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("totals", pa.binary()), ("digests", pa.list_(pa.string())),
     ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64())), ("entries", pa.list_(pa.int64())),
     ("places", pa.binary()), ("times", pa.binary())]
)
BUCKET_SQL = (
    "bucket long, doc_ids array<long>, totals binary, digests array<string>, pairs array<long>, holders array<long>, "
    "entries array<long>, places binary, times binary"
)
RESULT_SQL = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


@dataclass(frozen=True)
class Settings:
    byte_level: str = ""  # file of tokenizer A, byte-level BPE
    pieces: str = ""  # file of tokenizer B, sentencepiece with byte fallback
    bucket: int = 4 << 20  # bytes of text after which a bucket is closed
    room: int = 500_000  # units a worker remembers


def byte_of_sign() -> dict[str, int]:
    """The byte each sign of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return signs | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Alignments:
    """Groups and links of many stretches of text; all arrays run over the stretches."""

    good: np.ndarray  # whether the bytes of both sides come back
    totals: np.ndarray  # n_a, n_b, n_groups, n_links
    edge: np.ndarray  # where a stretch's links begin, with the end
    links: np.ndarray  # (id of A << 32) | id of B, distinct within a stretch
    times: np.ndarray  # how often each is linked
    text: np.ndarray  # "a1,a2|b1;a3|b2,b3;" as bytes


class Side:
    """Tokens of all stretches in a row.

    ``spaced`` for the side that adds a space itself: where it is the stretch's own first space, spans move by
    it; elsewhere the token of the added space is left out.
    """

    def __init__(self, ids: list[list[int]], spans: list[list], lengths: np.ndarray, spaced: np.ndarray | None = None):
        self.count = np.fromiter(map(len, ids), np.int64, len(ids))
        n = int(self.count.sum())
        self.ids = np.fromiter(chain.from_iterable(ids), np.int64, n)
        flat = np.fromiter(chain.from_iterable(chain.from_iterable(spans)), np.int64, 2 * n).reshape(-1, 2)
        self.begin, self.end = flat[:, 0], flat[:, 1]
        self.own = np.repeat(np.arange(len(ids)), self.count)
        if spaced is not None:
            head = np.cumsum(self.count) - self.count
            shift = spaced[self.own].astype(np.int64)
            self.begin, self.end = self.begin + shift, self.end + shift
            self.begin[head[spaced]] = 0
            kept = np.ones(n, bool)
            kept[head[~spaced]] = False
            self.ids, self.begin, self.end, self.own = self.ids[kept], self.begin[kept], self.end[kept], self.own[kept]
            self.count = self.count - ~spaced
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.last = np.zeros(len(self.ids), bool)
        self.last[self.first[1:][self.count > 0] - 1] = True
        total = np.concatenate([[0], np.cumsum(lengths[self.ids])])
        self.byte_end = total[1:] - total[self.first[self.own]]  # within its stretch
        self.size = total[self.first[1:]] - total[self.first[:-1]]


class Pool:
    """The bytes of every token of a vocabulary, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.body = np.frombuffer(b"".join(tokens), np.uint8)

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        return self.body[np.repeat(self.start[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def rendered(n: int, ends: str) -> list[np.ndarray]:
    """For each of ``ends``, the decimal ids below ``n`` with it behind them."""
    out = []
    for end in ends:
        one = np.empty(n, object)
        one[:] = [f"{k}{end}".encode() for k in range(n)]
        out.append(one)
    return out


class Pair:
    """The two tokenizers."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces)
        byte, entries = byte_of_sign(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.a_bytes[k] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_falls = np.array([self.b.is_byte(k) for k in range(len(names))])
        self.b_bytes = [
            bytes([int(n[3:5], 16)]) if f else n.replace(SPACE_SIGN, " ").encode() for n, f in zip(names, self.b_falls)
        ]
        self.pools = Pool(self.a_bytes), Pool(self.b_bytes)
        self.signs = rendered(len(self.a_bytes), ",|"), rendered(len(names), ",;")
        # white space that a piece holds behind its start would make a unit's pieces differ from the text's
        self.joined = sorted({c for n in names for c in n if c in " \t\n\v\f\r"})
        self.space = self.b.piece_to_id(SPACE_SIGN)

    def align(self, texts: list[str]) -> Alignments:
        """The alignment of each of ``texts``, which begin with white space."""
        found = self.a.encode_batch(texts, add_special_tokens=False)
        a = Side([x.ids for x in found], [x.offsets for x in found], self.pools[0].length)
        spaced = np.array([t[0] == " " for t in texts])
        found = self.b.encode([t[1:] if t[0] == " " else t for t in texts], return_type="offset_mapping", num_threads=1)
        for k in [k for k, x in enumerate(found) if not x["ids"]]:  # B adds no space to an empty text
            found[k] = {"ids": [self.space], "offsets": [(0, 0)]}
        b = Side([x["ids"] for x in found], [x["offsets"] for x in found], self.pools[1].length, spaced)
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        good = self._faithful(a, b, b"".join(raw), size)
        cut_a, cut_b = self._cuts(a, b, chars, size, good)
        return self._grouped(a, b, cut_a, cut_b, good)

    def _faithful(self, a: Side, b: Side, raw: bytes, size: np.ndarray) -> np.ndarray:
        """Whether the decoded tokens of both sides are the bytes of the text."""
        good = np.ones(len(size), bool)
        body, edge = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(size)])
        for side, pool in ((a, self.pools[0]), (b, self.pools[1])):
            good &= side.size == size
            same = np.repeat(good, size)
            got = pool.decoded(side.ids[good[side.own]])
            wrong = np.flatnonzero(got != body[same])
            good[np.searchsorted(edge, np.flatnonzero(same)[wrong], "right") - 1] = False
        return good

    def _cuts(self, a: Side, b: Side, chars: np.ndarray, size: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A and of B behind which a cut lies; as many on both sides."""
        base = np.cumsum(chars + 1) - chars - 1
        # A closes at a character if the next token begins there or later, B where a piece covers characters
        closes_a = a.last.copy()
        closes_a[:-1] |= a.begin[1:] >= a.end[:-1]
        closes_b = b.end > b.begin
        at_a, at_b = np.flatnonzero(closes_a & good[a.own]), np.flatnonzero(closes_b & good[b.own])
        _, i, j = np.intersect1d(base[a.own[at_a]] + a.end[at_a], base[b.own[at_b]] + b.end[at_b], assume_unique=True, return_indices=True)
        cut_a, cut_b = at_a[i], at_b[j]
        # groups of several tokens on both sides in which characters are not bytes get finer cuts
        group_a, group_b = np.searchsorted(cut_a, np.arange(len(a.ids))), np.searchsorted(cut_b, np.arange(len(b.ids)))
        n = len(cut_a) + 1
        odd = np.zeros(n, bool)
        odd[group_b[self.b_falls[b.ids]]] = True
        odd[group_a[self.pools[0].length[a.ids] != a.end - a.begin]] = True
        odd[group_b[self.pools[1].length[b.ids] != b.end - b.begin]] = True
        odd &= (np.bincount(group_a, minlength=n) > 1) & (np.bincount(group_b, minlength=n) > 1)
        in_a, in_b = np.flatnonzero(odd[group_a] & good[a.own]), np.flatnonzero(odd[group_b] & good[b.own])
        base = np.cumsum(size + 1) - size - 1
        _, i, j = np.intersect1d(base[a.own[in_a]] + a.byte_end[in_a], base[b.own[in_b]] + b.byte_end[in_b], assume_unique=True, return_indices=True)
        return np.union1d(cut_a, in_a[i]), np.union1d(cut_b, in_b[j])

    def _grouped(self, a: Side, b: Side, cut_a: np.ndarray, cut_b: np.ndarray, good: np.ndarray) -> Alignments:
        keep_a, keep_b = np.flatnonzero(good[a.own]), np.flatnonzero(good[b.own])
        ids_a, ids_b = a.ids[keep_a], b.ids[keep_b]
        group_a, group_b = np.searchsorted(cut_a, keep_a), np.searchsorted(cut_b, keep_b)
        n, own = len(cut_a), a.own[cut_a]
        many_a, many_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        totals = np.zeros((len(good), 4), np.int64)
        totals[:, 0], totals[:, 1] = np.where(good, a.count, 0), np.where(good, b.count, 0)
        totals[:, 2] = np.bincount(own, minlength=len(good))
        np.add.at(totals[:, 3], own, many_a * many_b)
        # distinct ids of a group on both sides with their counts, then all pairs of these
        code_a, times_a = np.unique(group_a << 32 | ids_a, return_counts=True)
        code_b, times_b = np.unique(group_b << 32 | ids_b, return_counts=True)
        kinds_b = np.bincount(code_b >> 32, minlength=n)
        first_b = np.cumsum(kinds_b) - kinds_b
        reach = kinds_b[code_a >> 32]
        left = np.repeat(np.arange(len(code_a)), reach)
        right = np.repeat(first_b[code_a >> 32] - np.cumsum(reach) + reach, reach) + np.arange(int(reach.sum()))
        pair = (code_a[left] & 0xFFFFFFFF) << 32 | (code_b[right] & 0xFFFFFFFF)
        times, stretch = times_a[left] * times_b[right], own[code_a[left] >> 32]
        order = np.lexsort((pair, stretch))
        pair, stretch, times = pair[order], stretch[order], times[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (stretch[1:] != stretch[:-1])
        times = np.add.reduceat(times, np.flatnonzero(new)) if len(pair) else times
        # the decimal text: a group's tokens of A, then those of B, each with the sign that follows it
        ends_a, ends_b = np.isin(keep_a, cut_a), np.isin(keep_b, cut_b)
        plain_a, close_a = self.signs[0]
        plain_b, close_b = self.signs[1]
        words = np.concatenate([np.where(ends_a, close_a[ids_a], plain_a[ids_a]), np.where(ends_b, close_b[ids_b], plain_b[ids_b])])
        place = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = words[place].tolist()
        edge = np.concatenate([[0], np.cumsum(totals[:, 0] + totals[:, 1])]).tolist()
        text = np.empty(len(good), object)
        text[:] = [b"".join(words[x:y]) for x, y in zip(edge[:-1], edge[1:])]
        return Alignments(
            good, totals, np.searchsorted(stretch[new], np.arange(len(good) + 1)), pair[new], times, text
        )


class Units:
    """Alignments of the units seen so far, as arrays."""

    def __init__(self, pair: Pair, room: int):
        self.pair, self.room = pair, room
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes
        self.row = np.zeros(0, np.int64)  # and the row of each
        none = np.zeros(0, np.int64)
        self.known = Alignments(np.zeros(0, bool), np.zeros((0, 4), np.int64), np.zeros(1, np.int64), none, none, np.zeros(0, object))

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        gc.disable()  # the libraries return millions of short lists, none in a cycle
        try:
            found, known = self.pair.align(texts), self.known
        finally:
            gc.enable()
        at = np.searchsorted(self.keys, keys)
        self.row = np.insert(self.row, at, len(self.keys) + np.arange(len(keys)))
        self.keys = np.insert(self.keys, at, keys)
        found.edge = found.edge[1:] + known.edge[-1]
        self.known = Alignments(*(np.concatenate([getattr(known, f), getattr(found, f)]) for f in Alignments.__dataclass_fields__))

    def rows(self, keys: np.ndarray, text_of) -> np.ndarray:
        """Row of each distinct key; ``text_of(index)`` gives the texts of those not known yet."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            new = np.flatnonzero(self.keys[at] != keys)
        else:
            new = np.arange(len(keys))
        if len(new):
            if len(self.keys) + len(new) > self.room:
                self.forget()
                new = np.arange(len(keys))
            self._learn(keys[new], text_of(new))
        return self.row[np.searchsorted(self.keys, keys)]


@cache
def known_units(byte_level: str, pieces: str, room: int) -> Units:
    """One per Python worker, so its table lives on from task to task."""
    return Units(Pair(byte_level, pieces), room)


def unit_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of a block's units (a word and the white space before it, or white space at a text's
    end), and the first unit of each text. They cover every byte."""
    _, ends, _ = block.words()
    ends = np.unique(np.concatenate([ends, block.offs[1:]]))
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return starts, ends, np.searchsorted(starts, block.offs)


def odd_texts(block: Block, joined: list[str]) -> np.ndarray:
    """Texts that must be aligned whole because of their white space."""
    body = block.buf[: block.size]
    return np.union1d(Encoder._odd(block), np.flatnonzero(block.per_doc(np.isin(body, [ord(c) for c in joined]))))


def digest(text: bytes) -> str:
    return hashlib.sha256(text[:-1]).hexdigest()


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)])
    return total[first[1:]] - total[first[:-1]]


def block_result(block: Block, units: Units) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Totals and digests per text; text, pair and times of each distinct link of a text."""
    starts, ends, first = unit_spans(block)
    raw = block.buf[: block.size].tobytes()
    keys, one, back = np.unique(block.span_hashes(starts, ends), return_index=True, return_inverse=True)
    rows = units.rows(keys, lambda new: [raw[x:y].decode() for x, y in zip(starts[one[new]].tolist(), ends[one[new]].tolist())])
    known = units.known
    row = rows[back]
    own = owners(first, len(starts))
    whole = np.union1d(odd_texts(block, units.pair.joined), own[~known.good[row]]).astype(np.int64)
    totals = sums(known.totals[row], first)
    text = known.text[row]
    digests = [digest(b"".join(text[a:z].tolist())) for a, z in zip(first[:-1].tolist(), first[1:].tolist())]
    at_once = ~np.isin(own, whole)
    codes, many = np.unique(own[at_once] * len(keys) + back[at_once], return_counts=True)
    doc, unit = codes // max(len(keys), 1), rows[codes % max(len(keys), 1)]
    size = known.edge[unit + 1] - known.edge[unit]
    place = np.repeat(known.edge[unit] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    docs, links, times = [np.repeat(doc, size)], [known.links[place]], [np.repeat(many, size) * known.times[place]]
    for d in whole.tolist():
        found = units.pair.align([raw[block.offs[d] : block.offs[d + 1]].decode()])
        totals[d], digests[d] = found.totals[0], digest(found.text[0]) if found.good[0] else ""
        docs.append(np.full(len(found.links), d))
        links.append(found.links)
        times.append(found.times)
    doc, link, many = np.concatenate(docs), np.concatenate(links), np.concatenate(times)
    pairs, local = np.unique(link, return_inverse=True)
    codes, at = np.unique(doc * max(len(pairs), 1) + local, return_inverse=True)
    summed = np.zeros(len(codes), np.int64)
    np.add.at(summed, at, many)
    return totals, digests, codes // max(len(pairs), 1), pairs[codes % max(len(pairs), 1)], summed


def bucketed(documents: DataFrame, s: Settings) -> DataFrame:
    """One row for each bucket of documents: what is known without the corpus's counts."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = known_units(s.byte_level, s.pieces, s.room)
        number = TaskContext.get().partitionId() << 32
        ids, totals, digests, links, per_doc, times, size = [], [], [], [], [], [], 0

        def row() -> pa.RecordBatch:
            pairs, place = np.unique(np.concatenate(links), return_inverse=True)
            cells = [
                number, ids, np.concatenate(totals).astype("<i8").tobytes(), digests, pairs,
                np.bincount(place, minlength=len(pairs)), np.concatenate(per_doc), place.astype("<i4").tobytes(),
                np.concatenate(times).astype("<i8").tobytes(),
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(cells, BUCKET)], schema=BUCKET)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
            for lo, hi, block in blocks(spaced):
                found, hashes, doc, link, many = block_result(block, units)
                none = empty[lo:hi]
                found[none] = 0
                kept = ~none[doc]
                ids += names[lo:hi]
                totals.append(found)
                digests += ["" if e else h for e, h in zip(none, hashes)]
                per_doc.append(np.bincount(doc[kept], minlength=hi - lo))
                links.append(link[kept])
                times.append(many[kept])
                size += block.size
                if size >= s.bucket:
                    yield row()
                    number += 1
                    ids, totals, digests, links, per_doc, times, size = [], [], [], [], [], [], 0
        if ids:
            yield row()

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(align, BUCKET_SQL)


def aligned(documents: DataFrame, s: Settings) -> DataFrame:
    """Counts of tokens, groups and links of every document, with the digest of its groups."""
    spark = documents.sparkSession
    folder = new_folder(spark, "aligned")
    bucketed(documents, s).write.option("compression", "zstd").parquet(folder)
    buckets = spark.read.schema(BUCKET_SQL).parquet(folder)
    listed = buckets.select("bucket", F.explode(F.arrays_zip("pairs", "holders")).alias("x")).select(
        "bucket", F.col("x.pairs").alias("pair"), F.col("x.holders").alias("holders")
    )
    counts = stored(listed.groupBy("pair").agg(F.sum("holders").alias("n")), "pair-counts")
    by_a = counts.withColumn("a", F.shiftright("pair", 32))
    rated = by_a.join(by_a.groupBy("a").agg(F.max("n").alias("most")), "a").select(
        "pair", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("rate")
    )
    own = listed.select("bucket", "pair").join(rated, "pair").groupBy("bucket").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pair", "rate"))), lambda x: x["rate"]).alias("rates")
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                totals = np.frombuffer(row["totals"], "<i8").reshape(-1, 4)
                rates = np.array(row["rates"] or [], np.int64)
                place, times = np.frombuffer(row["places"], "<i4"), np.frombuffer(row["times"], "<i8")
                edge = np.concatenate([[0], np.cumsum(np.array(row["entries"], np.int64))])
                best, count = sums(times * (rates[place] & 1), edge), sums(times * (rates[place] >> 1), edge)
                columns = [pa.array(row["doc_ids"], pa.int64()), *map(pa.array, (*totals.T, best, count)), pa.array(row["digests"], pa.string())]
                names = [f.split()[0] for f in RESULT_SQL.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names)

    return buckets.drop("pairs", "holders").join(own, "bucket", "left").mapInArrow(finish, RESULT_SQL)


@query()
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Links between tokens of two tokenizers, per document."""
    s = Settings(known_path("byte_bpe_50k.json"), known_path("piece_bpe_32k.model"))
    return aligned(table(spark, folder, "documents"), s)
