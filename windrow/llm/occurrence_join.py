"""N-gram Jaccard join by T-occurrence search, and the groups of linked documents.

A document is the set of its 5-word shingles (63-bit hashes). Two link at a Jaccard similarity of 0.8,
so a partner of a document with n shingles holds at least T = ceil(0.8 n) of them.

Method (DivideSkip): of a document's n inverted lists the T - 1 longest can be set aside; every partner
stands on one of the rest, the short lists. Shingles are ordered with the frequent ones (a bounded set,
found by counting) last, so the short lists are a prefix of the ordered set; Spark's shuffle merges them.
What the merge proposes must then reach T: long lists of a query are probed by binary search after its
short ones have been counted (``t_occurrence``).

Equal sets are one node, whatever the number of copies. Most lists have one member: lists are counted
first, and a bounded filter of those with several keeps the rest out of the shuffle (where it fills up,
more is shuffled and nothing is lost). A list is not expanded into pairs: first each member meets one
hub only, the one it shares most lists with (the hub of a list is the member with the largest share of
its own lists in common with others), and what links with its hub is one component. Lists that still
hold several components are searched, in bounded chunks, for pairs of different components whose parity
bitmaps allow the overlap (an upper bound, so nothing is lost): once for the likeliest pairs that would
join the components, a forest, and once more for all that are left. Links inside a component change no
component and are not looked for. Every proposed pair is verified on whole sets, read again from the
texts of the documents in question.

Components come from alternating stars over verified links. Nothing per document goes to the driver:
only the bounded set of frequent shingles and a bounded filter of wanted nodes do.

Defined cases: null texts and texts without words are empty and linked with nothing; a text of fewer than
five words is one shingle of all its words; equal rows share a component; null ids are never the id of
a component that has another; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.components import components
from windrow.llm.frames import fresh, long_columns, stored
from windrow.llm.registry import query, table
from windrow.llm.textblock import Block, blocks, lower_ascii, mixed, owners, windows

WHOLE = np.uint64(0xA24BAED4963EE407)  # salt of texts with fewer words than a shingle
TOP = np.uint64(1 << 63)
LIST_BITS = np.uint64((1 << 32) - 1)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    frequent: int = 1 << 17  # shingles known as frequent, at most
    least: int = 24  # count from which a shingle may be one
    share: float = 0.35  # of the hash range in which prefixes lie and shingles are counted
    chunk: int = 1024  # members of a list searched together
    group: int = 1 << 20  # shingles of candidates verified together


# ---------------------------------------------------------------- sets of shingles


def shingles(block: Block, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of the shingles of all texts (with repeats) and where each text's begin."""
    block = Block(lower_ascii(block.buf), block.offs)
    starts, ends, first = block.words()
    h = block.span_hashes(starts, ends)
    run = windows(h, s.words)
    doc = owners(first, len(h))
    inside = np.flatnonzero(doc[: len(run)] == doc[s.words - 1 :][: len(run)]) if len(run) else np.zeros(0, np.int64)
    count = np.bincount(doc[inside], minlength=block.n)
    short = np.flatnonzero((count == 0) & (np.diff(first) > 0))
    own = np.array([windows(h[first[d] : first[d + 1]], first[d + 1] - first[d])[0] ^ WHOLE for d in short], np.uint64)
    own = mixed(own + np.diff(first)[short].astype(np.uint64))
    all_, at = np.concatenate([mixed(run[inside]), own]), np.concatenate([doc[inside], short])
    order = np.argsort(at, kind="stable")
    return all_[order] >> np.uint64(1), np.searchsorted(at[order], np.arange(block.n + 1))


def ordered_sets(block: Block, frequent: np.ndarray, s: Settings) -> list[np.ndarray]:
    """Each text's distinct shingles in the global order, the frequent ones (marked by the top bit) last."""
    keys, first = shingles(block, s)
    if len(frequent) and len(keys):
        at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        keys = keys | np.where(frequent[at] == keys, TOP, np.uint64(0))
    return [np.unique(keys[a:z]) for a, z in zip(first[:-1].tolist(), first[1:].tolist())]


def needed(n: np.ndarray | int, s: Settings) -> np.ndarray | int:
    """Shingles that any partner of a set of ``n`` holds."""
    return -(-s.percent * n // 100)


def node_of(keys: np.ndarray) -> int:
    """64-bit fingerprint of a set."""
    plain = keys & ~TOP
    return int((mixed(mixed(plain).sum(keepdims=True) + np.uint64(len(keys))) >> np.uint64(0)).view(np.int64)[0])


def bitmap(keys: np.ndarray) -> bytes:
    """Parity of the set's hashes in as many bits as it has members, up to a power of two."""
    bits = 64
    while bits < len(keys) and bits < 1 << 16:
        bits *= 2
    odd = np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def t_occurrence(query: np.ndarray, sets: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """Overlap of each set with the query where it reaches ``least``, else 0 (DivideSkip).

    Inverted lists of the query's members are built over the sets. Of the shorter lists all occurrences
    are counted; sets that can still reach their bound are searched in the longest lists by bisection.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    members = np.concatenate(sets) if sets else query[:0]
    at = np.minimum(np.searchsorted(query, members), max(len(query) - 1, 0))
    hit = np.flatnonzero(query[at] == members) if len(query) else np.zeros(0, np.int64)
    order = hit[np.lexsort((owner[hit], at[hit]))]
    lists, holders = at[order], owner[order]
    edge = np.searchsorted(lists, np.arange(len(query) + 1))
    length = np.diff(edge)
    t = int(least.min()) if len(least) else 0
    longest = int(t / (0.01 * np.log2(max(2, len(sets))) + 1)) if t else 0
    longest = max(0, min(longest, t - 1, len(query)))
    aside = np.zeros(len(query), bool)
    aside[np.argsort(-length, kind="stable")[:longest]] = True
    count = np.bincount(holders[~aside[lists]], minlength=len(sets))
    alive = np.flatnonzero(count >= least - longest)
    for k in np.flatnonzero(aside):
        own = holders[edge[k] : edge[k + 1]]
        if len(own) and len(alive):
            place = np.minimum(np.searchsorted(own, alive), len(own) - 1)
            count[alive[own[place] == alive]] += 1
    out = np.zeros(len(sets), np.int64)
    out[alive] = count[alive]
    return np.where(out >= least, out, 0)


# ---------------------------------------------------------------- passes over the texts


def frequent_shingles(documents: DataFrame, s: Settings) -> np.ndarray:
    """The most frequent shingles of the part of the hash range in which prefixes lie.

    A task sends the shingles that several of its texts have. Which shingles are known as frequent
    sets the order of merging, never the result.
    """
    limit = np.uint64(int(s.share * (1 << 63)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def taken() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            several = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(keys[several].view(np.int64)), pa.array(counts[several])], ["key", "n"])

        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                held.append(np.concatenate([x[x < limit] for x in ordered_sets(block, np.zeros(0, np.uint64), s)]))
                size += len(held[-1])
                if size > 1_000_000:
                    yield taken()
                    size = 0
        if held:
            yield taken()

    counts = documents.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = stored(counts.where(F.col("n") >= s.least), "frequent")
    level = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level):
        total += r.n
        if total > s.frequent:
            break
        least = r.level
    if least is None:
        return np.zeros(0, np.uint64)
    (keys,) = long_columns(counts.where(level >= least).select("key"))
    return np.sort(keys.view(np.uint64))


def prefix_of(keys: np.ndarray, s: Settings) -> np.ndarray:
    """The members of an ordered set whose lists are merged."""
    return keys[: len(keys) - needed(len(keys), s) + 1]


def shared_lists(documents: DataFrame, frequent, s: Settings) -> DataFrame:
    """``node``: 32 bits of the keys of lists that get more than one entry.

    A task enters equal sets once. Keys that agree in 32 bits only, and copies in different tasks, let
    some more lists through.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0

        def taken() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["node", "m"])

        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                for keys in ordered_sets(block, frequent.value, s):
                    name = node_of(keys) if len(keys) else None
                    if len(keys) and name not in seen:
                        seen.add(name)
                        held.append((prefix_of(keys, s) & LIST_BITS).astype(np.uint32))
                        size += len(held[-1])
                if len(seen) > 200_000:
                    seen.clear()
                if size > 1_000_000:
                    yield taken()
                    size = 0
        if held:
            yield taken()

    rows = documents.select("text").mapInArrow(count, "node long, m long")
    return rows.groupBy("node").agg(F.sum("m").alias("m")).where("m > 1").select("node")


def row_keys() -> tuple[Column, Column]:
    """Id, null ids last, and hash of the text (a null text has one of its own)."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.col("text").isNull(), F.col("text"))


def described(documents: DataFrame, frequent, shared, s: Settings) -> DataFrame:
    """``key, text_key, doc_id, node, n, prefix, bits``; the last two with a task's first copy of a set only.

    ``prefix`` holds the keys whose lists the filter ``shared`` lets through.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mask = shared.value
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, block in blocks(batch.column(3)):
                node, size, prefix, bits = [], [], [], []
                for keys in ordered_sets(block, frequent.value, s):
                    n = len(keys)
                    name = node_of(keys) if n else None
                    own = None
                    if n and name not in seen:
                        seen.add(name)
                        own = prefix_of(keys, s)
                        own = own[in_filter(own & LIST_BITS, held, mask)]
                    listed = own is not None and len(own) > 0
                    node.append(name)
                    size.append(n)
                    prefix.append(own.view(np.int64) if listed else None)
                    bits.append(bitmap(keys) if listed else None)
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in batch.columns[:3]), pa.array(node, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    ["key", "text_key", "doc_id", "node", "n", "prefix", "bits"],
                )

    key, text_key = row_keys()
    rows = documents.select(key.alias("key"), text_key.alias("text_key"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(describe, "key long, text_key long, doc_id long, node long, n long, prefix array<long>, bits binary")


def filter_of(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """A one-hash filter of the numbers in ``node``, at most 16 MB, built by Spark: words and bit mask."""
    count = nodes.count()
    bits = 1 << 16
    while bits < 32 * count and bits < 1 << 27:
        bits *= 2
    place = F.col("node").bitwiseAND(F.lit(bits - 1))
    words = nodes.select(F.shiftrightunsigned(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast((node & {bits - 1}L) & 63 as int))").alias("bit"))
    place, held = long_columns(words.groupBy("word").agg(F.bit_or("bit").alias("bits")))
    out = np.zeros(bits // 64, np.uint64)
    out[place] = held.view(np.uint64)
    return out, bits - 1


def in_filter(numbers: np.ndarray, held: np.ndarray, mask: int) -> np.ndarray:
    at = numbers & np.uint64(mask)
    return (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def sets_of(documents: DataFrame, wanted: DataFrame, frequent, s: Settings) -> DataFrame:
    """``node, keys`` of at least the documents whose row key is in ``wanted`` (column ``node``)."""
    listed = documents.sparkSession.sparkContext.broadcast(filter_of(wanted))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mask = listed.value
        for batch in batches:
            asked = in_filter(batch.column(0).to_numpy().view(np.uint64), held, mask)
            for _, _, block in blocks(batch.column(1).filter(pa.array(asked))):
                sets = [keys for keys in ordered_sets(block, frequent.value, s) if len(keys)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(keys) for keys in sets], pa.int64()), pa.array([keys.tobytes() for keys in sets], pa.binary())],
                    ["node", "keys"],
                )

    rows = documents.select(row_keys()[0].alias("key"), "text").mapInArrow(read, "node long, keys binary")
    return rows.groupBy("node").agg(F.first("keys").alias("keys"))


def verified(documents: DataFrame, pairs: DataFrame, nodes: DataFrame, frequent, s: Settings) -> DataFrame:
    """The pairs (``a, b``, size ``n`` of ``b``) that link. ``nodes`` has the ``key`` of a row of each node.

    Whole sets go to the groups that ask for them: those of one query ``a``, split by size.
    """
    load = pairs.groupBy("a").agg(F.sum("n").alias("load"))
    parts = load.select("a", F.expr(f"cast(ceil(load / {s.group}) as int)").alias("parts"))
    members = pairs.join(parts, "a").select(
        F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role")
    )
    queries = parts.select(
        F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role")
    )
    asked = stored(queries.unionByName(members), "asked")
    wanted = asked.select("node").distinct().join(nodes.select("node", "key"), "node").select(F.col("key").alias("node"))
    sets = sets_of(documents, stored(wanted, "wanted"), frequent, s)
    rows = asked.join(sets, "node").repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, query, names, sets = None, None, [], []

        def links() -> pa.RecordBatch:
            n, m = len(query), np.array([len(x) for x in sets], np.int64)
            least = -(-s.percent * (n + m) // (100 + s.percent))
            good = np.flatnonzero(t_occurrence(query, sets, least))
            return pa.RecordBatch.from_arrays(
                [pa.array([a] * len(good), pa.int64()), pa.array([names[k] for k in good], pa.int64())], ["a", "b"]
            )

        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            for head, role, node, keys in zip(*(batch.column(c).to_pylist() for c in ("a", "role", "node", "keys"))):
                if role == 0:
                    if sets:
                        yield links()
                    a, query, names, sets = head, np.frombuffer(keys, np.uint64), [], []
                else:
                    names.append(node)
                    sets.append(np.frombuffer(keys, np.uint64))
        if sets:
            yield links()

    return rows.mapInArrow(search, "a long, b long")


# ---------------------------------------------------------------- lists and their search


def folded(words: np.ndarray) -> np.ndarray:
    """Bitmaps of half the size: both halves by exclusive or."""
    half = words.shape[1] // 2
    return words[:, :half] ^ words[:, half:]


class Bitmaps:
    """Parity bitmaps of rows, laid out by their size."""

    def __init__(self, bits: list[bytes]):
        self.size = np.array([len(b) for b in bits], np.int64)
        self.place = np.zeros(len(bits), np.int64)
        self.rows, self.half = {}, {}
        for w in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == w)
            self.place[own] = np.arange(len(own))
            self.rows[w] = np.frombuffer(b"".join(bits[k] for k in own), np.uint64).reshape(len(own), -1)
            self.half[w] = folded(self.rows[w]) if w > 8 else None

    def possible(self, n: np.ndarray, i: np.ndarray, j: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of rows may link, and the share of both sets that is known to differ.

        ``n`` rises along the rows, so ``n[i] <= n[j]``.
        """
        may, differ = np.ones(len(i), bool), np.zeros(len(i))
        left, right = self.size[i], self.size[j]
        for w in np.unique(left).tolist():
            for other, rows in ((w, self.rows.get(w)), (2 * w, self.half.get(2 * w))):
                if rows is None:
                    continue
                own = np.flatnonzero((left == w) & (right == other))
                for at in range(0, len(own), 1 << 14):
                    p = own[at : at + (1 << 14)]
                    apart = np.bitwise_count(self.rows[w][self.place[i[p]]] ^ rows[self.place[j[p]]]).sum(1, dtype=np.int64)
                    total = n[i[p]] + n[j[p]]
                    may[p] = (100 + s.percent) * ((total - apart) // 2) >= s.percent * total
                    differ[p] = apart / total
        return may, differ


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the links between components, in order, connect what those before have not."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            up[x] = y
            kept.append(k)
    return kept


def listed_pairs(lists: DataFrame, nodes: DataFrame, s: Settings, likeliest: bool) -> DataFrame:
    """Pairs ``a, b`` of different components that share a list and may link.

    Rows (``key, node, root``) of a list longer than a chunk are searched chunk against chunk; sizes and
    bitmaps of ``nodes`` join them last.
    ``likeliest`` keeps of the pairs found together only a forest over the components, those with the
    least known difference first: fewer than rows.
    """
    sizes = lists.groupBy("key").agg(F.count("*").alias("m"))
    rows = lists.join(sizes.select("key", F.expr(f"cast(ceil(m / {s.chunk}) as int)").alias("parts")), "key")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(
        "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "root"
    )
    rows = rows.join(nodes.select("node", "n", "bits"), "node").select("key", "x", "y", "own", "node", "n", "root", "bits")
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "n")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            held = pa.Table.from_batches([batch])
            held = pa.concat_tables([rest, held]) if rest is not None else held
            # the last group may go on in the next batch
            last = [held.column(c)[held.num_rows - 1].as_py() for c in ("key", "x", "y")]
            edge = held.num_rows
            same = np.ones(held.num_rows, bool)
            for c, v in zip(("key", "x", "y"), last):
                same &= held.column(c).to_numpy() == v
            edge = int(np.argmax(same))
            if edge:
                yield found(held.slice(0, edge))
            rest = held.slice(edge)
        if rest is not None and rest.num_rows:
            yield found(rest)

    def found(t: pa.Table) -> pa.RecordBatch:
        key, x, y, own, node, n, root = (t.column(k).to_numpy() for k in ("key", "x", "y", "own", "node", "n", "root"))
        bits = Bitmaps(t.column("bits").to_pylist())
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        group = np.cumsum(new)
        alive, gap, pairs = np.arange(len(key)), 0, []
        while len(alive):
            gap += 1
            alive = alive[alive + gap < len(key)]
            j = alive + gap
            near = (group[alive] == group[j]) & (100 * n[alive] >= s.percent * n[j])
            alive, j = alive[near], j[near]
            open_ = (root[alive] != root[j]) & ((x[alive] == y[alive]) | (own[alive] != own[j]))
            i, k = alive[open_], j[open_]
            if len(i):
                may, differ = bits.possible(n, i, k, s)
                pairs.append((i[may], k[may], differ[may]))
        i, k, differ = (np.concatenate(c) for c in zip(*pairs)) if pairs else (key[:0], key[:0], key[:0])
        if likeliest:
            order = np.lexsort((node[k], node[i], differ))
            i, k = i[order], k[order]
            kept = forest(root[i], root[k])
            i, k = i[kept], k[kept]
        both = np.unique(np.stack([np.minimum(node[i], node[k]), np.maximum(node[i], node[k])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in both], ["a", "b"])

    return rows.mapInArrow(search, "a long, b long").distinct()


def links(documents: DataFrame, docs: DataFrame, frequent, s: Settings) -> DataFrame:
    """Verified links (``a, b``) that connect every component of nodes."""
    first = docs.where("prefix is not null")
    share = F.size("prefix") / (F.col("n") - F.ceil(F.col("n") * s.percent / 100) + 1)
    postings = first.select("node", share.alias("share"), F.explode("prefix").alias("key"))
    heads = postings.groupBy("key").agg(
        F.max(F.struct("share", "node"))["node"].alias("hub"), F.min("node").alias("lo"), F.max("node").alias("hi")
    ).where("lo <> hi").drop("lo", "hi")
    lists = stored(postings.drop("share").join(heads, "key").distinct(), "lists")
    nodes = first.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("key").alias("key"))
    nodes = stored(nodes.join(lists.select("node").distinct(), "node", "left_semi"), "nodes")

    met = lists.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("met"))
    side = nodes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("bits").alias("hub_bits"))
    near = met.join(nodes.drop("key"), "node").join(side, "hub").where(100 * F.least("n", "hub_n") >= s.percent * F.greatest("n", "hub_n"))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hub_n = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            both = batch.column(4).to_pylist() + batch.column(5).to_pylist()
            size = np.concatenate([n, hub_n])
            order = np.argsort(size, kind="stable")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            i, j = back[: len(n)], back[len(n) :]
            may, _ = Bitmaps([both[k] for k in order]).possible(size[order], np.minimum(i, j), np.maximum(i, j), s)
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(may)) for c in (batch.column(0), batch.column(1), batch.column(2), batch.column(6))],
                ["node", "n", "hub", "met"],
            )

    sifted = near.select("node", "n", "hub", "hub_n", "bits", "hub_bits", "met").mapInArrow(sift, "node long, n long, hub long, met long")
    best = sifted.groupBy("node").agg(F.max(F.struct("met", "hub", "n")).alias("best"))
    pairs = stored(best.select(F.col("best.hub").alias("a"), F.col("node").alias("b"), F.col("best.n").alias("n")), "hub-pairs")
    found = stored(verified(documents, pairs, nodes, frequent, s), "hub-links")
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    for likeliest in (True, False):
        roots = stored(components(found), "roots")
        marked = lists.drop("hub").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = marked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        lists = stored(marked.join(several, "key").select("key", "node", "root"), "lists")
        pairs = stored(listed_pairs(lists, nodes, s, likeliest).join(tested, ["a", "b"], "left_anti"), "pairs")
        sized = pairs.join(nodes.select(F.col("node").alias("b"), "n"), "b")
        found = found.unionByName(stored(verified(documents, sized, nodes, frequent, s), "links"))
        tested = tested.unionByName(pairs)
        lists = lists.drop("root").withColumn("hub", F.lit(0))
    return found


def rooted(documents: DataFrame, s: Settings) -> DataFrame:
    """``key, text_key, doc_id, n, root``: every row with a node of its component (null: no words).

    ``key`` is the id, null ids last.
    """
    frequent = documents.sparkSession.sparkContext.broadcast(frequent_shingles(documents, s))
    shared = stored(shared_lists(documents, frequent, s), "shared")
    listed = documents.sparkSession.sparkContext.broadcast(filter_of(shared))
    docs = stored(described(documents, frequent, listed, s), "described")
    roots = stored(components(links(documents, docs, frequent, s)), "roots")
    rows = docs.select("key", "text_key", "doc_id", "node", "n").join(roots, "node", "left")
    return stored(rows.withColumn("root", F.coalesce("root", "node")).drop("node"), "rooted")


def grouped(documents: DataFrame, s: Settings | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    rows = rooted(documents, s or Settings())
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )


def one_of_each(documents: DataFrame, s: Settings | None = None) -> DataFrame:
    """One row of each group of linked documents, all columns as they are: that of the least id.

    Where several rows of a group have the least id, the one whose text hash is lowest stays. Rows
    without words are groups of their own. Of rows equal in id and text one stays.
    """
    rows = rooted(documents, s or Settings())
    names = [fresh(documents, "key"), fresh(documents, "text_key")]
    same = F.struct("key", "text_key")
    least = rows.where("root is not null").groupBy("root").agg(F.min(same).alias("least"))
    stays = F.coalesce(F.col("least") == same, F.lit(True))
    state = rows.join(least, "root", "left").groupBy("key", "text_key").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("rows"))
    state = stored(state.where("not stays or rows > 1").withColumnsRenamed(dict(zip(("key", "text_key"), names))), "state")
    # a filter passes most rows without a shuffle; only those it names are joined
    number = F.xxhash64(*names)
    listed = documents.sparkSession.sparkContext.broadcast(filter_of(state.select(number.alias("node"))))

    def sifted(named: bool) -> DataFrame:
        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = in_filter(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64), *listed.value)
                yield batch.filter(pa.array(found == named)).select(range(batch.num_columns - 1))

        marked = documents.withColumns(dict(zip(names, row_keys())))
        return marked.withColumn(fresh(marked, "number"), number).mapInArrow(sift, marked.schema)

    once = sifted(True).join(state, names, "left_anti")
    several = sifted(True).join(state.where("stays").select(*names), names, "left_semi").dropDuplicates(names)
    return sifted(False).unionByName(once).unionByName(several).select(*documents.columns)


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
grams AS (
  SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN 'all ' || array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
linked AS (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.r < y.r GROUP BY 1, 2)
  JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT r AS a, r AS b FROM docs UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id
FROM docs d LEFT JOIN sizes USING (r) JOIN reach ON reach.a = d.r JOIN docs e ON e.r = reach.b GROUP BY d.r, d.doc_id, n
"""


@query(ORACLE)
def op6_occurrence_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under shingle similarity of 0.8."""
    return grouped(table(spark, folder, "documents"))
