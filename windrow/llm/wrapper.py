"""HTML extraction: wrapper induction over pages of one host.

Method: the pages of every host, dealt by hash into groups of about ``Settings.group``, are read as
trees, runs of equal siblings folded, and each is aligned by simple tree matching, the ordered matching of
most nodes, with the page of its group that is laid out most like it; equal and differing texts are counted
per place over all groups of the host. A place of the tree whose text is the same on aligned pages that are otherwise
unlike is template; a place whose text varies is a slot. Slots are content unless what they stand in
says otherwise: an element or class for menus, headers, footers, side bars, notices, adverts, forms or
comments, or text that is mostly links. Where a page has an article or main element, slots outside of it
are no content. The wrapper of a host is the list of its places with their roles, learned
from blocks that are not dropped for what they stand in (an id or role tells parts of one place apart); every
page of the host is then read once more, and blocks at content places are its text. Places that stand on
too few unlike pages follow the same rules without the constancy test.

Groups are gathered as paths and text hashes; counts per place are summed by shuffle. All pages are extracted
where they are read. Defined cases: null or empty html gives an empty text; a null or odd url belongs to
the host without a name; unclosed and stray tags, unknown entities and cut pages are read as far as they
go; repeated rows give the same text each. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.frames import stored
from windrow.llm.registry import query, table

# Element names of the HTML standard, and words that sites use for parts that are not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = RAW | set("head nav footer aside form button select option input menu dialog search label object audio video canvas".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
DROPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer "
    "comment comments commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe "
    "subscription signup login widget widgets pagination pager toolbar masthead topbar".split()
)
# Words of the list that also stand in the names of an article's own sections, and words that make no section of them.
SHARED_WORDS = set("social related share shares sharing notice notices alert reply replies respond".split())
PLAIN_WORDS = set("a and area bar block box button buttons container content foot group icons inner item items link links list outer post posts section site the top wrap wrapper".split())
PARTS = set("ad ads advert comment comments reply sponsored related".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


@dataclass(frozen=True)
class Settings:
    group: int = 64  # pages of a host that are compared in one group; all pages are in one
    same: float = 0.9  # share of aligned unlike pages with equal text that makes a place template
    least: int = 3  # aligned pairs needed for that
    links: float = 0.6  # share of linked text from which a slot is a menu


class Element:
    __slots__ = ("tag", "label", "path", "dropped", "inside", "block")

    def __init__(self, tag: str, label: str, path: str, dropped: bool, inside: bool, block: bool):
        self.tag, self.label, self.path, self.dropped, self.inside, self.block = tag, label, path, dropped, inside, block


def names_a_part(token: str) -> bool:
    """Whether a class or id names something that is no part of an article.

    A word that also fits a section's subject (``social-history``) counts only beside words that name none.
    """
    words = set(re.split(r"[^a-z]+", token)) - {""}
    sure = words & (DROPPED_WORDS - SHARED_WORDS)
    return bool(sure) or bool(words & SHARED_WORDS) and words <= DROPPED_WORDS | PLAIN_WORDS


@lru_cache(maxsize=4096)
def described(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """Label of an element, and whether the element itself is no part of an article."""
    label, dropped = tag, tag in DROPPED or (tag == "header" and not inside)
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        words = set(re.split(r"[^a-z]+", value))
        if name == "hidden":
            dropped = dropped or "hidden" in attributes.lower().split("=")[0]
        elif name == "role":
            dropped = dropped or bool(words & DROPPED_ROLES)
        elif tag == "article":  # a theme's class words say much about an article; only a whole name tells a part
            dropped = dropped or bool(set(value.split()) & PARTS)
        elif tag not in ("html", "body", "main"):
            dropped = dropped or any(names_a_part(token) for token in value.split())
            if name == "class" and value:
                label = f"{tag}.{'.'.join(sorted(value.split()))}"
    return label, dropped


def blocks_of(html: str) -> Iterator[tuple[str, str, int, bool, bool]]:
    """Blocks in page order: path, text, linked characters, dropped by what it stands in, in an article."""
    root = Element("", "", "", False, False, True)
    stack, parts, linked, links = [root], [], 0, 0
    holder = root

    def flush() -> tuple | None:
        nonlocal parts, linked
        if not parts:
            return None
        text = " ".join(unescape("".join(parts)).split())
        row = (holder.path, text, linked, holder.dropped, holder.inside) if text else None
        parts, linked = [], 0
        return row

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            top = stack[-1]
            if top.dropped and not holder.dropped:
                pass  # an inline part that is no part of the article
            else:
                parts.append(text)
                if links:
                    linked += len(text)
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if any(e.block for e in stack[k:]):
                        row = flush()
                        if row:
                            yield row
                    links -= sum(e.tag == "a" for e in stack[k:])
                    del stack[k:]
                    break
            else:
                if tag == "p" or tag in BLOCKS:
                    row = flush()
                    if row:
                        yield row
        else:
            block = tag in BLOCKS
            if block:
                row = flush()
                if row:
                    yield row
                closes = CLOSED_BY.get(tag, ())
                scope = SCOPES.get(tag, ())
                cut = None
                for k in range(len(stack) - 1, 0, -1):
                    e = stack[k]
                    if e.tag in scope:
                        break
                    if e.tag in closes or e.tag == "p":
                        cut = k
                    elif e.block and e.tag not in ("p", *closes) and not closes:
                        break
                if tag not in ("head", "title", "html"):
                    cut = next((k for k, e in enumerate(stack) if e.tag == "head"), cut)
                if cut is not None:
                    links -= sum(e.tag == "a" for e in stack[cut:])
                    del stack[cut:]
            elif tag == "br":
                parts.append(" ")
            if tag in VOID:
                continue
            top = stack[-1]
            label, dropped = described(tag, m.group(3), top.inside)
            path = f"{top.path}/{label}" if block else top.path
            stack.append(Element(tag, label, path, top.dropped or dropped, top.inside or tag in ("article", "main"), block))
            links += tag == "a"
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else n
                stack.pop()
                if block:
                    flush()
        holder = next(e for e in reversed(stack) if e.block)
    row = flush()
    if row:
        yield row


class Node:
    """A place of a page's tree with the texts that stand there; equal siblings are one node."""

    __slots__ = ("label", "texts", "children", "path", "shape", "size")

    def __init__(self, label: str, path: str):
        self.label, self.path, self.texts, self.children, self.shape, self.size = label, path, [], [], 0, 1


def tree(page: list[tuple[str, str, int, bool, bool]]) -> Node:
    """The tree of the places of a page's blocks, in page order, runs of equal siblings folded.

    Nodes know their size and a hash of their shape.
    """
    root = Node("", "")
    made = [root]
    for path, text, *_ in page:
        node, full = root, ""
        for label in path.split("/")[1:]:
            full += "/" + label
            if not node.children or node.children[-1].label != label:
                node.children.append(Node(label, full))
                made.append(node.children[-1])
            node = node.children[-1]
        node.texts.append(text)
    for node in reversed(made):  # children before their parents
        node.shape = hash((node.label, *(c.shape for c in node.children)))
        node.size += sum(c.size for c in node.children)
    return root


def unlike(a: Node, b: Node) -> tuple[int, int]:
    """How many children at the start and at the end of both lists have equal shapes.

    They match each other in a largest matching.
    """
    x, y = a.children, b.children
    m, n, start, end = len(x), len(y), 0, 0
    while start < min(m, n) and x[start].shape == y[start].shape:
        start += 1
    while end < min(m, n) - start and x[m - 1 - end].shape == y[n - 1 - end].shape:
        end += 1
    return start, end


SMALL = 64  # pairs of children up to which a row of sums is faster without NumPy


def sums_below(top, weights: list, rows: list[int], right, small: bool) -> list:
    """Greatest total weights of chains up to each child, a row for each of ``rows`` below the row ``top``."""
    out = [top]
    for r in rows:
        last = out[-1]
        if small:
            row = [0]
            for j, k in enumerate(right):
                w = weights[r][k]
                row.append(max(last[j + 1], row[j], last[j] + w))
        else:
            row = np.empty_like(last)
            row[0] = 0
            np.maximum(last[1:], last[:-1] + weights[r][right], out=row[1:])
            np.maximum.accumulate(row, out=row)
        out.append(row)
    return out


def heaviest(left: list[int], right: list[int], weights: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """The chain of pairs, rising on both sides, with the greatest total weight, and that weight.

    ``left`` and ``right`` number the kinds of the two lists, ``weights`` holds a row for each kind on the left (0: no
    match). Every pair is tried. Only each ``step``-th row of sums is kept; the rows between are summed again.
    """
    small = len(left) * len(right) <= SMALL
    top = [0] * (len(right) + 1) if small else np.zeros(len(right) + 1, np.int64)
    if not small:
        weights, right = [np.array(w, np.int64) for w in weights], np.array(right)
    step = max(16, int(len(left) ** 0.5))
    kept = [top]
    for lo in range(0, len(left), step):
        kept.append(sums_below(kept[-1], weights, left[lo : lo + step], right, small)[-1])
    best, out, i, j, rows = int(kept[-1][-1]), [], len(left), len(right), []
    while i and j:
        lo = (i - 1) // step * step
        if not rows:
            rows = sums_below(kept[lo // step], weights, left[lo : lo + step], right, small)
        here = rows[i - lo][j]
        if here == rows[i - lo - 1][j]:
            i -= 1
        elif here == rows[i - lo][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
        if i == lo:
            rows = []
    return best, out[::-1]


def kinds(nodes: list[Node]) -> tuple[list[Node], list[int]]:
    """One node of each shape, and the number of each node's shape."""
    first = {x.shape: x for x in reversed(nodes)}
    number = {shape: k for k, shape in enumerate(first)}
    return list(first.values()), [number[x.shape] for x in nodes]


def aligned(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size of the largest ordered matching of two trees, and its pairs.

    Pairs of shapes are listed from the roots down and matched from the smallest up, without recursion: what two nodes
    match depends on their shapes alone. Nodes of equal shape match as a whole.
    """
    if a.label != b.label:
        return 0, []
    listed, at, below = [(a, b)], {(a.shape, b.shape): 0}, []
    for x, y in listed:  # grows while it is read
        if x.shape == y.shape:
            below.append(None)
            continue
        start, end = unlike(x, y)
        (p, left), (q, right) = kinds(x.children[start : len(x.children) - end]), kinds(y.children[start : len(y.children) - end])
        below.append((start, end, p, left, q, right))
        for c in p:
            for d in q:
                if c.label == d.label and c.shape != d.shape and (c.shape, d.shape) not in at:
                    at[c.shape, d.shape] = len(listed)
                    listed.append((c, d))
    size, chains = [0] * len(listed), [None] * len(listed)
    for k in sorted(range(len(listed)), key=lambda k: listed[k][0].size):  # children are smaller than their parents
        (x, y), under = listed[k], below[k]
        if under is None:
            size[k] = x.size
            continue
        start, end, p, left, q, right = under
        weights = [[0 if c.label != d.label else c.size if c.shape == d.shape else size[at[c.shape, d.shape]] for d in q] for c in p]
        total, chain = heaviest(left, right, weights) if left and right else (0, [])
        m, n = len(x.children), len(y.children)
        whole = [(i, i) for i in range(start)] + [(m - i, n - i) for i in range(end, 0, -1)]
        size[k] = 1 + total + sum(x.children[i].size for i, _ in whole)
        chains[k] = [(start + i, start + j) for i, j in chain] + whole
    found, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        found.append((x, y))
        pairs = zip(x.children, y.children) if x.shape == y.shape else ((x.children[i], y.children[j]) for i, j in chains[at[x.shape, y.shape]])
        todo += pairs
    return size[0], found


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def counted(pages: list[list[tuple[str, int]]]) -> dict[str, list[int]]:
    """Place to how many aligned pairs of unlike pages have equal and differing texts there.

    Pages are path and text of their blocks. Each is aligned with the unlike page of the list whose places are most like its own.
    """
    pages = list(dict.fromkeys(tuple(p) for p in pages))  # copies say nothing
    trees = [tree(p) for p in pages]
    texts, places = [{x[1] for x in p} for p in pages], [{x[0] for x in p} for p in pages]
    found: dict[str, list[int]] = {}
    for k, t in enumerate(trees):
        best, other = -1.0, None
        for step in range(1, len(trees)):
            i = (k + step) % len(trees)
            if 2 * len(texts[k] & texts[i]) > min(len(texts[k]), len(texts[i])):
                continue  # alike as a whole: equal text says nothing about the template
            shared = len(places[k] & places[i])
            like = shared / (len(places[k]) + len(places[i]) - shared)
            if like > best:
                best, other = like, trees[i]
        for x, y in aligned(t, other)[1] if other else ():
            if x.texts and y.texts:
                found.setdefault(x.path, [0, 0])[x.texts != y.texts] += 1
    return found


def main_text(html: str, roles: dict[str, bool], links: float = Settings.links) -> str:
    """Text of the blocks at content places.

    Articles and main elements are the page's content if what they hold is most of its text; teasers beside a
    longer story are not.
    """
    page = [x for x in blocks_of(html) if not x[3]]
    prose = lambda x: len(x[1]) if x[2] <= links * len(x[1]) else 0
    inner = sum(prose(x) for x in page if x[4])
    articles = inner > 0 and 2 * inner >= sum(map(prose, page))
    kept = []
    for path, text, linked, _, inside in page:
        if articles and not inside:
            continue
        if roles.get(path, inside or linked <= links * len(text)):
            kept.append(text)
    return "\n\n".join(kept)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


PLACES = "path string, same long, differ long, length long, linked long, blocks long, menus long, inside boolean"


def places(pages: DataFrame, s: Settings) -> DataFrame:
    """``host`` and per group of its pages what is counted at each place, over all pages."""
    draw = F.xxhash64("page_id", "url", F.lit(23))
    rows = pages.where(F.length("html") > 0).select(host(F.col("url")).alias("host"), draw.alias("draw"), "html")
    schema = "host string, draw long, paths array<string>, texts array<long>, length array<int>, linked array<int>, inside array<boolean>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # what is dropped anyway says nothing about its place
            pages = [[x for x in blocks_of(h) if not x[3]] for h in batch.column(2).to_pylist()]
            lists = [
                pa.array([[x[0] for x in p] for p in pages], pa.list_(pa.string())),
                pa.array([[digest(x[1]) for x in p] for p in pages], pa.list_(pa.int64())),
                pa.array([[len(x[1]) for x in p] for p in pages], pa.list_(pa.int32())),
                pa.array([[x[2] for x in p] for p in pages], pa.list_(pa.int32())),
                pa.array([[x[4] for x in p] for p in pages], pa.list_(pa.bool_())),
            ]
            names = ["host", "draw", "paths", "texts", "length", "linked", "inside"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], names)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("draw")
        found = {path: [*n, 0, 0, 0, 0, False] for path, n in counted([list(zip(p, t)) for p, t in zip(rows.paths, rows.texts)]).items()}
        for page in zip(rows.paths, rows.length, rows.linked, rows.inside):
            for path, length, linked, inside in zip(*page):
                n = found.setdefault(path, [0, 0, 0, 0, 0, 0, False])
                n[2] += int(length)
                n[3] += int(linked)
                n[4] += 1
                n[5] += not inside and linked > s.links * length
                n[6] = bool(inside)
        names = [f.split()[0] for f in PLACES.split(", ")]
        out = pd.DataFrame([(path, *n) for path, n in found.items()], columns=names)
        out.insert(0, "host", rows.host.iloc[0])
        return out

    sizes = rows.groupBy("host").agg(F.ceil(F.count("*") / s.group).alias("groups"))
    grouped = rows.mapInArrow(read, schema).join(stored(sizes, "hosts"), "host").withColumn("part", F.pmod("draw", "groups")).drop("groups")
    return grouped.groupBy("host", "part").applyInPandas(count, f"host string, {PLACES}")


def wrappers(pages: DataFrame, s: Settings) -> DataFrame:
    """``host, roles`` of the places that differ from what ``main_text`` takes by itself; roles as JSON."""
    n = {c: F.sum(c).alias(c) for c in ("same", "differ", "length", "linked", "blocks", "menus")}
    found = places(pages, s).groupBy("host", "path").agg(*n.values(), F.max("inside").alias("inside"))
    constant = (F.col("same") >= s.least) & (F.col("same") >= s.same * (F.col("same") + F.col("differ")))
    menu = (F.col("linked") > s.links * F.col("length")) & ~F.col("inside")
    found = found.withColumn("role", ~(constant | menu))
    found = found.where(F.when(F.col("role"), F.col("menus") > 0).otherwise(F.col("menus") < F.col("blocks")))
    return found.groupBy("host").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", "role")))).alias("roles"))


def extracted(pages: DataFrame, s: Settings | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    s = s or Settings()
    learned = stored(wrappers(pages, s), "wrappers")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(learned, "host", "left")
    schema = "page_id long, url string, text string, n_chars long"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roles_of = lru_cache(maxsize=1024)(json.loads)
        for batch in batches:
            texts = [
                main_text(h, roles_of(r) if r else {}, s.links) if h else ""
                for h, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return rows.select(F.col("page_id").cast("long"), "url", "html", "roles").mapInArrow(extract, schema)


@query()
def op10_wrapper(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extracted(table(spark, folder, "pages"))
