"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per task.

For a tokenizer that never joins bytes across the start of white space, a text's ids are those of its
units one after the other; a unit is a word with the white space before it. Units are hashed in NumPy,
looked up in a bounded table, and only unknown ones go through the library. Texts with white space
beyond ASCII are encoded whole, as the unit rule is not sure there.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from windrow.llm.textblock import Block, blocks

#: Code points of the white space characters beyond ASCII.
WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def known_path(name: str) -> str:
    """Where the public tokenizer files say ``name`` is."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of blocks of texts. ``spaced``: the tokenizer has ids for white space (else it drops it).

    ``literal``: special tokens that stand in a text are read as plain characters, not as the library's
    default has it, by which they get their own ids.
    """

    def __init__(self, path: str, spaced: bool, room: int = 1_500_000, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.spaced, self.room = spaced, room
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known units
        self.slot = np.zeros(0, np.int64)  # and where each one's ids begin
        self.length = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum())), length

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        body, length = self.flat(units)
        if len(self.keys) + len(keys) > self.room:
            self._forget()
        while self.used + len(body) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(body)] = body
        slot = self.used + np.cumsum(length) - length
        self.used += len(body)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slot = np.insert(self.slot, at, slot)
        self.length = np.insert(self.length, at, length)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each key in the table, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's texts, and where each text's ids begin (with the end)."""
        starts, ends, first = block.words()
        if self.spaced:
            # a unit runs from the end of the word before; white space after the last word is a unit too
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            opening = first[:-1][first[:-1] < first[1:]]
            begins[opening] = block.offs[:-1][first[:-1] < first[1:]]
            last_end = np.where(first[:-1] < first[1:], ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, block.offs[:-1])
            tail = last_end < block.offs[1:]
            lo = np.concatenate([begins, last_end[tail]])
            hi = np.concatenate([ends, block.offs[1:][tail]])
            order = np.argsort(lo, kind="stable")
            starts, ends = lo[order], hi[order]
            first = np.searchsorted(starts, block.offs)
        keys, back = np.unique(block.span_hashes(starts, ends), return_inverse=True)
        at, known = self._find(keys)
        if not known.all():
            one = np.zeros(len(keys), np.int64)
            one[back] = np.arange(len(back))
            raw = block.buf[: block.size].tobytes()
            new = one[~known]
            if len(self.keys) + len(new) > self.room:
                self._forget()
                known[:] = False
                new = one
            self._learn(keys[~known], [raw[a:z].decode() for a, z in zip(starts[new].tolist(), ends[new].tolist())])
            at, known = self._find(keys)
        size = self.length[at][back].astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.slot[at][back] - edge[:-1], size) + np.arange(edge[-1])
        ids, offsets = self.ids[place], edge[first]
        odd = self._odd(block)
        if len(odd):
            raw = block.buf[: block.size].tobytes()
            own = self.whole([raw[block.offs[d] : block.offs[d + 1]].decode() for d in odd])
            parts = np.split(ids, offsets[1:-1])
            for d, x in zip(odd, own):
                parts[d] = x
            ids = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, offsets

    @staticmethod
    def _odd(block: Block) -> np.ndarray:
        """Texts with white space beyond ASCII."""
        body, found = block.buf, np.zeros(block.size + 1, bool)
        for c in WIDE_SPACES:
            code = chr(c).encode()
            hit = np.flatnonzero(body[: block.size] == code[0])
            for k in range(1, len(code)):
                hit = hit[body[hit + k] == code[k]]
            found[hit] = True
        return np.flatnonzero(block.per_doc(found[:-1]))


@cache
def encoder(path: str, spaced: bool, literal: bool = True) -> Encoder:
    """One per Python worker, so its table lives on from task to task."""
    return Encoder(path, spaced, literal=literal)


def encoded(texts: pa.Array, path: str, spaced: bool, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and ids by the library's defaults with the end id, text by text."""
    coder = encoder(path, spaced, literal=False)
    for lo, _, block in blocks(texts):
        ids, offsets = coder.encode(block)
        closed = np.insert(ids, offsets[1:], end)
        edge = offsets + np.arange(len(offsets))
        for d in range(block.n):
            yield lo + d, closed[edge[d] : edge[d + 1]]
