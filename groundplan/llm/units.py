"""Stretches of a text that a tokenizer treats on their own, and a bounded store of what is known of them.

A text is taken as a space and its own bytes. It is cut ahead of single spaces,
so equal stretches are tokenized once per task and looked up by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa

from groundplan.llm.words import Texts, Words, hash_words

# the character U+2581, which pieces use for a space, in UTF-8
PIECE_SPACE = "▁".encode()
# bytes of stretches, and of what is kept for them, that a task remembers
KEPT_BYTES = 40_000_000


@cache
def _trim() -> Callable[[int], int]:
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Hand memory that was freed back to the system, so that a worker that lives on holds no more than it uses."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, handing freed memory back after each result and at the end of the task."""

    def tidied(batches: Iterator) -> Iterator:
        for made in run(batches):
            yield made
            give_back()
        give_back()

    return tidied


def with_space(texts: Texts) -> Texts:
    """The texts with a space put before each that is not empty."""
    sizes = np.diff(texts.offsets)
    filled = sizes > 0
    offsets = np.concatenate([[0], np.cumsum(sizes + filled)])
    data = np.full(offsets[-1], 32, np.uint8)
    inside = np.ones(len(data), bool)
    inside[offsets[:-1][filled]] = False
    data[inside] = texts.data
    return Texts(data, offsets)


def _cut(texts: Texts, ahead: np.ndarray) -> Words:
    starts = np.flatnonzero(ahead)
    ends = np.append(starts[1:], len(texts.data))
    return Words(starts, ends, np.diff(np.searchsorted(starts, texts.offsets)))


def _first_bytes(texts: Texts) -> np.ndarray:
    firsts = np.zeros(len(texts.data) + 1, bool)
    firsts[texts.offsets] = True
    return firsts[:-1]


def cut_at_spaces(texts: Texts) -> Words:
    """Runs of spaces with what follows them; no piece holds a space after another character."""
    data = texts.data
    ahead = data == 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 32
    a, b, c = PIECE_SPACE
    after[3:] |= (data[:-3] == a) & (data[1:-2] == b) & (data[2:-1] == c)
    return _cut(texts, (ahead & ~after) | _first_bytes(texts))


def cut_between_words(texts: Texts) -> Words:
    """Stretches that begin at one space between two characters that are surely no white space.

    Those are visible ASCII characters and the two-byte characters from U+00C0 on;
    other borders are left inside a stretch, which only makes it longer.
    """
    data = texts.data
    size = len(data)
    visible = (data > 32) & (data < 127)
    opening = (data >= 0xC3) & (data <= 0xDF)
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:] = visible[:-1]
    before[2:] |= opening[:-2] & (data[1:-1] >= 0x80)
    after[:-1] = visible[1:] | opening[1:]
    return _cut(texts, ((data == 32) & before & after) | _first_bytes(texts))


class Stretches:
    """Numbers of distinct stretches within a task, with whatever ``learn`` keeps for them.

    ``learn(strings)`` is called with stretches not seen before and returns about
    how many bytes it keeps; ``forget()`` empties it. When the bound is passed,
    all is forgotten ahead of the next block.
    """

    def __init__(self, learn: Callable[[list[bytes]], int], forget: Callable[[], None], most: int = KEPT_BYTES):
        self.learn, self.forget, self.most = learn, forget, most
        self.number: dict[int, int] = {}
        self.kept = 0

    def numbers(self, texts: Texts, units: Words) -> np.ndarray:
        """The number of each stretch."""
        if self.kept > self.most:
            self.number.clear()
            self.forget()
            self.kept = 0
        codes, kinds = pd.factorize(hash_words(texts.data, units))
        first = np.zeros(len(kinds), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        hashes = kinds.tolist()
        found = [self.number.get(h, -1) for h in hashes]
        missing = [i for i, n in enumerate(found) if n < 0]
        if missing:
            raw = texts.data.tobytes()
            at = first[missing]
            strings = [raw[a:b] for a, b in zip(units.starts[at].tolist(), units.ends[at].tolist())]
            new = len(self.number)
            self.kept += self.learn(strings) + 100 * len(strings)
            for n, i in enumerate(missing, new):
                found[i] = self.number[hashes[i]] = n
        return np.array(found, np.int64)[codes] if len(codes) else np.zeros(0, np.int64)


def per_text(units: Words, values: np.ndarray) -> np.ndarray:
    """Sums of the values of the stretches of each text."""
    totals = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    firsts = units.firsts
    return totals[firsts[1:]] - totals[firsts[:-1]]
