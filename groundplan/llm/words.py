"""Words of a column of texts as arrays: positions and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# bytes of text worked on at a time
BLOCK = 2_000_000

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

# classes of bytes: white space, ASCII letters and digits, ASCII punctuation other than the apostrophe, the rest
SPACE, ALNUM, PUNCTUATION, OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    for byte in range(128):
        character = chr(byte)
        if character in " \t\n\x0b\x0c\r":
            kinds[byte] = SPACE
        elif character.isalnum():
            kinds[byte] = ALNUM
        elif 33 <= byte <= 126 and character != "'":
            kinds[byte] = PUNCTUATION
    return kinds


CLASSES = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values evenly."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def _powers(base: int, count: int) -> np.ndarray:
    row = np.full(count, base, np.uint64)
    row[0] = 1
    return np.cumprod(row, dtype=np.uint64)


class Texts:
    """Texts laid end to end: their bytes and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode()


def read_texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a string column; null texts are empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    if not len(array):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    places = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(whole[places[0] : places[-1]], places - places[0])


def blocks(texts: Texts, most: int = BLOCK) -> Iterator[tuple[int, int, Texts]]:
    """Runs of whole texts of about ``most`` bytes, with the numbers of the first and the one past the last."""
    first, count = 0, len(texts)
    while first < count:
        past = int(np.searchsorted(texts.offsets, texts.offsets[first] + most, side="right")) - 1
        past = min(max(past, first + 1), count)
        a, b = texts.offsets[first], texts.offsets[past]
        yield first, past, Texts(texts.data[a:b], texts.offsets[first : past + 1] - a)
        first = past


class Words:
    """Words of some texts: first byte, byte past the last, and how many each text has."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray):
        self.starts, self.ends, self.counts = starts, ends, counts

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def firsts(self) -> np.ndarray:
        """Number of the first word of each text, and the number of all words."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def find_words(texts: Texts, split_punctuation: bool = False, split_digits: bool = False) -> Words:
    """Runs of bytes other than ASCII white space; optionally cut where ASCII letters or digits meet punctuation, and at every ASCII digit next to a letter or digit."""
    kinds = CLASSES[texts.data]
    if not len(kinds):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(texts), np.int64))
    filled = kinds != SPACE
    edge = np.empty(len(kinds) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = filled[1:] != filled[:-1]
    edge[texts.offsets] = True
    if split_punctuation:
        letters, marks = kinds == ALNUM, kinds == PUNCTUATION
        edge[1:-1] |= (letters[1:] & marks[:-1]) | (marks[1:] & letters[:-1])
    if split_digits:
        plain, digits = kinds == ALNUM, (texts.data >= 48) & (texts.data <= 57)
        edge[1:-1] |= plain[1:] & plain[:-1] & (digits[1:] | digits[:-1])
    starts = np.flatnonzero(edge[:-1] & filled)
    ends = np.flatnonzero(edge[1:] & filled) + 1
    counts = np.diff(np.searchsorted(starts, texts.offsets))
    return Words(starts, ends, counts)


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    starts, ends = words.starts, words.ends
    out = np.empty(len(starts), np.uint64)
    first = 0
    longest = int((ends - starts).max()) if len(starts) else 0
    room = max(BLOCK // 8, longest) + 1
    up, down = _powers(_MULTIPLIER, room), _powers(_INVERSE, room)
    while first < len(starts):
        base = starts[first]
        past = max(int(np.searchsorted(ends, base + room - 1, side="right")), first + 1)
        stop = ends[past - 1]
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data[base:stop]] * up[: stop - base], out=sums[1:])
        s, e = starts[first:past] - base, ends[first:past] - base
        out[first:past] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        first = past
    return mix(out)


def text_column(batch: pa.RecordBatch, name: str = "text") -> Texts:
    return read_texts(batch.column(batch.schema.get_field_index(name)))


def kept_in_worker(name: str, make: Callable):
    """What ``make`` returns, made once per worker process and name, so that later tasks find it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    kept = sys.modules.setdefault("_groundplan_worker", types.ModuleType("_groundplan_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)
