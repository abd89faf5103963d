"""Packing documents into training sequences by length patterns.

The histogram of piece lengths has at most ``capacity`` bins, so it is the one
thing that reaches the driver. Patterns of up to three lengths that fill a
sequence exactly get repeat counts by non-negative least squares against the
histogram; the counts are rounded down, and what they leave is packed best fit,
longest first, again on counts. Pieces are then numbered within their length
and look up their place by that number, so no task sees more than its share.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.llm.units import tidy
from groundplan.llm.words import LOWER, Texts, blocks, find_words, hash_words, kept_in_worker, text_column
from groundplan.operators.running import running_totals
from groundplan.session import stored

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
# words whose ids a worker keeps at a time
KEPT_WORDS = 400_000
# hash buckets that split the pieces of one length
_BUCKETS = 1024
# stands between words that are encoded together
_BETWEEN = "\x01"


class WordIds:
    """Ids of words, learned from the tokenizer once and kept as arrays.

    The vocabulary lower-cases, drops white space and never merges across a
    border of letters and punctuation or beside a digit, so the ids of a text are
    those of its parts in order. Texts with the opening of a special token are encoded whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.begins, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            text = f" {_BETWEEN} ".join(part)
            if len(self.between) == 1 and text.count(_BETWEEN) == len(part) - 1:
                # without the offsets of the tokens
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(ids == self.between[0])
                if len(cuts) == len(part) - 1:
                    flat.append(ids[ids != self.between[0]])
                    sizes.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
                    continue
            own = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in part]
            flat += [np.array(ids, np.uint32) for ids in own]
            sizes.append(np.fromiter(map(len, own), np.int64, len(own)))
        return np.concatenate(flat), np.concatenate(sizes)

    def _room(self, array: np.ndarray, need: int) -> np.ndarray:
        return array if need <= len(array) else np.concatenate([array, np.zeros(max(need, 2 * len(array)) - len(array), array.dtype)])

    def learn(self, hashes: list[int], words: list[str]) -> None:
        ids, sizes = self._encode(words)
        first, total = len(self.place), len(ids)
        self.begins, self.sizes = self._room(self.begins, first + len(sizes)), self._room(self.sizes, first + len(sizes))
        self.flat = self._room(self.flat, self.used + total)
        self.sizes[first : first + len(sizes)] = sizes
        self.begins[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = ids
        self.used += total
        self.place.update(zip(hashes, range(first, first + len(sizes))))

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, each with id 0 after it, and where each text begins."""
        lowered = LOWER[texts.data]
        words = find_words(Texts(lowered, texts.offsets), split_punctuation=True, split_digits=True)
        codes, kinds = pd.factorize(hash_words(lowered, words))
        if len(self.place) + len(kinds) > KEPT_WORDS:
            self.clear()
        first_of = np.zeros(len(kinds), np.int64)
        first_of[codes[::-1]] = np.arange(len(codes))[::-1]
        hashes = kinds.tolist()
        place = [self.place.get(h, -1) for h in hashes]
        missing = [i for i, p in enumerate(place) if p < 0]
        if missing:
            at = first_of[missing]
            spans = zip(words.starts[at].tolist(), words.ends[at].tolist())
            raw = lowered.tobytes()
            self.learn([hashes[i] for i in missing], [raw[a:b].decode() for a, b in spans])
            for i in missing:
                place[i] = self.place[hashes[i]]
        place = np.array(place, np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        sizes, begins = self.sizes[place], self.begins[place]
        per_text = np.bincount(words.text_of, weights=sizes, minlength=len(texts)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(per_text + 1)])
        ids = np.zeros(bounds[-1], np.uint32)
        put = np.cumsum(sizes) - sizes + words.text_of
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids[np.repeat(put, sizes) + step] = self.flat[np.repeat(begins, sizes) + step]
        return self._special(texts, ids, bounds)

    def _special(self, texts: Texts, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        opening = np.flatnonzero((texts.data[:-1] == 60) & (texts.data[1:] == 124))
        if not len(opening):
            return ids, bounds
        rows = np.unique(np.searchsorted(texts.offsets, opening, side="right") - 1)
        parts = np.split(ids, bounds[1:-1])
        for i in rows.tolist():
            parts[i] = np.array([*self.tokenizer.encode(texts.text(i), add_special_tokens=False).ids, 0], np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def token_pieces(documents: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``capacity`` ids of every document (doc_id, text).

    A document is its token ids and one id 0; only longer ones are cut, and the
    last piece may be shorter. A null or empty text is the id 0 alone. Repeated
    rows are packed as often as they occur; other columns are ignored.
    ``with_ids`` adds the ids as little-endian 32-bit numbers.
    """
    file = vocabulary or public_tokenizers.path(VOCABULARY)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_in_worker(f"word_ids {file}", lambda: WordIds(file))
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("doc_id"))
            for first, past, texts in blocks(text_column(batch)):
                ids, bounds = words.encode(texts)
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(past - first), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(sizes[row] - start, capacity)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                spans = [raw[4 * a : 4 * b] for a, b in zip((bounds[row] + start).tolist(), (bounds[row] + start + length).tolist())]
                columns = [
                    keys.slice(first, past - first).take(pa.array(row)).cast(pa.int64()),
                    pa.array(number.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(s) for s in spans], pa.int64()),
                    *([pa.array([bytes(s) for s in spans], pa.binary())] if with_ids else []),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents.select("doc_id", "text").mapInArrow(tidy(cut), schema)


def length_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill ``capacity`` with up to three of the lengths, longest first; 0 stands for none."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True
    rows = []
    for a in lengths[lengths >= -(-capacity // 3)].tolist():
        rest = capacity - a
        b = np.arange(-(-rest // 2), min(a, rest) + 1)
        b = b[there[b] & there[rest - b]]
        rows.append(np.column_stack([np.full(len(b), a), b, rest - b]))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, weights: np.ndarray, rounds: int = 150) -> np.ndarray:
    """How often to use each pattern: weighted non-negative least squares by accelerated projected gradients."""
    size = len(histogram)

    def used(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(patterns[:, k], weights=x, minlength=size) for k in range(3))
        total[0] = 0
        return total

    # each pattern moves by its own step: how many patterns share its lengths
    shared = used(np.ones(len(patterns))) * weights
    step = 1 / np.maximum(sum(np.where(patterns[:, k] > 0, shared[patterns[:, k]], 0) for k in range(3)), 1e-9)
    x = ahead = np.zeros(len(patterns))
    momentum = 1.0
    for _ in range(rounds):
        missing = (histogram - used(ahead)) * weights
        missing[0] = 0
        new = np.maximum(ahead + step * sum(missing[patterns[:, k]] for k in range(3)), 0)
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / later * (new - x)
        x, momentum = new, later
    return x


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, on counts: sequences as (length, copies) lists, and how many there are of each."""
    groups: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    spaces: list[int] = []

    def put(space: int, content: list[tuple[int, int]], count: int) -> None:
        if space not in groups:
            groups[space] = []
            insort(spaces, space)
        groups[space].append((content, count))

    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                content, count = groups[space].pop()
                if not groups[space]:
                    del groups[space], spaces[at]
                copies = min(space // length, todo)
                full = min(count, todo // copies)
                if count > full:
                    put(space, content, count - full)
            else:
                space, content = capacity, []
                copies = min(capacity // length, todo)
                full = todo // copies
            put(space - copies * length, [*content, (length, copies)], full)
            todo -= copies * full
    return [group for space in groups for group in groups[space]]


def _plan(counts: np.ndarray, capacity: int, patterns: np.ndarray, weights: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns by their fitted repeats, rounded down, and best fit for what they leave."""
    left, planned = counts.copy(), []
    repeats = np.floor(fit_repeats(patterns, left.astype(float), weights) + 1e-9).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable")[: np.count_nonzero(repeats)].tolist():
        kinds, copies = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        times = int(min(repeats[i], (left[kinds] // copies).min()))
        if times:
            left[kinds] -= times * copies
            planned.append((list(zip(kinds.tolist(), copies.tolist())), times))
    return planned + best_fit({int(k): int(left[k]) for k in np.flatnonzero(left)}, capacity)


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Contents of all sequences for a histogram of piece lengths.

    The fit is made with several weights, the heavier ones for long pieces, which
    are harder to place; the plan with the fewest sequences is taken.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        counts[length] = count
    whole = [([(capacity, 1)], int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    patterns = length_patterns(np.flatnonzero(counts), capacity)
    patterns = patterns[patterns[:, 0] < capacity]
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    best = best_fit({int(k): int(counts[k]) for k in np.flatnonzero(counts)}, capacity)
    for power in (1, 3, 0) if len(patterns) else ():
        found = _plan(counts, capacity, patterns, (np.arange(capacity + 1) / capacity) ** power)
        best = min(found, best, key=lambda plan: sum(times for _, times in plan))
        if sum(times for _, times in best) == least:
            break
    return whole + best


def _slots(planned: list[tuple[list[tuple[int, int]], int]], width: int) -> dict[str, np.ndarray]:
    """For runs of pieces of one length, by number: the first sequence, how many go into each, and the place in it."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for content, times in planned:
        offset = 0
        for length, copies in content:
            first = taken.get(length, 0)
            rows.append((length * width + first, first, sequence, copies, offset))
            taken[length] = first + copies * times
            offset += length * copies
        sequence += times
    rows.sort()
    names = ["key", "first", "sequence", "copies", "offset"]
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (doc_id, piece, start, length, ids_crc32).

    ``pieces`` is read twice and must not change in between, see ``stored``.
    Sequences are filled from offset 0 without gaps; an empty table gives none.
    """
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    width = max(histogram.values(), default=0) + 1
    slots = _slots(plan_sequences(histogram, capacity), width)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(_BUCKETS))
    order = [F.col("_hash"), *[F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]]
    numbered = running_totals(pieces.withColumn("_hash", bucket), ["length"], F.col("_hash"), order, rank="_number").drop("_hash")
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
            at = np.searchsorted(slots["key"], length * width + number - 1, side="right") - 1
            inside = number - 1 - slots["first"][at]
            sequence = slots["sequence"][at] + inside // slots["copies"][at]
            offset = slots["offset"][at] + inside % slots["copies"][at] * length
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(tidy(place), f"{schema}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pack whole documents into as few sequences of ``capacity`` tokens as the patterns allow."""
    return pack(stored(token_pieces(documents, vocabulary, capacity)), capacity)
