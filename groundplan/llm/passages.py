"""Repeated passages across documents by compact windows.

The tokens of a text are its word shingles. The Cartesian tree over the token
hashes gives compact windows: the widest span in which one token is the
smallest, so every run of tokens inside that span around the token has this
minimum. Two passages at the threshold have a run of ``RUN`` tokens in common,
so texts that share one meet on the minimum of that run. Inside the spans of
minima that several texts hold, equal passages meet as classes, and texts that
meet otherwise are compared by what stands around the minimum. What remains is
verified on the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundplan.llm.components import components
from groundplan.llm.minhash import shingles
from groundplan.llm.words import Texts, blocks, mix, read_texts
from groundplan.session import stored

SIZE = 5  # words in a shingle
LEAST_WORDS = 50  # in a passage
PERCENT = 80  # of the shingles of two passages that are shared
# shingles in a passage of the least length
WIDTH = LEAST_WORDS - SIZE + 1
# shingles in a row that two passages at the threshold share at least: a changed word takes five, and 46 bear one
RUN = 21
# shingles beyond the end of such a run within which the next shared one lies
REACH = 24
# shingles kept on either side of a minimum: a run short of a passage and what is next to it
AROUND = WIDTH - 2 + REACH
# repeats of shingles around a minimum from which on similarity cannot be told from neighbouring runs, since a passage counts each once
REPEATED = 3
# texts under one minimum that are compared one by one
MANY = 100
# texts of a larger group that meet all others at first, and pairs of texts that are compared one by one after that
HUBS, DIRECT = 8, 30_000
# texts under one minimum that a task compares at a time, twice over
BLOCK_TEXTS = 20_000
_MULTIPLIER = 0x9E3779B97F4A7C15
# unmatched shingles that a passage may have in a row: those of two changed words, of one, none
_GAPS = (10, 5, 0)


def compact_windows(values: np.ndarray, width: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows of at least ``width`` tokens: place of the minimum, first and last token.

    ``values`` are positive, zeros part the texts, none of which is longer than
    ``longest``. Of equal values the first is the smallest.
    """
    count = len(values)
    none = np.zeros(0, np.int64)
    if count < width:
        return none, none, none
    levels = [values]
    while 2 ** len(levels) <= min(longest + 1, count):
        step, last = 2 ** (len(levels) - 1), levels[-1]
        levels.append(np.minimum(last[:-step], last[step:]))
    top = min(int(np.log2(width)), len(levels) - 1)
    rest = width - 2**top
    least = np.minimum(levels[top][: count - width + 1], levels[top][rest : rest + count - width + 1])
    # a token heads a window wide enough if it is the minimum of some window of just that width
    most = np.concatenate([np.zeros(width - 1, values.dtype), least, np.zeros(width - 1, values.dtype)])
    for j in range(top):
        most = np.maximum(most[: -(2**j)], most[2**j :])
    most = np.maximum(most[: count], most[rest : rest + count])
    heads = np.flatnonzero((most == values) & (values > 0))
    own, left, right = values[heads], heads.copy(), heads + 1
    for j in range(len(levels) - 1, -1, -1):
        step, level = 2**j, levels[j]
        back = np.maximum(left - step, 0)
        left = np.where((left >= step) & (level[np.minimum(back, len(level) - 1)] > own), back, left)
        fits = right + step <= count
        right = np.where(fits & (level[np.minimum(right, len(level) - 1)] >= own), right + step, right)
    wide = right - left >= width
    return heads[wide], left[wide], right[wide] - 1


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Anchors:
    """Minima of the compact windows of some texts: text, place in all shingles, bounds of the window, and key."""

    def __init__(self, texts: Texts):
        self.flat, self.bounds = shingles(texts, SIZE)
        sizes = np.diff(self.bounds)
        room = np.zeros(len(self.flat) + len(sizes) + 1, np.uint64)
        # one zero ahead of each text
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        room[np.arange(len(self.flat)) + text_of + 1] = np.where(sizes[text_of] >= WIDTH, mix(self.flat) | np.uint64(1), np.uint64(0))
        heads, left, right = compact_windows(room, RUN, int(sizes.max(initial=0)))
        self.text = np.searchsorted(self.bounds[:-1] + np.arange(1, len(sizes) + 1), heads, side="right") - 1
        self.at, self.left, self.right = (x - self.text - 1 for x in (heads, left, right))
        self.key = mix(self.flat[self.at]).view(np.int64)

    def keep(self, rows: np.ndarray) -> None:
        for name in ("text", "at", "left", "right", "key"):
            setattr(self, name, getattr(self, name)[rows])


def _first_rows(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the first of equal rows."""
    order = np.lexsort(columns)
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[order][1:] != c[order][:-1]
    return np.sort(order[fresh])


def anchor_rows(documents: DataFrame) -> DataFrame:
    """Keys of the minima of each text of documents (doc_id, text), with the hash of the text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, past, texts in blocks(read_texts(batch.column(0))):
                anchors = _Anchors(texts)
                anchors.keep(_first_rows(anchors.key, anchors.text))
                yield pa.RecordBatch.from_arrays([pa.array(anchors.key), batch.column(1).take(pa.array(first + anchors.text))], ["key", "text_hash"])

    return _hashed(documents).select("text", "text_hash").mapInArrow(make, "key long, text_hash long")


def _hashed(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def repeating_texts(documents: DataFrame) -> DataFrame:
    """Different texts that share minima: (text_hash, doc_id, text, keys), with the smallest doc_id of each.

    ``keys`` are the shared minima and how many different texts hold each.
    """
    rows = anchor_rows(documents).repartition("key")
    key = Window.partitionBy("key")
    several = rows.withColumn("_rows", F.count(F.lit(1)).over(key)).filter(F.col("_rows") > 1).select("key", "text_hash").distinct()
    several = several.withColumn("texts", F.count(F.lit(1)).over(key)).filter(F.col("texts") > 1)
    lists = several.groupBy("text_hash").agg(F.collect_list("key").alias("keys"), F.collect_list("texts").alias("texts"))
    hashed = _hashed(documents)
    firsts = hashed.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).join(lists, "text_hash")
    return hashed.join(firsts, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("text_hash", "doc_id", "text", "keys", "texts")


def _shared_anchors(batch: pa.RecordBatch) -> Iterator[tuple[_Anchors, np.ndarray, np.ndarray, np.ndarray]]:
    """Minima of texts (text_hash, text, keys, texts) that other texts hold, the text hash of each, how many hold it, and the hashes of all texts."""
    hashes = batch.column(0).to_numpy(zero_copy_only=False)
    keys, texts = batch.column(2), batch.column(3)
    for first, past, part in blocks(read_texts(batch.column(1))):
        anchors = _Anchors(part)
        lists = keys.slice(first, past - first)
        # collected lists have no nulls
        held = lists.flatten().to_numpy(zero_copy_only=False)
        counts = texts.slice(first, past - first).flatten().to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(past - first), lists.value_lengths().to_numpy(zero_copy_only=False))
        code = lambda key, row: key.view(np.uint64) ^ mix(row.astype(np.uint64))
        wanted = code(held, text)
        order = np.argsort(wanted)
        have = code(anchors.key, anchors.text)
        place = order[np.minimum(np.searchsorted(wanted[order], have), len(order) - 1)] if len(order) else np.zeros(len(have), np.int64)
        there = np.flatnonzero(wanted[place] == have) if len(order) else np.zeros(0, np.int64)
        anchors.keep(there)
        yield anchors, hashes[first + anchors.text], counts[place[there]], hashes[first:past]


def passage_rows(texts: DataFrame) -> DataFrame:
    """Hashes of the passages of the least length all of whose runs have minima that other texts hold."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchors, _, _, hashes in _shared_anchors(batch):
                flat = anchors.flat
                # a run of RUN shingles whose minimum is shared begins from ``low`` to ``high``
                low, high = np.maximum(anchors.left, anchors.at - RUN + 1), np.minimum(anchors.at, anchors.right - RUN + 1)
                marks = np.bincount(low, minlength=len(flat) + 1) - np.bincount(high + 1, minlength=len(flat) + 1)[: len(flat) + 1]
                runs = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])
                more = WIDTH - RUN + 1
                begin = np.flatnonzero(runs[more:] - runs[:-more] == more)
                up, down = (_powers(x, len(flat) + 1) for x in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat) * up[:-1], dtype=np.uint64)])
                passage = mix((sums[begin + WIDTH] - sums[begin]) * down[begin]).view(np.int64)
                text = np.searchsorted(anchors.bounds, begin, side="right") - 1
                rows = _first_rows(passage, text)
                yield pa.RecordBatch.from_arrays([pa.array(passage[rows]), pa.array(hashes[text[rows]])], ["passage", "text_hash"])

    return texts.select("text_hash", "text", "keys", "texts").mapInArrow(make, "passage long, text_hash long")


def equal_pairs(texts: DataFrame) -> DataFrame:
    """Texts that hold a passage of the least length word for word, each tied to the first that holds it: (a, b)."""
    rows = passage_rows(texts).repartition("passage")
    rows = rows.withColumn("a", F.min("text_hash").over(Window.partitionBy("passage")))
    return rows.filter(F.col("a") != F.col("text_hash")).select("a", F.col("text_hash").alias("b")).distinct()


def surrounding_rows(texts: DataFrame) -> DataFrame:
    """Shared minima with the shingles around them, as 16-bit numbers, or 32-bit ones where many texts hold the minimum."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchors, hashes, counts, _ in _shared_anchors(batch):
                short = anchors.flat >> np.uint64(32) | np.uint64(1)
                for kind, rows in ((np.uint16, np.flatnonzero(counts <= MANY)), (np.uint32, np.flatnonzero(counts > MANY))):
                    for some in np.split(rows, range(10_000, len(rows), 10_000)):
                        place = anchors.at[some, None] + np.arange(-AROUND, AROUND + 1)
                        inside = (place >= anchors.bounds[anchors.text[some]][:, None]) & (place < anchors.bounds[anchors.text[some] + 1][:, None])
                        around = np.where(inside, short[np.clip(place, 0, len(short) - 1)], 0).astype(np.uint32)
                        ordered = np.sort(around, axis=1)
                        repeats = ((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] > 0)).sum(axis=1) >= REPEATED
                        around = around.astype(kind, copy=False)
                        factors = _powers(_MULTIPLIER, around.shape[1])
                        # one of equal surroundings in a text
                        one = _first_rows((around * factors).sum(axis=1, dtype=np.uint64), anchors.key[some], anchors.text[some])
                        data = np.ascontiguousarray(around[one])
                        offsets = np.arange(len(one) + 1, dtype=np.int32) * (data.itemsize * data.shape[1])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(anchors.key[some[one]]), pa.array(counts[some[one]]), pa.array(hashes[some[one]]),
                                pa.array(repeats[one]),
                                pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
                            ],
                            ["key", "texts", "text_hash", "repeats", "around"],
                        )

    return texts.select("text_hash", "text", "keys", "texts").mapInArrow(make, "key long, texts long, text_hash long, repeats boolean, around binary")


def _runs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far rows of surroundings agree without a break, before and after the middle."""
    same = (one == two) & (one > 0)
    ends = np.ones((len(one), 1), bool)
    return (np.argmax(np.hstack([~x, ends]), axis=1) for x in (same[:, AROUND - 1 :: -1], same[:, AROUND + 1 :]))


def _goes_on(one: np.ndarray, two: np.ndarray, before: np.ndarray, after: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the run around the middle and the next one make a passage for certain, and whether they may be in one.

    Of passages at the threshold some gap has eight shared shingles next to it
    for each that it lacks in a row, in the runs on its two sides. With as many as the
    least length asks for, these two runs alone are a passage. Where shingles
    repeat, nothing is certain, and any shared one soon after the run will do.
    """
    sure, may = np.zeros(len(one), bool), np.zeros(len(one), bool)
    step, width = np.arange(1, REACH + 1), one.shape[1]
    for sign, end in ((1, AROUND + after), (-1, AROUND - before)):
        place = end[:, None] + sign * step
        valid = (place >= 0) & (place < width)
        place = np.clip(place, 0, width - 1)
        flat = (np.arange(len(one)) * width)[:, None] + place
        # shingles are odd numbers: what is outside equals nothing
        a, b = np.where(valid, one.ravel()[flat], 0), np.where(valid, two.ravel()[flat], 2)
        b[b == 0] = 2
        same = a[:, :, None] == b[:, None, :]
        there = np.flatnonzero(same.reshape(-1, REACH * REACH).any(axis=1))
        if not len(there):
            continue
        same = same[there]
        # only where such a run begins
        same[:, 1:, 1:] &= ~same[:, :-1, :-1]
        row, s, t = np.nonzero(same)
        row = there[row]
        reach = sign * np.arange(WIDTH)
        x, y = (end[row, None] + sign * (k[:, None] + 1) + reach for k in (s, t))
        inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < width)
        x, y = (v[row[:, None], np.clip(k, 0, width - 1)] for v, k in ((one, x), (two, y)))
        agree = ~inside | ((x == y) & (x > 0))
        size = np.where(agree.all(axis=1), WIDTH, np.argmin(agree, axis=1))
        # a run that leaves the surroundings may be of any length
        known = np.minimum(size, inside.sum(axis=1))
        shared, least = (before + after + 1)[row] + known, np.minimum(s, t)
        may[row[repeats[row] | (size > known) | (size == WIDTH) | (shared >= 8 * least)]] = True
        # single shingles may agree by chance in 16 bits
        close = ~repeats[row] & (known >= 3) & (np.maximum(s, t) <= _GAPS[0])
        sure[row[close & (shared >= 4 * (s + t)) & (shared + least >= WIDTH)]] = True
    return sure, may | sure


def _compare(around: np.ndarray, repeats: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether rows i and j hold the same passage, whether they hold a passage otherwise, and whether they may."""
    equal, sure, may = (np.zeros(len(i), bool) for _ in range(3))
    for first in range(0, len(i), 5000):
        some = slice(first, first + 5000)
        one, two = around[i[some]], around[j[some]]
        before, after = _runs(one, two)
        equal[some] = before + after + 1 >= WIDTH
        rest = np.flatnonzero(~equal[some])
        sure[first + rest], may[first + rest] = _goes_on(
            one[rest], two[rest], before[rest], after[rest], repeats[i[some][rest]] | repeats[j[some][rest]]
        )
    return equal, sure, may


def _joined(i: np.ndarray, j: np.ndarray, count: int) -> np.ndarray:
    """The smallest number that each of ``count`` is joined to by pairs (i, j)."""
    label = np.arange(count)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        for side in (i, j):
            np.minimum.at(new, side, least)
            np.minimum.at(new, label[side], least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _in_order(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with equal values of the sorted ``group``, by distance."""
    place, step = np.arange(len(group)), 1
    while len(place):
        place = place[place + step < len(group)]
        place = place[group[place] == group[place + step]]
        yield place, place + step
        step += 1


def _same_text(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that join all rows of each text."""
    order = np.argsort(hashes, kind="stable")
    next_to = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    return order[next_to], order[next_to + 1]


def _tree(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first pairs (i, j) that join all classes ``label`` which the pairs join, and the classes then."""
    kept, left = [np.zeros(0, np.int64)], np.arange(len(i))
    while True:
        left = left[label[i[left]] != label[j[left]]]
        if not len(left):
            return np.concatenate(kept), label
        first = np.full(len(label), len(i))
        for side in (i, j):
            np.minimum.at(first, label[side[left]], left)
        kept.append(np.unique(first[first < len(i)]))
        label = _joined(label[i[kept[-1]]], label[j[kept[-1]]], len(label))[label]


class _Meeting:
    """Rows that meet: the class each is in by now, and the pairs that are to be verified.

    Of rows that hold a passage, one pair joins two classes. Rows that may hold one are all
    verified, if nothing else joins them in the end.
    """

    def __init__(self, around: np.ndarray, repeats: np.ndarray, label: np.ndarray):
        self.around, self.repeats, self.label = around, repeats, label
        self.tied, self.open = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]

    def meet(self, i: np.ndarray, j: np.ndarray) -> None:
        """Compare rows j with i, of which each class has one row at most."""
        label = self.label
        other = label[i] != label[j]
        i, j = i[other], j[other]
        if not len(i):
            return
        equal, sure, may = _compare(self.around, self.repeats, i, j)
        to = np.arange(len(label))
        new = np.flatnonzero(equal)
        to[label[j[new]]] = label[i[new]]
        rest = np.flatnonzero(sure)
        rest = rest[to[label[j[rest]]] != label[i[rest]]]
        rest = rest[np.unique(label[j[rest]], return_index=True)[1]]
        self.tied.append(np.stack([i[rest], j[rest]]))
        to[label[j[rest]]] = label[i[rest]]
        self.open.append(np.stack([i, j])[:, may & ~sure])
        self.label = to[label]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.hstack(self.open)
        still = self.label[i] != self.label[j]
        i, j = np.hstack([*self.tied, np.stack([i[still], j[still]])])
        return i, j


def _few_meet(group: np.ndarray, around: np.ndarray, repeats: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are to be verified, of groups of at most ``MANY`` rows: one row after another meets the later ones, in the order of their texts."""
    order = np.lexsort((hashes, group))
    group, hashes = group[order], hashes[order]
    first = np.searchsorted(group, group)
    fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (group[1:] != group[:-1])])[: len(group)]
    j = np.arange(len(group))
    rows = _Meeting(around[order], repeats[order], np.maximum.accumulate(np.where(fresh, j, 0)))
    for step in range(int((j - first).max(initial=0))):
        j = j[j - first[j] > step]
        rows.meet(first[j] + step, j)
    i, j = rows.pairs()
    return order[i], order[j]


def _large_meet(around: np.ndarray, repeats: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are to be verified, of one large group.

    A few rows meet all others. If that joins most, those outside the largest
    class meet all.
    """
    order = np.argsort(hashes, kind="stable")
    hashes, place = hashes[order], np.arange(len(hashes))
    rows = _Meeting(around[order], repeats[order], np.searchsorted(hashes, hashes))
    for hub in range(min(HUBS, len(place))):
        rows.meet(np.full(len(place) - hub - 1, hub), place[hub + 1 :])
    outside = rows.label != np.argmax(np.bincount(rows.label))
    rest = np.flatnonzero(outside)
    if len(rest) * len(place) > DIRECT:
        i, j = _many_meet(rows.around, rows.repeats, hashes, rows.label)
        tied = np.hstack(rows.tied)
        i, j = np.concatenate([tied[0], i]), np.concatenate([tied[1], j])
    else:
        for hub in rest.tolist():
            others = place[~outside | (place > hub)]
            rows.meet(np.full(len(others), hub), others)
        i, j = rows.pairs()
    return order[i], order[j]


def _many_meet(around: np.ndarray, repeats: np.ndarray, hashes: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one large group in many classes that are to be verified.

    Texts that hold the same passage are one class. Rows of two classes whose
    run ends at the same place meet on that run and a shingle soon after it, or
    soon before it; of each class one row meets with each such shingle.
    """
    count, width = around.shape
    up, down = (_powers(x, width + 1) for x in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)))
    sums = np.hstack([np.zeros((count, 1), np.uint64), np.cumsum(mix(around) * up[:-1], axis=1, dtype=np.uint64)])

    def span(first: int, past: int) -> np.ndarray:
        whole = (around[:, first] > 0) & (around[:, past - 1] > 0)
        return np.where(whole, mix((sums[:, past] - sums[:, first]) * down[first]) | np.uint64(1), np.uint64(0))

    ties = [_same_text(hashes), (np.arange(count), label)]
    for begin in range(AROUND - WIDTH + 1, AROUND + 1):
        one, two = _same_text(span(begin, begin + WIDTH))
        held = around[one, begin] * around[one, begin + WIDTH - 1] > 0
        ties.append((one[held], two[held]))
    label = _joined(*(np.concatenate(x) for x in zip(*ties)), count)
    met = [np.zeros(0, np.int64)]
    for r in range(WIDTH - 1):
        back = max(RUN - 1 - r, 0)
        for run, step in ((span(AROUND - back, AROUND + r + 1), 1), (span(AROUND - r, AROUND + back + 1), -1)):
            begin = AROUND + step * (r + 1)
            following = around[:, begin]
            _, run = np.unique(run, return_inverse=True)
            # runs that go on in several ways, in several classes
            ways = [np.zeros(run.max() + 1, bool) for _ in range(2)]
            for way, x in zip(ways, (following, label)):
                first = np.zeros(len(way), x.dtype)
                first[run] = x
                np.logical_or.at(way, run, x != first[run])
            row = np.flatnonzero((ways[0] & ways[1])[run] & (around[:, AROUND + step * r] > 0) & (around[:, AROUND - step * back] > 0))
            if not len(row):
                continue
            near = around[row][:, begin : begin + REACH] if step > 0 else around[row][:, begin - REACH + 1 : begin + 1]
            row, shingle = np.repeat(row, near.shape[1]), near.ravel()
            row, shingle = row[shingle > 0], shingle[shingle > 0]
            code = mix(run[row].astype(np.uint64)) ^ shingle
            kept = _first_rows(following[row], label[row], code)
            row, code = row[kept], code[kept]
            order = np.argsort(code, kind="stable")
            row, code = row[order], code[order]
            for i, j in _in_order(code):
                i, j = row[i], row[j]
                other = (label[i] != label[j]) & (following[i] != following[j])
                met.append(np.unique(i[other] * count + j[other]))
            met = [np.unique(np.concatenate(met))]
    i, j = np.divmod(met[0], count)
    some = np.lexsort((np.maximum(hashes[i], hashes[j]), np.minimum(hashes[i], hashes[j])))
    i, j = i[some], j[some]
    _, sure, may = _compare(around, repeats, i, j)
    rows = np.flatnonzero(sure)
    tied, label = _tree(i[rows], j[rows], label)
    rest = np.flatnonzero(may & ~sure & (label[i] != label[j]))
    kept = np.concatenate([rows[tied], rest])
    return i[kept], j[kept]


def near_pairs(texts: DataFrame) -> DataFrame:
    """Texts that share a run and more around it, but not one passage word for word: (a, b).

    Under each minimum a tree of pairs joins the texts whose surroundings show a
    passage; where they leave it open, all pairs that nothing else joins are
    given. The texts under a very frequent minimum are dealt to blocks, and each
    pair of blocks meets in a task.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            group = np.cumsum(np.concatenate([[0], _changes(table)]))
            hashes = table.column("text_hash").to_numpy()
            size = np.bincount(group, minlength=1)[group] if len(group) else group
            repeats = table.column("repeats").to_numpy()
            long = table.column("texts").to_numpy() > MANY
            raw = table.column("around").combine_chunks()
            for kind, rows in ((np.uint16, np.flatnonzero(~long)), (np.uint32, np.flatnonzero(long))):
                if not len(rows):
                    continue
                part = raw.take(pa.array(rows))
                part = pa.concat_arrays(part.chunks) if isinstance(part, pa.ChunkedArray) else part
                bounds = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
                around = np.frombuffer(part.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(kind).reshape(len(rows), -1)
                few = size[rows] <= MANY
                _, small = np.unique(group[rows[few]], return_inverse=True)
                found = [(_few_meet(small, around[few], repeats[rows[few]], hashes[rows[few]]), hashes[rows[few]])]
                for one in np.unique(group[rows[~few]]).tolist():
                    own = np.flatnonzero(group[rows] == one)
                    found.append((_large_meet(around[own], repeats[rows[own]], hashes[rows[own]]), hashes[rows[own]]))
                for (i, j), of in found:
                    a, b = np.minimum(of[i], of[j]), np.maximum(of[i], of[j])
                    kept = _first_rows(a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], ["a", "b"])

    parts = F.ceil(F.col("texts") / F.lit(BLOCK_TEXTS)).cast("int")
    rows = surrounding_rows(texts).withColumn("_own", F.pmod("text_hash", parts))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumn("_low", F.least("_own", "_other").cast("int")).withColumn("_high", F.greatest("_own", "_other").cast("int"))
    by = ["key", "_low", "_high"]
    dealt = rows.select(*by, "texts", "text_hash", "repeats", "around").repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _changes(table: pa.Table) -> np.ndarray:
    """Whether each row but the first begins another group."""
    sides = [table.column(c).to_numpy() for c in ("key", "_low", "_high")]
    return np.any([x[1:] != x[:-1] for x in sides], axis=0)


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int = 5000) -> Iterator[pa.Table]:
    """Sorted batches as tables of about ``most`` rows that end with a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < most:
            continue
        table = pa.Table.from_batches(held)
        ends = np.flatnonzero(_changes(table))
        if len(ends):
            yield table.slice(0, int(ends[-1]) + 1)
            held = table.slice(int(ends[-1]) + 1).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def meeting_pairs(documents: DataFrame) -> DataFrame:
    """Different texts that may share a passage, by hash: (a, b).

    Texts that hold the same passage of the least length are tied to one of
    them. Others with a run in common are joined by a tree of pairs.
    """
    return _met(stored(repeating_texts(documents)))


def _met(texts: DataFrame) -> DataFrame:
    return equal_pairs(texts).unionByName(near_pairs(texts)).distinct()


def _in_groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by value, and whether each has another value than the one before."""
    order = np.argsort(values, kind="stable")
    return order, np.concatenate([[True], values[order[1:]] != values[order[:-1]]])


def _last_places(order: np.ndarray, fresh: np.ndarray, count: int) -> np.ndarray:
    """Last place with the same value before each place, -1 where there is none."""
    last = np.full(count, -1)
    last[order[1:]] = np.where(fresh[1:], -1, order[:-1])
    return last


def shared_passages(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Passages that two shingle sequences share: words from and to in each (to excluded), and the similarity.

    Runs of shingles of ``b`` that occur in ``a``, with small gaps, are laid
    against the span of ``a`` on the diagonal that most of them are on. Of a run
    that is not similar enough the longest parts are tried; without any, it is
    cut at ever smaller gaps, and at last into the stretches that stand in ``a``
    word for word.
    """
    order = np.argsort(a, kind="stable")
    ordered = a[order]
    low, high = np.searchsorted(ordered, b, side="left"), np.searchsorted(ordered, b, side="right")
    hits = np.flatnonzero(high > low)
    if not len(hits):
        return []
    # places in ``a``, sorted within each shingle
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    single = high - low == 1
    group = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0)) * (len(a) + 1) + order

    # last place of the same shingle before each place, in either sequence
    last_a, last_b = _last_places(order, fresh, len(a)), _last_places(*_in_groups(b), len(b))

    def nearest(run: np.ndarray, shift: int, reach: int) -> np.ndarray:
        to = np.clip(run + shift, 0, len(a))
        if single[run].all():
            best = order[low[run]]
            return best[np.abs(best - to) <= reach]
        k = np.searchsorted(group, low[run] * (len(a) + 1) + to)
        one, two = order[np.clip(k - 1, low[run], high[run] - 1)], order[np.clip(k, low[run], high[run] - 1)]
        best = np.where(np.abs(one - to) <= np.abs(two - to), one, two)
        return best[np.abs(best - to) <= reach]

    def measured(run: np.ndarray) -> tuple[int, int, int, int, float]:
        from_b, to_b = int(run[0]), int(run[-1]) + 1
        # few places of each shingle vote for a diagonal; then each takes its place nearest to that
        counts = np.minimum(high[run] - low[run], 8)
        at = order[np.repeat(low[run], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
        votes = np.bincount(at - np.repeat(run, counts) + to_b)
        tried = {int(order[low[run[0]]] - run[0])}
        for _ in range(2):
            most = int(np.argmax(votes))
            tried |= {most - to_b} if votes[most] else set()
            votes[most] = 0
        near = max((nearest(run, shift, 16 + (to_b - from_b) // 10) for shift in sorted(tried)), key=len)
        from_a, to_a = int(near.min()), int(near.max()) + 1
        # distinct shingles are those without the same one before them in the span
        ones = int(np.count_nonzero(last_a[from_a:to_a] < from_a))
        firsts = from_b + np.flatnonzero(last_b[from_b:to_b] < from_b)
        shared = firsts[high[firsts] > low[firsts]]
        k = np.searchsorted(group, low[shared] * (len(a) + 1) + from_a)
        both = int(np.count_nonzero((k < high[shared]) & (order[np.minimum(k, len(a) - 1)] < to_a)))
        union = ones + len(firsts) - both
        similar = to_a - from_a >= WIDTH and 100 * both >= PERCENT * union
        return from_a, to_a + SIZE - 1, from_b, to_b + SIZE - 1, both / union if similar else 0.0

    found = []
    todo = [(hits, _GAPS)]
    while todo:
        places, (gap, *closer) = todo.pop()
        cuts = np.flatnonzero(np.diff(places) > gap + 1) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(places)]])
        long = places[ends - 1] + 1 - places[begins] >= WIDTH
        for begin, end in zip(begins[long].tolist(), ends[long].tolist()):
            run = places[begin:end]
            passage = measured(run)
            if passage[-1]:
                found.append(passage)
                continue
            inner = []
            for part in _parts(run) if gap == _GAPS[0] else ():
                if all(part[-1] < x or part[0] >= y for x, y in inner) and (passage := measured(part))[-1]:
                    found.append(passage)
                    inner.append((int(part[0]), int(part[-1]) + 1))
            if inner:
                # what is outside those is looked at on its own
                outside = np.all([(run < x) | (run >= y) for x, y in inner], axis=0)
                if closer and outside.any():
                    todo.append((run[outside], closer))
            elif closer:
                todo.append((run, closer))
            else:
                found += [(i, i + size + SIZE - 1, j, j + size + SIZE - 1, 1.0) for i, j, size in _equal_stretches(a, b, int(run[0]), int(run[-1]) + 1)]
    return sorted(found)


def _parts(run: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a run that is not similar as a whole, longest first, that may be: up to ten stretches without a gap."""
    cuts = np.flatnonzero(np.diff(run) > 1) + 1
    begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(run)]])
    one, two = (x.ravel() for x in np.meshgrid(np.arange(len(begins)), np.arange(10), indexing="ij"))
    two += one
    one, two = one[two < len(begins)], two[two < len(begins)]
    span = run[ends[two] - 1] + 1 - run[begins[one]]
    held = np.cumsum(ends - begins)[two] - np.cumsum(ends - begins)[one] + (ends - begins)[one]
    # each gap stands for SIZE - 1 shingles of the other text at least
    wanted = np.flatnonzero((span >= WIDTH) & (100 * held >= PERCENT * (span + (SIZE - 1) * (two - one))) & (held < len(run)))
    for k in wanted[np.argsort(-span[wanted], kind="stable")].tolist():
        yield run[begins[one[k]] : ends[two[k]]]


def _equal_stretches(a: np.ndarray, b: np.ndarray, first: int, past: int) -> list[tuple[int, int, int]]:
    """Stretches of at least a passage in ``b`` from ``first`` to ``past`` that stand in ``a``: place in each, and length.

    For runs whose shingles come from several places of ``a``, as where lines are repeated.
    """
    if len(a) < WIDTH or past - first < WIDTH:
        return []
    hashes = []
    for values in (a, b[first:past]):
        up, down = (_powers(x, len(values) + 1) for x in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values) * up[:-1], dtype=np.uint64)])
        begin = np.arange(len(values) - WIDTH + 1)
        hashes.append((sums[begin + WIDTH] - sums[begin]) * down[begin])
    kinds, at = np.unique(hashes[0], return_index=True)
    place = np.minimum(np.searchsorted(kinds, hashes[1]), len(kinds) - 1)
    found, done = [], 0
    for j in np.flatnonzero(kinds[place] == hashes[1]).tolist():
        if j < done:
            continue
        i = int(at[place[j]])
        most = min(len(a) - i, past - first - j)
        differ = np.flatnonzero(a[i : i + most] != b[first + j : first + j + most])
        size = int(differ[0]) if len(differ) else most
        found.append((i, first + j, size))
        done = j + size - WIDTH + 1
    return found


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Shared passages of pairs (a, b) of hashes of texts (text_hash, doc_id, text)."""
    sides = [texts.select(F.col("text_hash").alias(x), F.col("doc_id").alias(f"doc_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in (0, 1)]
            for first in range(0, batch.num_rows, 200):
                sides = [shingles(read_texts(batch.column(i).slice(first, 200)), SIZE) for i in (2, 3)]
                rows = []
                for i in range(len(sides[0][1]) - 1):
                    one, two = ids[0][first + i], ids[1][first + i]
                    a, b = (flat[bounds[i] : bounds[i + 1]] for flat, bounds in (sides if one < two else sides[::-1]))
                    rows += [(min(one, two), max(one, two), *p) for p in shared_passages(a, b)]
                types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    names = ["doc_id", "other_id", "start_word", "end_word", "other_start", "other_end", "similarity"]
    schema = "doc_id long, other_id long, start_word int, end_word int, other_start int, other_end int, similarity double"
    met = pairs.join(sides[0], "a").join(sides[1], "b").filter(F.col("doc_a") != F.col("doc_b"))
    return met.select(F.col("doc_a").cast("long"), F.col("doc_b").cast("long"), "text_a", "text_b").mapInArrow(check, schema)


def copies_of(documents: DataFrame) -> DataFrame:
    """Equal texts of at least ``LEAST_WORDS`` words, each with the smallest doc_id of its group."""
    known = documents.filter(F.col("doc_id").isNotNull())
    rows = known.select("doc_id", F.xxhash64("text").alias("_one"), F.md5("text").alias("_two"))
    groups = rows.groupBy("_one", "_two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last")).filter(F.col("first") != F.col("_last"))
    # the words of one of the texts of each group are counted
    count = F.size(F.array_remove(F.split("text", r"[ \t\n\x0B\f\r]+"), ""))
    long = known.join(groups.select(F.col("first").alias("doc_id"), "_one", "_two"), "doc_id").filter((F.xxhash64("text") == F.col("_one")) & (F.md5("text") == F.col("_two")))
    long = long.select(F.col("doc_id").alias("first"), "_one", "_two", count.alias("_words")).distinct().filter(F.col("_words") >= LEAST_WORDS)
    pairs = rows.join(long, ["_one", "_two"]).filter(F.col("doc_id") != F.col("first")).distinct()
    zero = F.lit(0)
    return pairs.select(
        F.col("first").alias("doc_id"), F.col("doc_id").alias("other_id"), zero.alias("start_word"), F.col("_words").alias("end_word"),
        zero.alias("other_start"), F.col("_words").alias("other_end"), F.lit(1.0).alias("similarity"),
    )


def find_passages(documents: DataFrame) -> DataFrame:
    """Passages of at least 50 words that documents (doc_id, text) share at a similarity of 0.8 on five-word shingles.

    A row is a passage of ``doc_id`` and its counterpart in ``other_id``, a larger
    id, with word numbers (the end excluded) and similarity. A passage begins and
    ends with a shared shingle. Equal texts are tied to the smallest doc_id of
    their group, different texts that hold the same 50 words to one of them, and those
    that hold almost the same words are joined by a tree of rows, so that all
    are connected and each has a row for those words. Null and short texts, rows without doc_id and
    repeats within one text give no rows.
    """
    texts = stored(repeating_texts(documents))
    return _verified(stored(_met(texts)), texts).unionByName(copies_of(documents))


def by_document(found: DataFrame) -> DataFrame:
    """One row per document of the rows of ``find_passages``, whichever side of a row it is on.

    ``class_id`` is the smallest doc_id that shared passages lead to,
    ``n_passages`` and ``n_words`` count the stretches of words that lie in
    passages shared with other documents, and ``passages`` gives these stretches in
    order, overlapping ones as one (the end excluded), each with the smallest
    doc_id of a counterpart among the rows.
    """
    found = stored(found)
    one = found.select("doc_id", "start_word", "end_word", F.col("other_id").alias("with_doc"))
    two = found.select(F.col("other_id").alias("doc_id"), F.col("other_start").alias("start_word"), F.col("other_end").alias("end_word"), F.col("doc_id").alias("with_doc"))
    # a text that many are tied to has as many rows, but few different stretches
    spans = one.unionByName(two).groupBy("doc_id", "start_word", "end_word").agg(F.min("with_doc").alias("with_doc"))
    before = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    spans = spans.withColumn("_reach", F.max("end_word").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("_stretch", F.sum(F.when(F.col("start_word") < F.col("_reach"), 0).otherwise(1)).over(before))
    whole = spans.groupBy("doc_id", "_stretch").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("with_doc").alias("with_doc"))
    rows = whole.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_passages"), F.sum(F.col("end_word") - F.col("start_word")).alias("n_words"),
        F.sort_array(F.collect_list(F.struct("start_word", "end_word", "with_doc"))).alias("passages"),
    )
    classes = components(found.select("doc_id", "other_id").distinct())
    return rows.join(classes.select(F.col("node").alias("doc_id"), F.col("component").alias("class_id")), "doc_id").select("doc_id", "class_id", "n_passages", "n_words", "passages")
