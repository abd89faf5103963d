"""Phrases whose words stand together more often than their parts would by chance.

Counting goes in two passes. The first deals 64-bit hashes of all phrases of one
to five words out to hash partitions and keeps a Misra-Gries summary of each,
with more counters than the partition's occurrences divided by the threshold, so
that every phrase at the threshold survives. Survivors set bits of a filter of
fixed size. The second pass counts the phrases that meet a set bit, by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundplan.llm.units import give_back
from groundplan.llm.words import LOWER, Texts, Words, blocks, hash_words, mix, text_column
from groundplan.operators.sizes import broadcast_if_small
from groundplan.session import stored

LONGEST = 5
THRESHOLD = 100
TOP = 2000
# bytes of text that a task combines before it sends counts
BLOCK_BYTES = 2_000_000
# bits of the filter between the passes, sent to every task
FILTER_BITS = 1 << 27
# bytes of text for each hash partition, and the bounds of their number
PARTITION_BYTES = 8_000_000
_LEAST_PARTITIONS, _MOST_PARTITIONS = 16, 1 << 17

_WORD, _GAP, _BREAK = 0, 1, 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SIZE_STEP = 0xD1B54A32D192ED03


def _kinds() -> np.ndarray:
    kinds = np.full(256, _WORD, np.uint8)
    kinds[[*b" \t"]] = _GAP
    kinds[[*b".,;:!?\n\x0b\x0c\r"]] = _BREAK
    return kinds


KINDS = _kinds()


# --- phrases of a block -------------------------------------------------


class Phrases:
    """Words of some lower-cased texts, the piece each lies in, and hashes of its phrases."""

    def __init__(self, texts: Texts, seeds: np.ndarray):
        self.data = LOWER[texts.data]
        kinds = KINDS[self.data]
        size = len(kinds)
        edge = np.ones(size + 1, bool)
        edge[1:size] = (kinds[1:] == _WORD) != (kinds[:-1] == _WORD)
        edge[texts.offsets] = True
        word = kinds == _WORD
        self.starts, self.ends = np.flatnonzero(edge[:-1] & word), np.flatnonzero(edge[1:] & word) + 1
        self.counts = np.diff(np.searchsorted(self.starts, texts.offsets))
        self.text_of = np.repeat(np.arange(len(texts)), self.counts)
        self.piece = np.cumsum(kinds == _BREAK)[self.starts] + self.text_of if size else np.zeros(0, np.int64)
        self.word_hash = hash_words(self.data, Words(self.starts, self.ends, self.counts)) if len(self.starts) else np.zeros(0, np.uint64)
        self.seeds = seeds.astype(np.uint64)[self.text_of]

    def hashes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Size, places of the first words, and hashes of the phrases of each size."""
        running = self.word_hash
        for size in range(1, longest + 1):
            if size > 1:
                running = running[:-1] * _STEP + self.word_hash[size - 1 :]
            if not len(running):
                return
            inside = np.flatnonzero(self.piece[: len(running)] == self.piece[size - 1 :])
            salt = np.uint64(size * _SIZE_STEP & (1 << 64) - 1)
            yield size, inside, mix((running[inside] ^ self.seeds[inside]) + salt)

    def strings(self, places: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The words of phrases, joined by one space."""
        raw = self.data.tobytes()
        starts, ends = self.starts.tolist(), self.ends.tolist()
        out = []
        for at, size in zip(places.tolist(), sizes.tolist()):
            out.append(b" ".join([raw[starts[i] : ends[i]] for i in range(at, at + size)]).decode())
        return out


def _language_seed(language: str) -> int:
    return int.from_bytes(hashlib.blake2b(language.encode(), digest_size=8).digest(), "little")


def _read(batch: pa.RecordBatch, most: int) -> Iterator[tuple[Phrases, np.ndarray, list[str]]]:
    """Blocks of phrases, the number of the language of each text, and the languages."""
    column = batch.column(1).dictionary_encode()
    names = [v.as_py() for v in column.dictionary]
    codes = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    seeds = np.array([_language_seed(n) for n in names], np.uint64)
    for first, past, texts in blocks(text_column(batch), most):
        own = codes[first:past]
        yield Phrases(texts, seeds[own]), own, names
        give_back()


# --- Misra-Gries summaries ----------------------------------------------


class Summary:
    """Counters of at most ``capacity`` keys; a key's count is at most ``missed`` too low.

    Added counts are gathered and then merged: when more than ``capacity`` keys are
    left, the count of the first one beyond is taken off all. Each unit taken off
    uses up ``capacity`` + 1 occurrences, so ``missed`` stays below occurrences
    divided by capacity.
    """

    def __init__(self, capacity: int):
        self.capacity, self.missed = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting_size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.waiting_size += len(keys)
        if self.waiting_size > max(4 * self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.waiting_size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[heads]
        self.counts = np.add.reduceat(counts, heads) if len(heads) else counts
        if len(self.keys) > self.capacity:
            off = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            self.missed += off
            left = self.counts > off
            self.keys, self.counts = self.keys[left], self.counts[left] - off

    def at_least(self, threshold: int) -> np.ndarray:
        """All keys that may have been added ``threshold`` times."""
        self.merge()
        return self.keys[self.counts + self.missed >= threshold]


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, high bytes together, which compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _packed(np.diff(keys, prepend=np.uint32(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw), dtype=np.uint32)


def _partition_of(hashes: np.ndarray, partitions: int) -> np.ndarray:
    """Hash partition by the upper half of a hash; the lower half is the key in it."""
    return ((hashes >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)


_PART = "part int, seq int, mass long, once binary, keys binary, counts binary"


def _partial_summaries(documents: DataFrame, partitions: int, longest: int) -> DataFrame:
    """Per block of text and hash partition a row of its occurrences (seq 0) and one of its counts (seq 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for phrases, _, _ in _read(batch, BLOCK_BYTES):
                found = [h for _, _, h in phrases.hashes(longest)]
                if not found:
                    continue
                hashes, times = np.unique(np.concatenate(found), return_counts=True)
                del found
                keys = hashes.astype(np.uint32)
                bounds = np.searchsorted(_partition_of(hashes, partitions), np.arange(partitions + 1))
                rows = []
                for part in np.flatnonzero(np.diff(bounds)).tolist():
                    own, counts = keys[bounds[part] : bounds[part + 1]], times[bounds[part] : bounds[part + 1]]
                    order = np.argsort(own, kind="stable")  # the upper half orders hashes within a partition
                    own, counts = own[order], counts[order]
                    many = counts > 1
                    rows.append((part, 0, int(counts.sum()), None, None, None))
                    rows.append((part, 1, None, pack_keys(own[~many]), pack_keys(own[many]), _packed(counts[many])))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                for at in range(0, len(rows), 256):
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows[at : at + 256]), kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["part", "seq", "mass", "once", "keys", "counts"])

    return documents.mapInArrow(run, _PART)


def _survivors(parts: DataFrame, threshold: int, slice_bits: int) -> DataFrame:
    """Per hash partition the slice of the filter that its surviving keys set (part, bits, n_keys, n_missed).

    Rows come sorted by partition and, in it, occurrences first, so that the
    capacity is known before the first count is added, and one summary is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = None, 0, None

        def close() -> pa.RecordBatch:
            keys = summary.at_least(threshold) if summary else np.zeros(0, np.uint32)
            bits = np.zeros(slice_bits // 8, np.uint8)
            place = keys % np.uint32(slice_bits)
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
            missed = summary.missed if summary else 0
            give_back()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([bits.tobytes()]), pa.array([len(keys)]), pa.array([missed])],
                names=["part", "bits", "n_keys", "n_missed"],
            )

        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for row in range(batch.num_rows):
                own, seq, count, once, keys, counts = (c[row].as_py() for c in columns)
                if own != part:
                    if part is not None:
                        yield close()
                    part, mass, summary = own, 0, None
                if seq == 0:
                    mass += count
                    continue
                summary = summary or Summary(mass // threshold + 1)
                lone, many = unpack_keys(once), unpack_keys(keys)
                summary.add(np.concatenate([lone, many]), np.concatenate([np.ones(len(lone), np.int64), _unpacked(counts).astype(np.int64)]))
        if part is not None:
            yield close()

    return parts.mapInArrow(run, "part int, bits binary, n_keys long, n_missed long")


# --- exact counts -------------------------------------------------------


def _counted(documents: DataFrame, share, partitions: int, slice_bits: int, longest: int) -> DataFrame:
    """Counts per block of phrases that meet the filter, and of all words, the latter with size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(share.value, np.uint8)
        for batch in batches:
            for phrases, own, names in _read(batch, BLOCK_BYTES):
                words = np.bincount(own[phrases.text_of], minlength=len(names))
                language, size_of, text, count = [names[i] for i in np.flatnonzero(words)], [0] * int((words > 0).sum()), [], []
                text, count = [""] * len(language), [int(w) for w in words if w]
                for size, places, hashes in phrases.hashes(longest):
                    place = _partition_of(hashes, partitions) * slice_bits + (hashes.astype(np.uint32) % np.uint32(slice_bits)).astype(np.int64)
                    held = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                    places, hashes = places[held], hashes[held]
                    _, first, times = np.unique(hashes, return_index=True, return_counts=True)
                    at = places[first]
                    text += phrases.strings(at, np.full(len(at), size))
                    language += [names[i] for i in own[phrases.text_of[at]].tolist()]
                    size_of += [size] * len(at)
                    count += times.tolist()
                for a in range(0, len(text), 50_000):
                    b = a + 50_000
                    arrays = [pa.array(language[a:b], pa.string()), pa.array(size_of[a:b], pa.int32()), pa.array(text[a:b], pa.string()), pa.array(count[a:b], pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "size", "phrase", "times"])

    return documents.mapInArrow(run, "lang string, size int, phrase string, times long")


def frequent_phrases(documents: DataFrame, *, longest: int = LONGEST, threshold: int = THRESHOLD, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Exact counts of all phrases of up to ``longest`` words that a language holds ``threshold`` times (lang, size, phrase, times).

    A row of size 0 holds the number of words of the language. The frame is stored.
    """
    rows = documents.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = max(_LEAST_PARTITIONS, min(_MOST_PARTITIONS, -(-size // PARTITION_BYTES)))
    slice_bits = max(64, filter_bits // partitions // 64 * 64)
    parts = _partial_summaries(rows, partitions, longest).repartition(partitions, "part").sortWithinPartitions("part", "seq")
    bits = bytearray(partitions * slice_bits // 8)
    # the filter has a fixed size, whatever the input
    for row in _survivors(parts, threshold, slice_bits).select("part", "bits").collect():
        bits[row.part * slice_bits // 8 : (row.part + 1) * slice_bits // 8] = row.bits
    share = documents.sparkSession.sparkContext.broadcast(bytes(bits))
    counted = _counted(rows, share, partitions, slice_bits, longest)
    totals = counted.groupBy("lang", "size", "phrase").agg(F.sum("times").alias("times"))
    found = stored(totals.filter((F.col("times") >= threshold) | (F.col("size") == 0)))
    share.unpersist()
    return found


# --- scores -------------------------------------------------------------


def _words_of(first: Column, count: Column) -> Column:
    return F.array_join(F.slice("_words", first, count), " ")


def collocations(
    documents: DataFrame, *, longest: int = LONGEST, threshold: int = THRESHOLD, top: int = TOP, absorb_percent: int = 100, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """The best ``top`` phrases of each language (text, lang): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased from A to Z, cut into pieces at ``.,;:!?`` and line ends,
    and those into words at spaces and tabs; null texts have no words, a null
    language is ``und``, equal rows count each for itself, other columns are not
    read, and an empty table gives an empty result. A phrase cut after its first
    words into parts found ``l`` and ``r`` times scores 1000 a n / (l r), rounded
    down; its lowest cut counts, of equal ones the first. A phrase is left out when a
    longer one that holds it is found at least ``absorb_percent`` % as often.
    """
    counts = frequent_phrases(documents, longest=longest, threshold=threshold, filter_bits=filter_bits)
    words = counts.filter(F.col("size") == 0).select("lang", F.col("times").alias("n"))
    known = counts.filter(F.col("size") > 0).select("lang", "phrase", "times")
    phrases = counts.filter(F.col("size") > 1).select("lang", "size", "phrase", F.col("times").alias("a"), F.split("phrase", " ").alias("_words"))

    cut = phrases.select("lang", "phrase", "size", "_words", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "a", "k", _words_of(F.lit(1), F.col("k")).alias("_left"),
        _words_of(F.col("k") + 1, F.col("size") - F.col("k")).alias("_right"),
    )
    # parts are found at least as often as the phrase, so both are known
    known = broadcast_if_small(known)
    left = known.select("lang", F.col("phrase").alias("_left"), F.col("times").alias("l"))
    right = known.select("lang", F.col("phrase").alias("_right"), F.col("times").alias("r"))
    exact = lambda name, digits: F.col(name).cast(f"decimal({digits},0)")
    above = F.lit(1000).cast("decimal(4,0)") * exact("a", 15) * exact("n", 17)
    # a row for each language
    scored = cut.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).join(words, "lang")
    scored = scored.withColumns({"_above": above, "_below": exact("l", 18) * exact("r", 18)}).withColumn("score", F.expr("_above div _below"))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("_best"))
    best = best.select("lang", "phrase", "_best.*")

    starts = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _words_of(i, m)))))
    inner = phrases.filter(F.col("size") > 2).select("lang", "a", starts.alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < absorb_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
