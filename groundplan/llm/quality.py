"""Quality by the likelihood ratio of a trusted target against the raw corpus, over hashed word n-grams.

Both sides are multinomials over buckets of hashed words and word pairs: the
target from labelled good documents, the raw side from all documents. A
document's score is its mean log ratio per n-gram, so long and short texts
compare alike, and a fixed limit decides on every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.llm.words import CLASSES, SPACE, Texts, Words, blocks, find_words, hash_words, mix, read_texts

BUCKETS = 1 << 16
# documents of the target, at most
TARGET_DOCUMENTS = 50_000
# mean log ratio per n-gram that a document needs
LIMIT = -0.4
# added to every bucket's count on both sides
ADDED = 5
# words that a document needs, and per cent of them that may stand in repeated windows
LEAST_WORDS = 50
MOST_REPEATED = 50
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _within(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes made different for each text."""
    return hashes ^ mix(text.astype(np.uint64) + np.uint64(1))


def _lines(texts: Texts) -> Words:
    """The lines of each text, empty ones left out."""
    inside = texts.data != 10
    edge = np.empty(len(inside) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[texts.offsets] = True
    starts, ends = np.flatnonzero(edge[:-1] & inside), np.flatnonzero(edge[1:] & inside) + 1
    return Words(starts, ends, np.diff(np.searchsorted(starts, texts.offsets)))


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """Counts of the base rules of each text, see ``score_quality``."""
    if not len(texts.data):
        zero = np.zeros(len(texts), np.int64)
        return dict.fromkeys(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], zero)
    filled = CLASSES[texts.data] != SPACE
    words = find_words(texts)
    # code points begin at bytes that do not continue one
    chars = _per_text(filled & ((texts.data & 0xC0) != 0x80), texts.offsets)
    lines = _lines(texts)
    with_word = np.searchsorted(words.starts, lines.starts) < np.searchsorted(words.starts, lines.ends)
    of = lines.text_of[with_word]
    kept = Words(lines.starts[with_word], lines.ends[with_word], np.bincount(of, minlength=len(texts)))
    _, first = np.unique(_within(of, hash_words(texts.data, kept)), return_index=True)
    repeats = kept.counts - np.bincount(of[first], minlength=len(texts))
    hashes, of = hash_words(texts.data, words), words.text_of
    repeated = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        factor = np.uint64(0x9FB21C651E98DF25)
        triple = ((_within(of, hashes)[:-2] * factor) ^ (hashes[1:-1] + (hashes[1:-1] >> np.uint64(17)))) * factor ^ mix(hashes[2:])
        whole = np.flatnonzero(of[2:] == of[:-2])
        codes, kinds = pd.factorize(mix(triple[whole]))
        again = whole[np.bincount(codes, minlength=len(kinds))[codes] > 1]
        for k in range(3):
            repeated[again + k] = True
    return {
        "n_words": words.counts, "word_chars": chars, "n_symbols": _per_text(_SYMBOLS[texts.data], texts.offsets),
        "n_dup_lines": repeats, "n_repeat_words": np.bincount(of[repeated], minlength=len(texts)),
    }


def ngram_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and pair of neighbouring words, punctuation apart, and the text it is in."""
    words = find_words(texts, split_punctuation=True)
    hashes, of = hash_words(texts.data, words), words.text_of
    pairs = np.flatnonzero(of[1:] == of[:-1])
    joined = mix(hashes[pairs] * np.uint64(0x9FB21C651E98DF25) + hashes[pairs + 1]) if len(pairs) else hashes[:0]
    both = np.concatenate([hashes, joined]) & np.uint64(BUCKETS - 1)
    return both.astype(np.int64), np.concatenate([of, of[pairs]])


@dataclass
class Ratio:
    """Log ratio of target to raw chance, by bucket."""

    values: np.ndarray

    def score(self, texts: Texts) -> np.ndarray:
        """Mean log ratio of each text's n-grams; 0 without any."""
        buckets, of = ngram_buckets(texts)
        total = np.bincount(of, weights=self.values[buckets], minlength=len(texts))
        return total / np.maximum(np.bincount(of, minlength=len(texts)), 1)


def target_ids(labels: DataFrame, most: int = TARGET_DOCUMENTS) -> np.ndarray:
    """Ids of documents labelled good, at most ``most``, picked by a hash of the id."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long")).distinct()
    picked = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return np.sort(np.array(picked.toArrow().column(0), np.int64))


def fit(documents: DataFrame, labels: DataFrame, most: int = TARGET_DOCUMENTS) -> Ratio:
    """Both multinomials from one pass over all documents (doc_id, text); labels are (doc_id, quality).

    A task adds up its own counts first, so what is shuffled and collected is
    ``BUCKETS`` rows a task and in all. ``ADDED`` is put on every count, so that
    no chance is zero and rare n-grams sway little; the target counts are first
    scaled to the raw total. Without a target all ratios are 0.
    """
    trusted = target_ids(labels, most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            good = np.isin(ids.fill_null(0).to_numpy(), trusted) & ids.is_valid().to_numpy(zero_copy_only=False)
            for first, past, texts in blocks(read_texts(batch.column(1))):
                buckets, of = ngram_buckets(texts)
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[good[first:past][of]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    counts = documents.select("doc_id", "text").mapInArrow(count, "bucket long, raw long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = np.array(rows.column("bucket"), np.int64)
    raw[at], target[at] = np.array(rows.column("raw")), np.array(rows.column("target"))
    if not target.sum():
        return Ratio(np.zeros(BUCKETS))
    return Ratio(np.log((target * (raw.sum() / target.sum()) + ADDED) / (raw + ADDED)))


def score_quality(documents: DataFrame, ratio: Ratio, limit: float = LIMIT) -> DataFrame:
    """Base counts and verdict for every row of ``documents`` (doc_id, text), from its whole text.

    Words are runs without ASCII white space. ``word_chars`` counts code points
    in words, ``n_symbols`` the characters #*$%&|<>, ``n_dup_lines`` the lines
    with a word that equal an earlier line, ``n_repeat_words`` the words in
    windows of three that occur twice or more. ``base_failed``: fewer than 50
    words, or more than half of them in such windows. ``score`` is the mean log
    ratio, ``kept`` whether a document that has not failed reaches ``limit``. A
    null text has no words. Repeated rows are scored each; other columns are ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for first, past, texts in blocks(read_texts(batch.column(1))):
                counts = base_counts(texts)
                failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
                score = ratio.score(texts)
                columns = [pa.array(counts[n].astype(np.int64)) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, past - first), *columns, pa.array(failed), pa.array(score), pa.array(~failed & (score >= limit))],
                    ["doc_id", *names, "base_failed", "score", "kept"],
                )

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, score double, kept boolean"
    return documents.select("doc_id", "text").mapInArrow(judge, schema)
