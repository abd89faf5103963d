"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A bounded sample of labelled documents trains one weight per hash. Every
coordinate has its own learning rate, and the L1 term holds all but a few
thousand weights at zero, so the model is small enough to go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundplan.llm.words import CLASSES, PUNCTUATION, Texts, blocks, find_words, hash_words, mix, read_texts

SIZE = 1 << 20
# labelled documents of each class in the training sample, at most
SAMPLE = 3000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
ROUNDS = 6
# value of a feature of several words, next to 1 for a word
COMBINED = 0.2


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Places of words, and of pairs, triples and pairs with one word between, punctuation left out, and the text each is in."""
    words = find_words(texts, split_punctuation=True)
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = CLASSES[texts.data[words.starts]] != PUNCTUATION
    hashes, of = hash_words(texts.data, words)[kept], words.text_of[kept]
    factor = np.uint64(0xA0761D6478BD642F)
    made, where = [hashes], [of]
    near = np.flatnonzero(of[1:] == of[:-1])
    pair = mix(hashes[near] * factor + hashes[near + 1])
    made.append(pair), where.append(of[near])
    far = np.flatnonzero(of[2:] == of[:-2])
    made.append(mix(hashes[far] * factor ^ (hashes[far + 2] + np.uint64(1)))), where.append(of[far])
    made.append(mix(mix(hashes[far] * factor + hashes[far + 1]) * factor + hashes[far + 2])), where.append(of[far])
    half = np.uint64(SIZE // 2 - 1)
    places = [(made[0] & half).astype(np.int64), (np.concatenate(made[1:]) & half).astype(np.int64) + SIZE // 2]
    return np.concatenate(places), np.concatenate(where)


def values(places: np.ndarray) -> np.ndarray:
    """What a feature counts: words, in the lower half of the places, more than combinations of them."""
    return np.where((places < SIZE // 2) | (places == SIZE), 1.0, COMBINED)


def _lowered(column: pa.Array) -> Texts:
    return read_texts(pc.utf8_lower(column))


@dataclass
class Model:
    """Weights that are not zero, and the log odds of a text without any."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        table = np.zeros(SIZE, np.float32)
        table[self.places] = self.weights
        return table

    def score(self, texts: Texts, table: np.ndarray) -> np.ndarray:
        """Chance of each text; a feature counts once however often it occurs."""
        found, of = features(texts)
        known = np.flatnonzero(table[found])
        pairs = np.unique(of[known] * SIZE + found[known])
        raw = self.bias + np.bincount(pairs // SIZE, weights=table[pairs % SIZE], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def train(rows: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Model:
    """FTRL-proximal, one example at a time, in an order fixed by the seed; coordinate SIZE is the bias, which L1 spares."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        bound = np.where(at == SIZE, 0, L1)
        own = z[at]
        return np.where(np.abs(own) <= bound, 0, -(own - np.sign(own) * bound) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(rounds):
        for i in rng.permutation(len(rows)).tolist():
            at = rows[i]
            w, own = weights(at), values(at)
            gradient = (1 / (1 + np.exp(-np.clip((w * own).sum(), -40, 40))) - labels[i]) * own
            root = np.sqrt(n[at])
            z[at] += gradient - (np.sqrt(n[at] + gradient * gradient) - root) / ALPHA * w
            n[at] += gradient * gradient
    all_weights = weights(np.arange(SIZE + 1))
    places = np.flatnonzero(all_weights[:SIZE])
    return Model(places, (all_weights[places] * values(places)).astype(np.float32), float(all_weights[SIZE]))


def held_out() -> Column:
    """Documents kept away from training: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | None:
    """Train on documents (doc_id, text) with labels (doc_id, toxic) that are not held out.

    At most ``most`` documents of each class are used, picked by a hash of the
    id; their features come to the driver. Scores are chances at the shares of
    the classes in that sample. None if a class has no documents. An id that is
    labelled both ways is toxic.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    picked = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toArrow() for k in (0, 1)]
    ids = np.concatenate([np.array(p.column("doc_id"), np.int64) for p in picked])
    marks = np.repeat([0, 1], [p.num_rows for p in picked])
    order = np.argsort(ids)
    ids, marks = ids[order], marks[order]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            chosen = np.flatnonzero(np.isin(keys.fill_null(0).to_numpy(), ids) & keys.is_valid().to_numpy(zero_copy_only=False))
            batch = batch.take(pa.array(chosen))
            for first, past, texts in blocks(_lowered(batch.column(1))):
                found, of = features(texts)
                pairs = np.unique(of * SIZE + found)
                parts = np.split((pairs % SIZE).astype("<u4"), np.searchsorted(pairs // SIZE, np.arange(1, len(texts))))
                own = batch.column(0).slice(first, past - first).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([own, pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "features"])

    sample = documents.select("doc_id", "text").mapInArrow(extract, "doc_id long, features binary").toArrow()
    found = sorted(zip(sample.column("doc_id").to_pylist(), sample.column("features").to_pylist()))
    if not found:
        return None
    rows = [np.append(np.frombuffer(f, "<u4").astype(np.int64), SIZE) for _, f in found]
    labelled = marks[np.searchsorted(ids, [d for d, _ in found])]
    if len(set(labelled.tolist())) < 2:
        return None
    return train(rows, labelled)


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, ``score`` (chance of being toxic) and ``predicted`` (score at least 0.5) of every row, from its whole text.

    A null or empty text has the chance of a text without known features;
    without a model all scores are 0. Repeated rows are scored each, other
    columns are ignored.
    """
    rows = documents.select("doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.dense()
        for batch in batches:
            for first, past, texts in blocks(_lowered(batch.column(1))):
                chance = model.score(texts, table)
                own = batch.column(0).slice(first, past - first).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([own, pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(judge, "doc_id long, score double, predicted int")


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on what is not held out and score all documents."""
    return score(documents, fit(documents, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
