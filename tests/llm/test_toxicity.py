import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundplan.llm import toxicity, words

BAD = ["nasty", "vile", "awful", "rotten"]


def corpus(count=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(count):
        body = [f"w{rng.randrange(400)}" for _ in range(rng.randint(30, 120))]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            body.insert(rng.randrange(len(body)), rng.choice(BAD).upper() if rng.random() < 0.2 else rng.choice(BAD) + "!")
        rows.append((i, " ".join(body), "x"))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def frames(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(frames):
    rows = toxicity.score_toxicity(*frames).collect()
    assert len(rows) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in tested]) > 0.95


def test_held_out_labels_are_not_used(frames):
    docs, labels = frames
    spoiled = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.score_toxicity(docs, labels).collect()) == sorted(toxicity.score_toxicity(docs, spoiled).collect())


def test_weights_are_sparse_and_sampled(frames):
    model = toxicity.fit(*frames)
    assert 0 < len(model.places) < 2000
    assert toxicity.fit(*frames, most=20) is not None


def test_scores_equal_a_plain_sum(spark, frames):
    model = toxicity.fit(*frames)
    table = model.dense()
    texts = ["nasty w1 w2, nasty", "", "w3 w4", "a VILE thing. vile"]
    got = model.score(words.read_texts(pa.array([t.lower() for t in texts])), table)
    for text, score in zip(texts, got):
        found, _ = toxicity.features(words.read_texts(pa.array([text.lower()])))
        raw = model.bias + sum(float(table[f]) for f in set(found.tolist()))
        assert score == pytest.approx(1 / (1 + np.exp(-raw)))


def test_odd_texts_and_empty_tables(spark, frames):
    docs, labels = frames
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!! ?"), (None, "nasty vile awful"), (4, "w1 " * 200_000 + "nasty vile rotten"), (4, "w1 " * 200_000 + "nasty vile rotten")], "doc_id long, text string")
    rows = {}
    for r in toxicity.score(odd, model).collect():
        assert rows.setdefault(r.doc_id, r) == r
    assert rows[1].score == rows[2].score == rows[3].score < 0.5 and rows[None].predicted == 1 == rows[4].predicted
    for some in (labels.limit(0), labels.filter("toxic = 1"), labels.filter("doc_id > 100000")):
        assert {(r.score, r.predicted) for r in toxicity.score_toxicity(docs, some).collect()} == {(0.0, 0)}
    assert toxicity.score(docs.limit(0), model).collect() == []
    strange = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, 0, None), (5, 1, 1), (5, 1, 0), (5, 1, 7)], labels.schema))
    assert toxicity.fit(docs, strange) is not None
