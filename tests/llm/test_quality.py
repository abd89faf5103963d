import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from groundplan.llm import quality, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", "  \n ", "one", "a b a b a b", "x\nx\n\nx \n x\nx", "é#ß *$ %&|<> 😀", "a b c a b c d\na b c a b c d", "\n\n\n", "w\x0bv\x0cu\rt", "same same same same",
    "x " * 20_000, "   x", " lead\nlead\n lead", "a\r\na\r\n",
]


def plain(text):
    text = text or ""
    found = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    covered = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def random_texts(seed, count=200):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "b", "é", "#x", " ", " ", "\n", "\t", "word", "😀"]) for _ in range(rng.randint(0, 120))) for _ in range(count)]


@pytest.mark.parametrize("texts", [TEXTS, random_texts(1), random_texts(2)])
def test_base_counts(texts):
    got = quality.base_counts(words.read_texts(pa.array(texts, pa.string())))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert list(zip(*[got[n].tolist() for n in names])) == [plain(t) for t in texts]


def corpus(spark, seed=3):
    rng = random.Random(seed)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}%%" for i in range(300)]
    rows = []
    for i in range(300):
        vocabulary = bad if i % 5 == 0 else good
        rows.append((i, " ".join(rng.choices(vocabulary, k=rng.randint(60, 200))), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 300, 3)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_bad_documents_go_and_good_ones_stay(spark):
    _, docs, labels = corpus(spark)
    rows = quality.score_quality(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 300
    assert all(r.kept == (r.doc_id % 5 != 0) and not r.base_failed for r in rows)


def test_scores_equal_plain_multinomials(spark):
    rows, docs, labels = corpus(spark)
    trusted = {i for i in range(0, 300, 3) if i % 5}
    raw, target, grams = Counter(), Counter(), {}
    for doc_id, text, _ in rows:
        buckets, _ = quality.ngram_buckets(words.read_texts(pa.array([text])))
        grams[doc_id] = buckets.tolist()
        raw.update(grams[doc_id])
        if doc_id in trusted:
            target.update(grams[doc_id])
    scale = sum(raw.values()) / sum(target.values())
    want = {d: np.mean([np.log((target[b] * scale + quality.ADDED) / (raw[b] + quality.ADDED)) for b in g]) for d, g in grams.items()}
    got = {r.doc_id: r.score for r in quality.score_quality(docs, quality.fit(docs, labels)).collect()}
    assert got == pytest.approx(want)


def test_odd_texts_repeats_and_empty_tables(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x y z"), (3, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    ratio = quality.fit(docs, none)
    got = quality.score_quality(docs, ratio).collect()
    assert len(got) == len(rows) and all(r.score == 0 for r in got)
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    odd = spark.createDataFrame([(None, 1), (5, None), (999, 1), (4, 1), (4, 1)], "doc_id long, quality int")
    assert len(quality.score_quality(docs, quality.fit(docs, odd)).collect()) == len(rows)
    assert quality.score_quality(docs.limit(0), quality.fit(docs.limit(0), odd)).collect() == []


def test_target_has_a_bound(spark):
    labels = spark.range(500).selectExpr("id AS doc_id", "1 AS quality")
    ids = quality.target_ids(labels, 100)
    assert len(ids) == 100 and (np.diff(ids) > 0).all()
