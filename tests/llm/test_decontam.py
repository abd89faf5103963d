import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from groundplan.llm import decontam


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def make(seed, items=30, docs=60):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    rare = [f"r{i}" for i in range(900)]
    texts = {}
    for i in range(items):
        body = [rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.randint(9, 70))]
        at = rng.randint(4, len(body) - 3)
        texts[i] = " ".join(body[:at]).capitalize() + ". " + " ".join(body[at:]) + "."
    rows = []
    for d in range(docs):
        body = [rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.randint(0, 600))]
        for i in rng.sample(range(items), rng.choice([0, 0, 1, 2])):
            leak = plain_words(texts[i])
            for _ in range(rng.randint(0, 3)):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = leak
        rows.append((d, " ".join(body)))
    return list(texts.items()), rows


def grams(words):
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {(w,) for w in words}


def plain_leaks(items, rows):
    """Every passage against every item, by dictionaries."""
    words = {i: plain_words(t) for i, t in items if len(plain_words(t)) >= decontam.LEAST_WORDS}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    impact = {}
    for i, ws in words.items():
        part = {}
        for w, tf in Counter(ws).items():
            idf = math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5))
            part[w] = idf * tf * (decontam.K1 + 1) / (tf + decontam.K1 * (1 - decontam.B + decontam.B * len(ws) / mean))
        total = sum(part.values())
        impact[i] = {w: x / total for w, x in part.items()}
    half = max(decontam.HALF_PASSAGE, max(map(len, words.values())))
    found = {}
    for d, text in rows:
        ws = plain_words(text)
        for start in range(0, max(len(ws) - half, 1), half):
            passage = ws[start : start + 2 * half]
            for i in words:
                score = sum(x for w, x in impact[i].items() if w in set(passage))
                if score < decontam.THRESHOLD:
                    continue
                sentences = [plain_words(s) for s in re.split(r"[.!?]\s+|\n", dict(items)[i].lower()) if s.strip()]
                cuts = [c for c in np.cumsum([len(s) for s in sentences]).tolist() if 0 < c < len(words[i])]
                at = cuts[-1] if cuts else len(words[i]) - max(1, len(words[i]) // 4)
                shares = []
                for part in (words[i][:at], words[i][at:]):
                    own = grams(passage) if len(part) > 2 else {(w,) for w in passage}
                    shares.append(len(grams(part) & own) / len(grams(part)))
                if shares[0] >= decontam.QUESTION and shares[1] >= decontam.ANSWER:
                    found[d, i] = max(found.get((d, i), (0,)), (score, *shares))
    return found


def compare(spark, items, rows):
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double").repartition(3)
    tests = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in decontam.find_leaks(docs, tests).collect()}
    want = plain_leaks(items, rows)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    clean = decontam.without_leaks(docs, tests)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in rows if d not in {k[0] for k in want})
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_leaks_and_no_others(spark, seed):
    items, rows = make(seed)
    assert len(compare(spark, items, rows)) > 20


def test_shards_keep_scores(spark, monkeypatch):
    items, rows = make(4)
    monkeypatch.setattr(decontam, "SHARD_CHARS", 1000)
    monkeypatch.setattr(decontam.build_indexes, "__defaults__", (1000,))
    assert compare(spark, items, rows)


def test_wand_equals_full_scores(spark):
    items, rows = make(5, items=120, docs=1)
    index = next(decontam.build_indexes(spark.createDataFrame(items, "item_id long, text string")))
    rng = np.random.default_rng(1)
    for threshold in (0.05, 0.2, 0.4):
        for _ in range(60):
            terms = np.sort(rng.choice(len(index.terms), rng.integers(1, 120), replace=False))
            full = np.zeros(len(index.items))
            for t in terms:
                full[index.posted[index.begins[t] : index.begins[t + 1]]] += index.impacts[index.begins[t] : index.begins[t + 1]]
            got = dict(decontam.search(index, terms, threshold))
            assert set(got) == set(np.flatnonzero(full >= threshold).tolist())
            assert all(abs(full[i] - s) < 1e-9 for i, s in got.items())


def test_odd_texts_and_empty_tables(spark):
    item = "One two three four five. Six seven eight nine ten."
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "too short"), (None, item)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "!!"), (4, item.upper()), (4, item.upper()), (5, "w " * 100_000 + item), (None, item), (6, "one two three four five"), (7, "ten nine eight seven six five four three two one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, tests).collect()), key=repr)
    assert sorted(set(got), key=repr) == [(4, 1), (5, 1), (None, 1)]
    assert sorted((r.doc_id for r in decontam.without_leaks(docs, tests).collect())) == [1, 2, 3, 6, 7]
    assert decontam.find_leaks(docs, tests.limit(0)).collect() == [] and decontam.without_leaks(docs, tests.limit(0)).count() == 9
    assert decontam.find_leaks(docs.limit(0), tests).collect() == []


def test_short_items_stand_word_for_word(spark):
    docs = spark.createDataFrame(
        [(1, "A quiz. Capital of France? It is Paris. Next one."), (2, "It is Paris, the capital of France that they named."), (3, "paris"), (4, "Berlin and London"), (5, None)],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, "Capital of France? It is Paris."), (2, "Madrid"), (3, "Berlin"), (4, "...")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()) == [(1, 1), (4, 3)]
    assert sorted(r.doc_id for r in decontam.without_leaks(docs, items).collect()) == [2, 3, 5]
