import random

import numpy as np
import pyarrow as pa
import pytest

from groundplan.llm import minhash, words
from groundplan.llm.components import components

SCHEMA = "doc_id long, text string, kept string"


def plain_sets(text, size):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = lowered.encode().split()
    if not parts:
        return set()
    return {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)} or {tuple(parts)}


def plain(rows, size, percent):
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, []).append(plain_sets(text, size))
    ids = sorted(sets)
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            near = any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j])
            if near:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def mutated(rng, parts, changes):
    parts = list(parts)
    for _ in range(changes):
        parts[rng.randrange(len(parts))] = f"new{rng.randrange(10**6)}"
    return parts


def near_groups(seed, bases, copies, longest, changes):
    rng = random.Random(seed)
    texts = []
    for b in range(bases):
        parts = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(1, longest))]
        texts.append(" ".join(parts))
        for _ in range(rng.randint(0, copies)):
            parts = mutated(rng, parts, rng.randint(0, changes))  # a chain: each copy changes the one before
            texts.append(" ".join(parts).title() if rng.random() < 0.3 else "\n ".join(parts))
    rng.shuffle(texts)
    return list(enumerate(texts))


def compare(spark, rows, size, percent):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    got = minhash.near_duplicates(df, size, percent).collect()
    want = plain(rows, size, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return got


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_chains_of_copies(spark, size, percent):
    got = compare(spark, near_groups(1, 40, 12, 150, 4), size, percent)
    assert 40 < sum(r.kept for r in got) < len(got)


def test_parts_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART_SETS", 40)
    monkeypatch.setattr(minhash, "SHARED", 4)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows = [" ".join(mutated(rng, base, rng.randint(0, 14))) for _ in range(300)]
    got = compare(spark, list(enumerate(rows)), 3, 85)
    assert len({r.component_id for r in got}) > 1


def test_many_equal_texts_and_a_common_passage(spark):
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, "the same text every time, word by word") for i in range(500)]
    rows += [(i, f"{common} " + " ".join(f"t{i}x{k}" for k in range(60))) for i in range(500, 700)]
    compare(spark, rows, 3, 85)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "Two one"), (8, "a b c"), (9, "É b c"), (10, "é b c"), (11, "x " * 40_000), (12, "x x x")]
    got = {r.doc_id: r for r in compare(spark, rows, 3, 85)}
    assert [got[i].n_shingles for i in (1, 2, 3, 4, 6, 8, 11)] == [0, 0, 0, 1, 1, 1, 1]


def test_repeated_rows_and_null_ids(spark):
    text = "some words that are long enough for shingles"
    df = spark.createDataFrame([(3, text, "x"), (3, text, "x"), (None, text, "x"), (5, text, "x"), (5, "another text for the id five", "x"), (6, "another text for the id five", "x")], SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert got == [(3, 3, True), (3, 3, True), (5, 3, False), (5, 3, False), (6, 3, False), (None, None, True)]
    kept = minhash.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3]
    assert minhash.near_duplicates(df.limit(0)).collect() == [] and minhash.keep_one_of_each(df.limit(0)).collect() == []


def test_corrected_estimate():
    rng = np.random.default_rng(4)
    count = 800
    for share in (0.3, 0.6, 0.9):
        common, own = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64), rng.integers(0, 2**63, 1000, dtype=np.uint64)
        half = (1000 - len(common)) // 2
        sets = [np.unique(np.concatenate([common, own[:half]])), np.unique(np.concatenate([common, own[half : 2 * half]]))]
        bits = minhash.packed_bits(minhash.minima(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), count))
        rate = minhash.agreeing(bits[0], bits[1:], count)[0] / count
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        assert abs((rate - 1 / 16) / (1 - 1 / 16) - true) < 0.07


def test_words_as_the_byte_split():
    texts = ["a  b\tc\x0bd\x0ce\rf\ng", "é ß x   y", "", "  ", "x" * 300_000 + " " + "y" * 10]
    read = words.read_texts(pa.array(texts))
    found = words.find_words(read)
    raw = read.data.tobytes()
    spans = [raw[a:b] for a, b in zip(found.starts, found.ends)]
    assert spans == [w for t in texts for w in t.encode().split()]
    hashes = words.hash_words(read.data, found)
    assert len(set(hashes.tolist())) == len(set(spans))
    again = words.read_texts(pa.array(["zz " + t for t in texts])[1:])
    assert words.hash_words(again.data, words.find_words(again)).tolist()[1:4] == hashes[7:10].tolist()


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5), (None, 3), (2001, 2000), (2000, 2001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    want = {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)} | {2000: 2000, 2001: 2000}
    assert got == want


@pytest.mark.parametrize("swap", [False, True])
def test_unlike_texts_under_one_id_keep_their_links(spark, swap):
    """Each id stands on two unlike texts, and another id is near to either of them."""
    import random

    rng = random.Random(4)
    made = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    rows, want = [], {}
    for i in range(30):
        one, two = made(), made()
        near = [" ".join([*t.split(" ")[:-1], "end"]) for t in (one, two)]
        own = [(3 * i, one), (3 * i, two), (3 * i + 1, near[0]), (3 * i + 2, near[1])]
        rows += own[::-1] if swap else own
        want |= {3 * i + k: 3 * i for k in range(3)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == 120


def test_unlike_texts_under_one_id_stay(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(40)]
    rows = [(i // 2, t, i) for i, t in enumerate(texts)] + [(0, texts[0], 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept int")
    kept = minhash.keep_one_of_each(docs.withColumnRenamed("_kept", "extra")).collect()
    assert sorted(r.text for r in kept) == sorted(texts)
