import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from groundplan.llm import collocations

SCHEMA = "text string, lang string"


def plain(rows, longest=5, threshold=3, top=2000, absorb=100):
    """The contract with plain counters."""
    words, counts = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered):
            own = [w for w in re.split(r"[ \t]+", piece) if w]
            words[lang] += len(own)
            for m in range(1, longest + 1):
                for i in range(len(own) - m + 1):
                    counts[lang][tuple(own[i : i + m])] += 1
    out = []
    for lang, found in counts.items():
        kept = []
        often = {p: f for p, f in found.items() if f >= threshold}
        inside = lambda short, long: any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))
        for p, a in often.items():
            if len(p) < 2:
                continue
            if any(len(q) > len(p) and 100 * f >= absorb * a and inside(p, q) for q, f in often.items()):
                continue
            score, k = min((1000 * a * words[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), found[p[:k]], found[p[k:]]))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, le, r, words[lang], s) for i, (s, a, p, le, r) in enumerate(kept[:top])]
    return sorted(out)


def made(count, seed):
    rng = random.Random(seed)
    common = ["the", "Of", "limit", "state", "design", "é", "Été", "中文", "a\x00b", "\x1c"]
    rows = []
    for _ in range(count):
        parts = []
        for _ in range(rng.randrange(0, 40)):
            parts.append(rng.choice([rng.choice(common), rng.choice(common), "bearing  capacity\tfactor", "x%d" % rng.randrange(40)]))
            parts.append(rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  ", "!? ", "\r\n"]))
        rows.append(("".join(parts), rng.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("bits", [1 << 12, 1 << 20])
def test_collocations_equal_plain_counters(spark, bits):
    rows = made(300, 4) + [(None, "en"), ("", None), ("lone", "fr")]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), threshold=3, filter_bits=bits)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_top_and_absorb(spark):
    rows = made(200, 8)
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), threshold=4, top=5, absorb_percent=60)
    assert sorted(map(tuple, got.collect())) == plain(rows, threshold=4, top=5, absorb=60)


def test_summary_never_loses_a_frequent_key():
    rng = np.random.default_rng(2)
    for threshold, spread in ((10, 50_000), (100, 5_000), (3, 200)):
        stream = np.concatenate([rng.integers(0, spread, 40_000), np.repeat(rng.integers(0, spread, 30), threshold)]).astype(np.uint32)
        rng.shuffle(stream)
        summary = collocations.Summary(len(stream) // threshold + 1)
        for part in np.array_split(stream, 37):
            summary.add(*np.unique(part, return_counts=True))
            summary.merge()
        keys, counts = np.unique(stream, return_counts=True)
        assert set(keys[counts >= threshold].tolist()) <= set(summary.at_least(threshold).tolist())
        assert len(summary.keys) <= summary.capacity and summary.missed < threshold
        exact = dict(zip(keys.tolist(), counts.tolist()))
        assert all(exact[k] - summary.missed <= c <= exact[k] for k, c in zip(summary.keys.tolist(), summary.counts.tolist()))


def test_merged_summaries_take_counts_off():
    summary = collocations.Summary(2)
    summary.add(np.array([1, 2, 3], np.uint32), np.array([5, 2, 1]))
    summary.merge()
    assert (summary.keys.tolist(), summary.counts.tolist(), summary.missed) == ([1, 2], [4, 1], 1)


def test_packed_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 1000, dtype=np.uint32))
    for part in (keys, keys[:1], keys[:0]):
        assert collocations.unpack_keys(collocations.pack_keys(part)).tolist() == part.tolist()


def test_empty_tables_and_clashing_columns(spark):
    schema = "text string, lang string, phrase string, times string, part string"
    assert collocations.collocations(spark.createDataFrame([], schema)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None, "", "", "")], schema)).count() == 0
    rows = [("a b", "en", "", "", "")] * 4
    got = collocations.collocations(spark.createDataFrame(rows, schema), threshold=2).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", 4, 4, 4, 8, 2000)]


def test_counts_beyond_64_bits_stay_exact(spark):
    rows = [("a b " * 50, "en")] * 3
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), threshold=100).collect()
    assert sorted(map(tuple, got)) == plain(rows, threshold=100)
