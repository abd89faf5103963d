import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from groundplan.llm import alignment

FIRST, SECOND = public_tokenizers.path(alignment.FIRST_VOCABULARY), public_tokenizers.path(alignment.SECOND_VOCABULARY)
ODD = [
    "", " ", "  a  b ", "a\nb", "▁x", "a ▁ b", "<|endoftext|> plain <s>", "a\tb\r\n", "\x00a", "éé ß", "中文 \U0001f600 ok",
    "don't  stop\n\n\nnow", "a b c", " em　x", "the the the " * 50, "x" * 500,
]


@pytest.fixture(scope="module")
def tokens():
    return alignment.first_tokens(FIRST), alignment.second_tokens(SECOND)


def made_texts(count, seed):
    rng = random.Random(seed)
    words = ["the", "bearing", "naïve", "über", "co-op", "don't", "1024", "x.", "(see", "中文", "\n", "\t", "", "Straße,", "été", " ", "▁"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(count)]


def plain(texts, tokens):
    """Whole texts, token by token, with overlaps found by byte ranges."""
    (first, first_bytes), (second, second_bytes) = tokens
    found, links_of = [], []
    for text in texts:
        raw = (" " + text).encode() if text else b""
        a = first.encode(raw.decode(), add_special_tokens=False).ids if raw else []
        b = second.encode(text) if raw else []
        if b"".join(first_bytes[i] for i in a) != raw or b"".join(second_bytes[i] for i in b) != raw:
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(first_bytes[i]) for i in a]), np.cumsum([len(second_bytes[i]) for i in b])
        common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        cut = lambda ids, ends, lo, hi: ",".join(str(i) for i, e in zip(ids, ends) if lo < e <= hi)
        groups = ";".join(f"{cut(a, ends_a, lo, hi)}|{cut(b, ends_b, lo, hi)}" for lo, hi in zip([0, *common], common))
        begins_a, begins_b = np.concatenate([[0], ends_a])[:-1], np.concatenate([[0], ends_b])[:-1]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if begins_a[i] < ends_b[j] and begins_b[j] < ends_a[i]]
        found.append((len(a), len(b), len(common), len(links), groups))
        links_of.append(links)
    counts = Counter(link for links in links_of for link in links)
    most = {}
    for (a, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    held = Counter(link for links in links_of for link in set(links))
    rows = [(*f[:4], sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), f[4]) for f, links in zip(found, links_of)]
    return rows, counts, held


def shown(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups


def test_alignment_equals_plain_loops(spark, tokens, monkeypatch):
    texts = [None, *ODD, *made_texts(300, 7)]
    want, counts, held = plain(texts, tokens)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in alignment.align_documents(docs, with_groups=True).collect()}
    for i, row in enumerate(want):
        assert shown(rows[i]) == row, repr(texts[i])
        assert rows[i].groups_sha256 == (hashlib.sha256(row[6].encode()).hexdigest() if row[6] else "")
    table = alignment.read_alignments(docs)
    pairs = {(r.a, r.b): r for r in alignment.pair_counts(table).collect()}
    assert {k: (r.n_docs, r.n_links) for k, r in pairs.items()} == {k: (held[k], n) for k, n in counts.items()}


def test_given_documents(spark, tokens):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1200")
    own = docs.collect()
    want, _, _ = plain([r.text for r in own], tokens)
    rows = {r.doc_id: shown(r) for r in alignment.align_documents(docs, with_groups=True).collect()}
    assert rows == {r.doc_id: w for r, w in zip(own, want)}


def test_packed_sets():
    rng = np.random.default_rng(3)
    for count, documents in ((1, 1), (5, 40), (40, 3000), (3, 32768)):
        sets = [np.sort(rng.choice(documents, rng.integers(0, documents + 1), replace=False)) for _ in range(count)]
        owner = np.repeat(np.arange(count), [len(s) for s in sets])
        width = -(-documents // 8)
        data, offsets = alignment.pack(owner, np.concatenate(sets).astype(np.int64), count, width)
        assert alignment.popcounts(data, offsets, np.full(count, width)).tolist() == [len(s) for s in sets]
        owners, places = alignment.unpack(data, offsets, width)
        assert sorted(zip(owners.tolist(), places.tolist())) == sorted((i, int(p)) for i, s in enumerate(sets) for p in s)
        assert len(data) <= count * width


def test_small_blocks_give_the_same(spark, tokens):
    from pyspark.sql import functions as F

    texts = [*ODD, *made_texts(60, 9)] * 2
    want, _, _ = plain(texts, tokens)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    rows = {r.doc_id: shown(r) for r in alignment.align_documents(docs, with_groups=True).collect()}
    assert rows == dict(enumerate(want))
    assert alignment.read_alignments(docs).agg(F.count_distinct("block")).first()[0] == 40


def test_empty_table_repeats_null_ids_and_clashing_columns(spark):
    schema = "doc_id long, text string, a string, block string, n_links string"
    assert alignment.align_documents(spark.createDataFrame([], schema)).count() == 0
    rows = alignment.align_documents(spark.createDataFrame([(1, "a b", "", "", ""), (1, "a b", "", "", ""), (None, "a", "", "", ""), (None, None, "", "", "")], schema)).collect()
    assert len(rows) == 4 and sum(r.doc_id is None for r in rows) == 2
    twice = [r for r in rows if r.doc_id == 1]
    assert twice[0] == twice[1] and twice[0].count_sum == 2 * 1 + 3
