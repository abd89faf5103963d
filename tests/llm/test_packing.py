import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groundplan.llm import packing, words

TEXTS = [
    None, "", " \n\t ", "Plain words, it's done!", "x" * 5000, "a b " * 3000, "é ñ ß İ Σας", "don't 'S'S 12a3 a.b.c --'s!",
    "<|endoftext|> and <|startoftext|>", "half <| open", "\x01 between \x01", "same text", "same text", "日本語 テスト…", "tab\x0bfeed\x0cend", "é ≠ x y",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string").repartition(3)


def check_layout(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_pieces_and_layout(spark, tokenizer, capacity):
    rows = packing.pack_documents(rows_of(spark, TEXTS), capacity).collect()
    want = {}
    for i, text in enumerate(TEXTS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), capacity):
            part = ids[start : start + capacity]
            want[i, start // capacity] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    used = check_layout(rows, capacity)
    assert used >= math.ceil(sum(r.length for r in rows) / capacity)


def test_repeated_rows_are_packed_each_time(spark):
    df = rows_of(spark, ["one two three"] * 5)
    rows = packing.pack_documents(df.union(df)).collect()
    assert len(rows) == 10 and check_layout(rows, packing.CAPACITY) == 1


def test_empty_table(spark):
    assert packing.pack_documents(rows_of(spark, ["x"]).limit(0)).collect() == []


def test_ids_column(spark, tokenizer):
    row = packing.token_pieces(rows_of(spark, ["Two words"]), with_ids=True).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [*tokenizer.encode("Two words", add_special_tokens=False).ids, 0]


def test_one_length_holds_most_pieces(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g").alias("text")).unionAll(
        spark.range(300).select((F.col("id") + 5000).alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") + 1).cast("int")).alias("text"))
    )
    rows = packing.pack_documents(df, 512).collect()
    total = sum(r.length for r in rows)
    assert len(rows) == 5300 and check_layout(rows, 512) <= math.ceil(total / 512) + 2


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(5)
    histogram = {int(k): int(v) for k, v in zip(range(1, 257), rng.integers(0, 400, 256)) if v}
    planned = packing.plan_sequences(histogram, 256)
    used = defaultdict(int)
    for content, times in planned:
        assert sum(length * copies for length, copies in content) <= 256
        for length, copies in content:
            used[length] += copies * times
    assert dict(used) == histogram
    total = sum(k * v for k, v in histogram.items())
    assert sum(times for _, times in planned) <= math.ceil(total / 256) * 1.03 + 1


def test_worker_forgets_words_beyond_its_limit(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    ids = packing.WordIds(public_tokenizers.path(packing.VOCABULARY))
    for part in range(6):
        texts = [f"word{part}x{i} again" for i in range(30)]
        flat, bounds = ids.encode(words.read_texts(pa.array(texts)))
        for i, text in enumerate(texts):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_words_are_learned_without_an_array_for_each(monkeypatch):
    ids = packing.WordIds(public_tokenizers.path(packing.VOCABULARY))
    made = []
    array = np.array
    monkeypatch.setattr(packing.np, "array", lambda *x, **y: made.append(1) or array(*x, **y))
    monkeypatch.setattr(packing.np, "split", lambda *x, **y: pytest.fail("one array a word"))
    flat, sizes = ids._encode([f"word{i}" for i in range(4000)])
    assert len(sizes) == 4000 and sizes.sum() == len(flat) and len(made) < 100


def test_numbers_are_no_words_of_their_own(tokenizer):
    texts = [f"id{i}x{i * 7919}, 3'{i}s {i}é é{i} it's{i}'s" for i in range(500)]
    ids = packing.WordIds(public_tokenizers.path(packing.VOCABULARY))
    flat, bounds = ids.encode(words.read_texts(pa.array(texts)))
    for i, text in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert len(ids.place) < 200
