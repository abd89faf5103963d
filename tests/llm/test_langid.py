import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundplan.llm import langid, words

PARTS = {"aa": ["the", "ing", "tion", "and"], "bb": ["ou", "eau", "é", "que"], "cc": ["sch", "ung", "keit", "ß"]}


def documents(count=240):
    rng = random.Random(3)
    rows = []
    for i in range(count):
        lang = sorted(PARTS)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(PARTS[lang], k=3)) for _ in range(rng.randint(20, 120))), lang, "x"))
    return rows


SCHEMA = "doc_id long, text string, lang string, score string"


@pytest.fixture(scope="module")
def network(spark):
    return langid.fit(spark.createDataFrame(documents(), SCHEMA))


def test_held_out_accuracy(spark):
    rows = langid.identify(spark.createDataFrame(documents(), SCHEMA)).collect()
    truth = {d[0]: d[2] for d in documents()}
    tested = [r for r in rows if r.held_out]
    assert len(rows) == 240 and 40 < len(tested) < 120
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in tested]) > 0.95


def test_labels_do_not_reach_held_out_rows(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    spoiled = df.withColumn("lang", F.when(langid.held_out(), "aa").otherwise(F.col("lang"))).withColumn("score", F.lit("z"))
    key = lambda d: sorted(langid.identify(d).collect())
    assert key(df) == key(spoiled)


def test_odd_texts(spark, network):
    rows = [(1, None), (2, ""), (3, "123 !! \n"), (4, "é"), (5, "the and " * 50_000), (5, "the and " * 50_000), (None, "queou éeau queque")]
    got = langid.predict(spark.createDataFrame([(*r, "en", "own") for r in rows], SCHEMA), network)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    found = [(r.doc_id, r.lang_pred, r.score) for r in got.collect()]
    assert [(d, p) for d, p, _ in found[:3]] == [(1, "und"), (2, "und"), (3, "und")] and all(s == 0 for _, _, s in found[:3])
    assert found[3][1] in PARTS and found[4] == found[5] and found[4][1] == "aa" and found[6][1] == "bb"


def test_no_labels_and_no_rows(spark, network):
    df = spark.createDataFrame([(1, "some text", None, "x")], SCHEMA)
    assert [tuple(r) for r in langid.identify(df).collect()] == [(1, False, "und", 0.0)]
    assert langid.predict(df.limit(0), network).collect() == []
    assert langid.keep_identified(df).collect() == []


def test_filter_keeps_columns_and_clean_rows(spark):
    df = spark.createDataFrame([*documents(), (900, "12 34", "aa", "x"), (901, None, "aa", "x")], SCHEMA)
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(240))


def test_windows_cover_whole_texts():
    texts = words.read_texts(pa.array(["", "a" * 128, "b" * 129, None, "c" * 300]))
    laid, counts = langid.windows_of(texts)
    assert counts.tolist() == [1, 1, 2, 1, 3]
    assert bytes(laid.tobytes()).replace(b"\0", b"") == b"a" * 128 + b"b" * 129 + b"c" * 300


def test_tables_equal_plain_convolution(network):
    rng = np.random.default_rng(1)
    window = rng.integers(0, 256, (1, langid.WINDOW)).astype(np.uint8)
    got, _ = network.responses(window, network.tables())
    for k, bank in enumerate(network.banks):
        for f in range(langid.FILTERS):
            each = [sum(network.vectors[window[0, p + j]] @ bank[j, :, f] for j in range(len(bank))) for p in range(langid.WINDOW - len(bank) + 1)]
            n = k * langid.FILTERS + f
            assert got[0, n] == pytest.approx(max(each) + network.bias[n], abs=1e-4)
