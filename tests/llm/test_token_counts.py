import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from groundplan.llm import token_counts, units
from groundplan.llm.words import read_texts

VOCABULARY = public_tokenizers.path(token_counts.VOCABULARY)

ODD = [
    "", " ", "  a  b ", "a\nb", "▁x", "a ▁ b", "x▁ y", "<s> hi </s> <0x0A> <unk>", "a\tb\r\n", "\x00a", "éé", "ﬁ 中文 \U0001f600",
    "a" * 3000, " " * 1001 + "x" + " " * 17, "1234567 99", "word " * 400, " nbsp em", "don't  stop\n\n\nnow",
]


@pytest.fixture(scope="module")
def model():
    return SentencePieceProcessor(model_file=VOCABULARY)


def made_texts(count, seed):
    rng = random.Random(seed)
    letters = "aeionrst hl,.THEéü▁ \n\t0157<>/sun中\U0001f600"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 80))) for _ in range(count)]


def test_counts_equal_the_library(spark, model):
    texts = ODD + made_texts(1500, 5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (None, "x y")], "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs).collect()}
    for i, text in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens) == (len(text.encode()), len(model.encode(text))), repr(text)
    assert (got[-1].n_bytes, got[-1].n_tokens, got[-1].over_limit) == (0, 0, False)
    assert got[None].n_tokens == len(model.encode("x y"))


def test_given_documents_and_limit(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs, limit=500).collect()}
    for r in docs.collect():
        size = len(model.encode(r.text or ""))
        assert rows[r.doc_id].n_tokens == size and rows[r.doc_id].over_limit == (size > 500)


def test_a_small_store_forgets_and_still_counts(model):
    counter = token_counts.Counter(VOCABULARY)
    counter.stretches.most = 1
    import pyarrow as pa

    for part in (made_texts(50, 1), made_texts(50, 2), made_texts(50, 1)):
        assert counter.count(read_texts(pa.array(part))).tolist() == [len(model.encode(t)) for t in part]
        assert len(counter.sizes) == len(counter.stretches.number)


def test_empty_table_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, n_tokens string, n_bytes string"
    assert token_counts.count_tokens(spark.createDataFrame([], schema)).count() == 0
    rows = token_counts.count_tokens(spark.createDataFrame([(1, "a b", "x", "y")] * 2, schema)).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].n_tokens == 2


def test_stretches_cover_the_text():
    import pyarrow as pa

    texts = units.with_space(read_texts(pa.array(made_texts(200, 3))))
    for cut in (units.cut_at_spaces, units.cut_between_words):
        words = cut(texts)
        assert words.counts.sum() == len(words.starts)
        joined = b"".join(texts.data[a:b].tobytes() for a, b in zip(words.starts, words.ends))
        assert joined == texts.data.tobytes()
        assert set(texts.offsets[:-1][texts.offsets[:-1] < texts.offsets[1:]].tolist()) <= set(words.starts.tolist())
