"""Token counts by byte-pair merging, without the tokens.

A stretch of text starts as a linked list of its characters. A heap holds the
adjacent pairs that join to a piece, by the rank of that piece and then by
place; the least is joined and its new neighbours enter the heap until none is
left. The count is the number of characters at the start, a character without
a piece counting its UTF-8 bytes, less the number of merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.llm.units import Stretches, cut_at_spaces, give_back, per_text, with_space
from groundplan.llm.words import Texts, blocks, text_column

VOCABULARY = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
# a pair is one number in the heap: rank of its piece, then place
_PLACE = 40
_PLACES = (1 << _PLACE) - 1
# bytes that a task keeps for words it has counted
KEPT_BYTES = 80_000_000


class Merges:
    """Counts tokens of single stretches with the pieces and ranks of a vocabulary file."""

    def __init__(self, vocabulary: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=vocabulary)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        scores = sorted({model.get_score(i) for i in ids}, reverse=True)
        place = {score: rank for rank, score in enumerate(scores)}
        self.rank = {model.id_to_piece(i): place[model.get_score(i)] for i in ids}
        self.lone = {piece for piece in self.rank if len(piece) == 1}
        across = [p for p in self.rank if "▁" in p.lstrip("▁")]
        if across or any(not self.lone.issuperset(piece) for piece in self.rank):
            raise ValueError("the counts need every character of a piece to be a piece, and spaces only in front of one")

    def count(self, text: str) -> int:
        """Tokens of a stretch that begins with a space."""
        rank = self.rank.get
        symbols = list(text.replace(" ", "▁"))
        size = len(symbols)
        start = size if self.lone.issuperset(symbols) else sum(1 if c in self.lone else len(c.encode()) for c in symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r << _PLACE) | i for i, r in enumerate(map(rank, map(add, symbols, symbols[1:]))) if r is not None]
        heapify(heap)
        merges = 0
        while heap:
            least = heappop(heap)
            i = least & _PLACES
            j = after[i]
            if j >= size or (left := symbols[i]) is None:
                continue
            joined = left + symbols[j]
            if rank(joined) != least >> _PLACE:
                continue  # one side has been joined to something else
            merges += 1
            symbols[i], symbols[j] = joined, None
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (r := rank(joined + symbols[k])) is not None:
                    heappush(heap, (r << _PLACE) | i)
            if (k := before[i]) >= 0 and (r := rank(symbols[k] + joined)) is not None:
                heappush(heap, (r << _PLACE) | k)
        return start - merges


class Counter:
    """Token counts of texts; a stretch met before in the task is not merged again."""

    def __init__(self, vocabulary: str):
        self.merges = Merges(vocabulary)
        self.sizes: list[int] = []
        self.stretches = Stretches(self._learn, self.sizes.clear, KEPT_BYTES)

    def _learn(self, strings: list[bytes]) -> int:
        self.sizes.extend(self.merges.count(s.decode()) for s in strings)
        return 40 * len(strings)

    def count(self, texts: Texts) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for first, past, part in blocks(texts):
            part = with_space(part)
            units = cut_at_spaces(part)
            numbers = self.stretches.numbers(part, units)
            out[first:past] = per_text(units, np.array(self.sizes, np.int64)[numbers] if len(numbers) else np.zeros(0, np.int64))
        return out


def count_tokens(documents: DataFrame, vocabulary: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Bytes and tokens of every whole text (doc_id, text).

    Null and empty texts have no bytes and no tokens. Equal rows are counted each
    for itself, null ids stay null, other columns are not read, and an empty table
    gives an empty result. ``vocabulary`` is the path of a sentencepiece BPE model
    with byte fallback, a space put in front, and no other normalisation. A task
    keeps counts of stretches up to a fixed number of bytes, and ends with them.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            texts = text_column(batch)
            counts = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(texts.offsets).astype(np.int64)), pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )
            give_back()

    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
