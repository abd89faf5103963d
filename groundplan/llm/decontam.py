"""Benchmark decontamination: every passage of the corpus asks a BM25 index of the test items.

The index is the small side: its shards of bounded size go to the tasks, the
corpus is read once for each, and no text is shuffled. Impacts are divided by
the item's highest possible score, so one threshold serves all items. A bound on
rare terms, taken over many passages at a time, leaves out the passages that
cannot reach the threshold; the others run block-max WAND over the postings.
What it finds must share word n-grams with both question and answer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.llm.units import tidy
from groundplan.llm.words import CLASSES, PUNCTUATION, Texts, blocks, find_words, hash_words, read_texts
from groundplan.session import stored

K1, B = 1.2, 0.75
# share of an item's highest score that a passage must reach
THRESHOLD = 0.6
# shares of the n-grams of question and answer that the passage must hold
QUESTION, ANSWER = 0.5, 0.5
NGRAM = 3
# items of fewer words must stand in the text word for word
LEAST_WORDS = 8
# words of a half passage at least; longer where items are longer
HALF_PASSAGE = 64
# share of an item's score that its common terms may hold among them
_COMMON = 0.3
# postings in a block
_BLOCK = 8
# characters of items in one shard of the index, which the driver and each task hold
SHARD_CHARS = 8_000_000


def word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts without ASCII punctuation, and where each text's begin."""
    words = find_words(texts, split_punctuation=True)
    kept = CLASSES[texts.data[words.starts]] != PUNCTUATION if len(words.starts) else np.zeros(0, bool)
    hashes = hash_words(texts.data, words)[kept]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(words.text_of[kept], minlength=len(texts)))]).astype(np.int64)


def _lowered(column: pa.Array) -> Texts:
    return read_texts(pc.utf8_lower(column))


def _grams(hashes: np.ndarray) -> np.ndarray:
    """Distinct word n-grams; of fewer words, the words."""
    if len(hashes) < NGRAM:
        return np.unique(hashes)
    value = hashes[: len(hashes) - NGRAM + 1]
    for k in range(1, NGRAM):
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - NGRAM + 1 + k]
    return np.unique(value)


@dataclass
class Index:
    """Postings of items (by number) with impacts, their bounds, and the n-grams to verify."""

    items: np.ndarray
    terms: np.ndarray  # sorted hashes
    begins: np.ndarray  # postings of a term, ascending items
    posted: np.ndarray
    impacts: np.ndarray
    rare: np.ndarray  # terms outside the common ones
    common_share: np.ndarray  # of each item's score
    question: list[np.ndarray]
    answer: list[np.ndarray]
    parts: list[tuple[int, int]]  # words of question and answer
    whole: dict[int, np.ndarray]  # the words of short items
    half: int
    term_bound: np.ndarray = field(init=False)
    block_bound: list[list[float]] = field(init=False)

    def __post_init__(self) -> None:
        spans = list(zip(self.begins[:-1].tolist(), self.begins[1:].tolist()))
        self.term_bound = np.array([self.impacts[a:b].max() for a, b in spans])
        self.block_bound = [[float(self.impacts[i : min(i + _BLOCK, b)].max()) for i in range(a, b, _BLOCK)] for a, b in spans]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the term of each hash, -1 for words of no item."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def _holds(words: np.ndarray, run: np.ndarray) -> bool:
    """Whether ``run`` stands in ``words`` without a gap."""
    count = len(words) - len(run) + 1
    if count <= 0:
        return False
    same = np.ones(count, bool)
    for k, word in enumerate(run):
        same &= words[k : k + count] == word
    return bool(same.any())


def search(index: Index, terms: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
    """All items that score at least ``threshold`` for distinct ``terms``: block-max WAND."""
    lists = [(index.posted[index.begins[t] : index.begins[t + 1]].tolist(), index.impacts[index.begins[t] : index.begins[t + 1]].tolist(), float(index.term_bound[t]), index.block_bound[t]) for t in terms.tolist()]
    places = [0] * len(lists)
    live = list(range(len(lists)))
    found = []
    while live:
        live.sort(key=lambda i: lists[i][0][places[i]])
        bound, pivot = 0.0, -1
        for n, i in enumerate(live):
            bound += lists[i][2]
            if bound >= threshold - 1e-9:
                pivot = n
                break
        if pivot < 0:
            break
        item = lists[live[pivot]][0][places[live[pivot]]]
        while pivot + 1 < len(live) and lists[live[pivot + 1]][0][places[live[pivot + 1]]] == item:
            pivot += 1
        bound, ahead = 0.0, lists[live[pivot + 1]][0][places[live[pivot + 1]]] if pivot + 1 < len(live) else len(index.items)
        for i in live[: pivot + 1]:
            posted = lists[i][0]
            at = bisect_left(posted, item, places[i])
            if at < len(posted):
                bound += lists[i][3][at // _BLOCK]
                end = min((at // _BLOCK + 1) * _BLOCK, len(posted)) - 1
                ahead = min(ahead, posted[end] + 1)
        if bound >= threshold - 1e-9:
            if lists[live[0]][0][places[live[0]]] == item:
                score = 0.0
                for i in live[: pivot + 1]:
                    score += lists[i][1][places[i]]
                    places[i] += 1
                if score >= threshold - 1e-9:
                    found.append((item, score))
            else:
                for i in live[:pivot]:
                    places[i] = bisect_left(lists[i][0], item, places[i])
        else:
            to = max(ahead, item + 1)
            for i in live[: pivot + 1]:
                places[i] = bisect_left(lists[i][0], to, places[i])
        live = [i for i in live if places[i] < len(lists[i][0])]
    return found


def _split(words: int, breaks: list[int]) -> int:
    """Where the answer begins: after the last break inside the text, else at the last quarter."""
    inside = [b for b in breaks if 0 < b < words]
    return inside[-1] if inside else words - max(1, words // 4)


def item_parts(items: DataFrame) -> DataFrame:
    """Question and answer of items (item_id, text): the last sentence or line is the answer, else the last quarter of the words.

    Items that are null or have no word are left out, and so are those without an id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").lower() for t in batch.column(1).to_pylist()]
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), texts):
                sentences = [s for s in pc.split_pattern_regex(pa.scalar(text), r"[.!?]\s+|\n").as_py() if s.strip()]
                hashes, bounds = word_hashes(read_texts(pa.array(sentences, pa.string())))
                if item is None or not len(hashes):
                    continue
                at = _split(len(hashes), bounds[:-1].tolist())
                rows.append((item, len(text), hashes.view(np.int64).tolist(), at))
            names = ["item_id", "chars", "words", "answer_at"]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return items.select("item_id", "text").mapInArrow(cut, "item_id long, chars long, words array<long>, answer_at int")


def build_indexes(items: DataFrame, shard_chars: int = SHARD_CHARS) -> Iterator[Index]:
    """Indexes of all distinct items (item_id, text), in shards of bounded size with the statistics of the whole table.

    The document frequencies are counted over all items, so a score does not
    depend on how many shards there are.
    """
    parts = stored(item_parts(items).distinct())
    total = parts.agg(F.count(F.lit(1)), F.avg(F.size("words")), F.sum("chars"), F.max(F.size("words"))).first()  # one row
    if not total[0]:
        return
    shards = -(-total[2] // shard_chars)
    terms = parts.select("item_id", "words", "answer_at", F.explode(F.array_distinct("words")).alias("term"))
    frequency = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    own = terms.select("item_id", "words", "answer_at", "term").join(frequency, "term")
    rows = stored(own.groupBy("item_id", "words", "answer_at").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df")))
    half = max(HALF_PASSAGE, total[3])
    for shard in range(shards):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(shards)) == shard).orderBy("item_id", "words")
        yield _index(own.collect(), total[0], total[1], half)  # about ``shard_chars`` characters


def _index(rows: list, count: int, mean: float, half: int) -> Index:
    postings: dict[int, list[tuple[int, float]]] = {}
    question, answer, parts, whole, frequency = [], [], [], {}, {}
    for number, row in enumerate(rows):
        hashes = np.array(row.words, np.int64)
        kinds, times = np.unique(hashes, return_counts=True)
        idf = np.array([np.log(1 + (count - row.df[k] + 0.5) / (row.df[k] + 0.5)) for k in kinds.tolist()])
        impact = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * len(hashes) / mean))
        for k, share in zip(kinds.tolist(), (impact / impact.sum()).tolist()):
            postings.setdefault(k, []).append((number, share))
            frequency[k] = row.df[k]
        words = hashes.view(np.uint64)
        question.append(_grams(words[: row.answer_at]))
        answer.append(_grams(words[row.answer_at :]))
        parts.append((row.answer_at, len(words) - row.answer_at))
        if len(words) < LEAST_WORDS:
            whole[number] = words
    terms = np.sort(np.array(list(postings), np.int64).view(np.uint64))
    keys = terms.view(np.int64).tolist()
    flat = [p for k in keys for p in postings[k]]
    common = np.zeros(len(rows))
    rare = np.ones(len(keys), bool)
    for at in sorted(range(len(keys)), key=lambda i: (-frequency[keys[i]], keys[i])):
        numbers, shares = (np.array(x) for x in zip(*postings[keys[at]]))
        if (common[numbers] + shares <= _COMMON).all():
            common[numbers] += shares
            rare[at] = False
    begins = np.concatenate([[0], np.cumsum([len(postings[k]) for k in keys])])
    return Index(
        np.array([r.item_id for r in rows]), terms, begins, np.array([p[0] for p in flat]), np.array([p[1] for p in flat]),
        rare, common, question, answer, parts, whole, half,
    )


def _promising(index: Index, terms: np.ndarray, passage: np.ndarray, threshold: float) -> np.ndarray:
    """Passages that may reach the threshold, by their rare terms and all common ones of an item."""
    rare = np.flatnonzero(index.rare[terms])
    pairs = np.unique(passage[rare] * len(index.terms) + terms[rare])
    term, where = pairs % len(index.terms), pairs // len(index.terms)
    sizes = index.begins[term + 1] - index.begins[term]
    at = np.repeat(index.begins[term] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    key = np.repeat(where, sizes) * len(index.items) + index.posted[at]
    kinds, inverse = np.unique(key, return_inverse=True)
    bound = np.bincount(inverse, weights=index.impacts[at], minlength=len(kinds)) + index.common_share[kinds % len(index.items)]
    return np.unique(kinds[bound >= threshold - 1e-9] // len(index.items))


def _overlap(grams: np.ndarray, passage: np.ndarray, words: int) -> float:
    own = _grams(passage) if words >= NGRAM else np.unique(passage)
    return float(np.isin(grams, own, assume_unique=True).mean()) if len(grams) else 1.0


def leaks_of(texts: Texts, index: Index, threshold: float = THRESHOLD) -> dict[tuple[int, int], tuple[float, float, float]]:
    """Leaked items by text and item number, with score and overlaps of the best passage."""
    hashes, bounds = word_hashes(texts)
    half, sizes = index.half, np.diff(bounds)
    passages = np.maximum(-(-(sizes - half) // half), 1)
    bases = np.cumsum(passages) - passages
    found_terms = index.lookup(hashes)
    known = np.flatnonzero(found_terms >= 0)
    terms = found_terms[known]
    text = np.searchsorted(bounds, known, side="right") - 1
    slot = (known - bounds[text]) // half
    # a word lies in the passage that begins in its half, and in the one before
    later, earlier = slot < passages[text], slot > 0
    passage = np.concatenate([(bases[text] + slot)[later], (bases[text] + slot - 1)[earlier]])
    both = np.concatenate([terms[later], terms[earlier]])
    result: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p in _promising(index, both, passage, threshold).tolist() if len(both) else []:
        t = int(np.searchsorted(bases, p, side="right")) - 1
        start = bounds[t] + (p - bases[t]) * half
        words = hashes[start : min(start + 2 * half, bounds[t + 1])]
        own = index.lookup(words)
        for item, score in search(index, np.unique(own[own >= 0]), threshold):
            if item in index.whole and not _holds(words, index.whole[item]):
                continue
            q, a = index.parts[item]
            shares = _overlap(index.question[item], words, q), _overlap(index.answer[item], words, a)
            if shares[0] >= QUESTION and shares[1] >= ANSWER:
                result[t, item] = max(result.get((t, item), (0.0, 0.0, 0.0)), (score, *shares))
    return result


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Test items (item_id, text) that stand in documents (doc_id, text): doc_id, item_id, score and overlaps.

    One row per document row and item, of the passage with the best score
    (1 when it holds every word of the item). Items of fewer than ``LEAST_WORDS``
    words must stand in it word for word. Passages overlap by half and are
    twice as long as the longest item, so every item lies whole in one. Texts
    that are null or empty hold nothing; no items, no rows.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = documents.sparkSession.createDataFrame([], schema)
    for index in build_indexes(items):

        def ask(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, past, texts in blocks(_lowered(batch.column(1))):
                    leaks = leaks_of(texts, index)
                    at = sorted(leaks)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, past - first).take(pa.array([t for t, _ in at], pa.int64())).cast(pa.int64()),
                            pa.array([int(index.items[i]) for _, i in at], pa.int64()),
                            *[pa.array([leaks[k][n] for k in at], pa.float64()) for n in range(3)],
                        ],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

        found = found.unionByName(documents.select("doc_id", "text").mapInArrow(tidy(ask), schema))
    return found


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold none of the items; all columns and repeated rows stay."""
    for index in build_indexes(items):

        def drop(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column(batch.schema.get_field_index("text"))
                for first, past, texts in blocks(_lowered(text)):
                    leaked = {t for t, _ in leaks_of(texts, index)}
                    clean = pa.array([t not in leaked for t in range(past - first)], pa.bool_())
                    yield batch.slice(first, past - first).filter(clean)

        documents = documents.mapInArrow(tidy(drop), documents.schema)
    return documents
