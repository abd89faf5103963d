"""Tokens of two vocabularies over the same texts: groups, links, and how often ids are linked.

Each task numbers its documents in blocks. Per block and pair of linked ids it
keeps compressed bitmaps of document numbers: one of the documents that hold
the pair, and planes with the binary digits of how often more than once they
hold it. Counts of a pair are popcounts, summed over blocks. The postings then
take the score of their pair back to the documents of their block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.llm.units import PIECE_SPACE, Stretches, cut_between_words, give_back, per_text, with_space
from groundplan.llm.words import Texts, blocks, text_column
from groundplan.operators.sizes import broadcast_if_small
from groundplan.session import stored

FIRST_VOCABULARY = "byte_bpe_50k.json"
SECOND_VOCABULARY = "piece_bpe_32k.model"
# a block closes at so many documents (numbers of 16 bits) or bytes of text, a longer text aside
BLOCK_DOCUMENTS = 1 << 15
BLOCK_BYTES = 16_000_000
_SECOND_BITS = 20  # of a pair's code; ids of the second vocabulary lie below 2^20
_PLACE_BITS = 15
# stretches that are tokenized together
_TOGETHER = 8_000


# --- vocabularies -------------------------------------------------------


@cache
def _byte_of_character() -> dict[str, int]:
    """Bytes of the characters that byte-level vocabularies print them as: printable bytes as themselves, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def first_tokens(path: str):
    """The tokenizer of a byte-level vocabulary, and the bytes of each of its ids."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    own = _byte_of_character()
    table = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        table[i] = bytes(own[c] for c in token) if all(c in own for c in token) else token.encode()
    return tokenizer, table


def second_tokens(path: str):
    """The model of a piece vocabulary with byte fallback, and the bytes of each of its ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.encode().replace(PIECE_SPACE, b" ") for i, p in enumerate(pieces)]


def align(sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second token of every link between two runs of tokens over the same bytes, and whether a group ends with it.

    ``sizes`` are the bytes of the tokens of either side. The ends of both sides cut
    the bytes into stretches; each lies in one token of either side, and is one link.
    """
    ends = [np.cumsum(s) for s in sizes]
    cuts = np.union1d(*ends)
    first, second = (np.searchsorted(e, cuts) for e in ends)
    return first, second, (ends[0][first] == cuts) & (ends[1][second] == cuts)


class Aligner:
    """Alignments of distinct stretches, remembered within a task."""

    def __init__(self, first: str, second: str):
        self.first, self.first_bytes = first_tokens(first)
        self.second, self.second_bytes = second_tokens(second)
        self.bytes = self.first_bytes, self.second_bytes
        self.byte_sizes = [np.array([*map(len, table)], np.int64) for table in self.bytes]
        # an id as text, by what follows it: more of its side, the end of its side of the group
        self.shown = [str(i) + mark for marks, table in zip((",|", ",;"), self.bytes) for mark in marks for i in range(len(table))]
        self.shown_sizes = np.array([*map(len, self.shown)], np.int64)
        self.stretches = Stretches(self._learn, self._forget)
        self._forget()

    def _forget(self) -> None:
        # per stretch: texts of its groups, sizes (first, second, groups, links; -1 where the bytes differ), place of its links
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)
        self.begins = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)

    def _learn(self, strings: list[bytes]) -> int:
        return sum(self._learn_some(strings[at : at + _TOGETHER]) for at in range(0, len(strings), _TOGETHER))

    def _learn_some(self, strings: list[bytes]) -> int:
        texts = [s.decode() for s in strings]
        lists = [e.ids for e in self.first.encode_batch_fast(texts, add_special_tokens=False)], self.second.encode([t[1:] for t in texts], num_threads=1)
        lengths = np.array([*map(len, strings)], np.int64)
        counts = [np.array([*map(len, side)], np.int64) for side in lists]
        ids = [np.array([*chain.from_iterable(side)], np.int64) for side in lists]
        owner = [np.repeat(np.arange(len(strings)), n) for n in counts]
        sizes = [table[i] for table, i in zip(self.byte_sizes, ids)]
        good = np.logical_and(*[np.bincount(o, s, len(strings)) == lengths for o, s in zip(owner, sizes)])
        # of those with the right sizes, the ones with the right bytes
        raw = np.frombuffer(b"".join(compress(strings, good.tolist())), np.uint8)
        byte_of = np.repeat(np.flatnonzero(good), lengths[good])
        for table, i, o in zip(self.bytes, ids, owner):
            given = np.frombuffer(b"".join(map(table.__getitem__, i[good[o]].tolist())), np.uint8)
            good[byte_of[given != raw]] = False
            keep = good[byte_of]
            raw, byte_of = raw[keep], byte_of[keep]
        for side in range(2):
            keep = good[owner[side]]
            ids[side], owner[side], sizes[side] = ids[side][keep], owner[side][keep], sizes[side][keep]
        first, second, closes = align(sizes) if len(raw) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        stretch = owner[0][first]
        links = np.bincount(stretch, minlength=len(strings))
        groups = np.bincount(stretch[closes], minlength=len(strings))
        self._show(len(strings), ids, owner, first[closes], second[closes])
        totals = np.where(good[:, None], np.stack([counts[0], counts[1], groups, links], axis=1), -1)
        self.begins = np.concatenate([self.begins, len(self.links) + np.cumsum(links) - links])
        self.links = np.concatenate([self.links, (ids[0][first] << _SECOND_BITS) | ids[1][second]])
        self.sizes = np.concatenate([self.sizes, totals])
        return 8 * len(first) + sum(map(len, self.groups[-len(strings) :])) + 100 * len(strings)

    def _show(self, count: int, ids: list[np.ndarray], owner: list[np.ndarray], *lasts: np.ndarray) -> None:
        """Keep the groups of some stretches as text; ``lasts`` are the last tokens of the groups of either side."""
        codes, groups, base = [], [], 0
        for own, last, table in zip(ids, lasts, self.bytes):
            ends = np.zeros(len(own), np.int64)
            ends[last] = 1
            codes.append(base + ends * len(table) + own)
            groups.append(np.cumsum(ends) - ends)
            base += 2 * len(table)
        order = np.argsort(np.concatenate([2 * groups[0], 2 * groups[1] + 1]), kind="stable")
        codes, owners = np.concatenate(codes)[order], np.concatenate(owner)[order]
        text = "".join(map(self.shown.__getitem__, codes.tolist()))
        ends = np.cumsum(np.bincount(owners, self.shown_sizes[codes], count).astype(np.int64)).tolist()
        # the mark after the last group of a stretch is left out
        self.groups.extend(text[a : b - 1] if b > a else "" for a, b in zip([0, *ends], ends))

    def read(self, texts: Texts) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text its four sizes and its groups; then text number and link code of all links."""
        spaced = with_space(texts)
        units = cut_between_words(spaced)
        numbers = self.stretches.numbers(spaced, units)
        each = self.sizes[numbers]
        good = (per_text(units, each[:, 0] < 0) == 0) & (units.counts > 0)
        totals = np.stack([np.where(good, per_text(units, each[:, c]), 0) for c in range(4)], axis=1)
        firsts, own = units.firsts, numbers.tolist()
        groups = [";".join(map(self.groups.__getitem__, own[firsts[t] : firsts[t + 1]])) if good[t] else "" for t in range(len(texts))]
        text_of = units.text_of
        used = good[text_of] if len(text_of) else np.zeros(0, bool)
        numbers, text_of = numbers[used], text_of[used]
        counts = self.sizes[numbers, 3]
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return totals, groups, np.repeat(text_of, counts), self.links[np.repeat(self.begins[numbers], counts) + step]


# --- bitmaps ------------------------------------------------------------


def pack(owner: np.ndarray, place: np.ndarray, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` sets of places as bytes, and where each begins: 16-bit places, or ``width`` bytes of bits where that is no longer.

    ``owner`` is the sorted number of the set of each place.
    """
    members = np.bincount(owner, minlength=count)
    dense = 2 * members >= width
    offsets = np.concatenate([[0], np.cumsum(np.where(members == 0, 0, np.where(dense, width, 2 * members)))])
    out = np.zeros(offsets[-1], np.uint8)
    firsts = np.cumsum(members) - members
    in_bits = dense[owner]
    o, p = owner[~in_bits], place[~in_bits]
    at = offsets[o] + 2 * (np.flatnonzero(~in_bits) - firsts[o])
    out[at], out[at + 1] = p & 255, p >> 8
    o, p = owner[in_bits], place[in_bits]
    np.bitwise_or.at(out, offsets[o] + (p >> 3), (1 << (p & 7)).astype(np.uint8))
    return out, offsets


def popcounts(data: np.ndarray, offsets: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Members of each packed set; ``width`` is that of its block."""
    sizes = np.diff(offsets)
    bits = np.concatenate([[0], np.cumsum(np.bitwise_count(data), dtype=np.int64)])
    return np.where(sizes == width, bits[offsets[1:]] - bits[offsets[:-1]], sizes // 2)


def unpack(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the set and place of all members."""
    sizes = np.diff(offsets)
    dense = sizes == width
    inside = np.repeat(~dense, sizes)
    owners = [np.repeat(np.arange(len(sizes)), np.where(dense, 0, sizes // 2))]
    places = [data[inside].view("<u2").astype(np.int64)]
    some = np.flatnonzero(dense & (sizes > 0))
    step = max(1, 8_000_000 // max(1, 8 * width))
    for first in range(0, len(some), step):
        part = some[first : first + step]
        rows = data[offsets[part][:, None] + np.arange(width)]
        which, where = np.nonzero(np.unpackbits(rows, axis=1, bitorder="little"))
        owners.append(part[which])
        places.append(where)
    return np.concatenate(owners), np.concatenate(places)


_POSTING = "a int, b int, width int, planes array<binary>, n_docs long, n_pair_links long"
_POSTING_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.int64()]


def _planes(code: np.ndarray, place: np.ndarray, times: np.ndarray, documents: int) -> list[pa.Array]:
    """Postings of a block from (code, place, times), sorted by code and place, each once."""
    width = -(-documents // 8)
    heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    pair_of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(code))))
    more = times - 1
    most = np.maximum.reduceat(more, heads) if len(heads) else np.zeros(0, np.int64)
    deep = np.frexp(most.astype(np.float64))[1]  # binary digits
    first_of = np.concatenate([[0], np.cumsum(1 + deep)])
    owners, places = [first_of[pair_of]], [place]
    for digit in range(int(deep.max()) if len(deep) else 0):
        held = (more >> digit) & 1 == 1
        owners.append(first_of[pair_of[held]] + 1 + digit)
        places.append(place[held])
    owner, place = np.concatenate(owners), np.concatenate(places)
    order = np.argsort(owner, kind="stable")
    data, offsets = pack(owner[order], place[order], int(first_of[-1]), width)
    counts = popcounts(data, offsets, np.full(len(offsets) - 1, width))
    digit = np.arange(len(counts)) - np.repeat(first_of[:-1], np.diff(first_of))
    weighed = np.concatenate([[0], np.cumsum(counts << np.maximum(digit - 1, 0))])
    sets = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    pairs = code[heads]
    return [
        pa.array((pairs >> _SECOND_BITS).astype(np.int32)), pa.array((pairs & ((1 << _SECOND_BITS) - 1)).astype(np.int32)),
        pa.array(np.full(len(heads), width, np.int32)), pa.ListArray.from_arrays(pa.array(first_of.astype(np.int32)), sets),
        pa.array(counts[first_of[:-1]]), pa.array(weighed[first_of[1:]] - weighed[first_of[:-1]]),
    ]


class _Block:
    """Links of the documents of one block, merged as texts come in."""

    def __init__(self, number: int):
        self.number, self.documents, self.bytes = number, 0, 0
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, text_of: np.ndarray, links: np.ndarray, texts: int, size: int) -> np.ndarray:
        place = self.documents + text_of
        keys, times = np.unique((links << _PLACE_BITS) | place, return_counts=True)
        self.keys.append(keys)
        self.times.append(times)
        first = self.documents
        self.documents += texts
        self.bytes += size
        return np.arange(first, self.documents)

    @property
    def full(self) -> bool:
        return self.documents >= BLOCK_DOCUMENTS or self.bytes >= BLOCK_BYTES

    def postings(self) -> list[pa.Array]:
        keys = np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], np.concatenate(self.times)[order]
        return _planes(keys >> _PLACE_BITS, keys & ((1 << _PLACE_BITS) - 1), times.astype(np.int64), self.documents)


# --- the frames ---------------------------------------------------------


def read_alignments(documents: DataFrame, first: str | None = None, second: str | None = None, with_groups: bool = False) -> DataFrame:
    """Rows of documents and rows of postings, to be stored once and told apart by ``a``, null on documents.

    Documents have block, place, doc_id, n_a, n_b, n_groups, n_links and
    groups_sha256, with ``with_groups`` also the groups; postings have block, the
    pair a and b, the bytes of a plain bitmap of the block, the packed sets of its
    planes, and the popcounts.
    """
    paths = first or public_tokenizers.path(FIRST_VOCABULARY), second or public_tokenizers.path(SECOND_VOCABULARY)
    kind = documents.schema["doc_id"].dataType.simpleString()
    extra = ", groups string" if with_groups else ""
    schema = f"block long, place int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string{extra}, {_POSTING}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        aligner = Aligner(*paths)
        base = TaskContext.get().partitionId() << 32
        block = _Block(base)
        id_type = None

        def postings() -> pa.RecordBatch:
            found = block.postings()
            n = len(found[0])
            none = [pa.nulls(n, pa.int32()), pa.nulls(n, id_type), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.string())]
            none += [pa.nulls(n, pa.string())] if with_groups else []
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block.number)), *none, *found], names=names)

        names = [part.strip().split(" ")[0] for part in schema.replace("array<binary>", "planes").split(",")]
        for batch in batches:
            id_type = batch.schema.field(0).type
            for start, past, part in blocks(text_column(batch)):
                for at in range(start, past, BLOCK_DOCUMENTS):
                    to = min(past, at + BLOCK_DOCUMENTS)
                    if block.documents + to - at > BLOCK_DOCUMENTS or block.full:
                        yield postings()
                        block = _Block(block.number + 1)
                    cut = part.offsets[at - start : to - start + 1]
                    texts = Texts(part.data[cut[0] : cut[-1]], cut - cut[0])
                    sizes, groups, text_of, links = aligner.read(texts)
                    places = block.add(text_of, links, len(texts), len(texts.data))
                    n = len(texts)
                    columns = [pa.array(np.full(n, block.number)), pa.array(places.astype(np.int32)), batch.column(0).slice(at, n)]
                    columns += [pa.array(sizes[:, c]) for c in range(4)]
                    columns.append(pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]))
                    columns += [pa.array(groups)] if with_groups else []
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n, t) for t in _POSTING_TYPES]], names=names)
                    give_back()
        if block.documents:
            yield postings()

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(alignments: DataFrame) -> DataFrame:
    """Documents and links of each pair of ids (a, b, n_docs, n_links, is_best), ``is_best`` where no pair of b has more links."""
    rows = alignments.filter(F.col("a").isNotNull())
    counts = stored(rows.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_pair_links").alias("n_links")))
    # one row for each id of the second vocabulary at most
    most = counts.groupBy("b").agg(F.max("n_links").alias("_most"))
    return counts.join(F.broadcast(most), "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("_most")).alias("is_best"))


def _return_scores(postings: pa.Table) -> pa.Table:
    """Sums of the scores of one block's postings by document place."""
    block, width = postings.column("block")[0].as_py(), postings.column("width")[0].as_py()
    lists = postings.column("planes").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sets = lists.flatten().cast(pa.large_binary())
    _, offsets, data = sets.buffers()
    offsets = np.frombuffer(offsets, np.int64)[sets.offset : sets.offset + len(sets) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    deep = np.diff(lists.offsets.to_numpy())
    pair_of = np.repeat(np.arange(len(deep)), deep)
    digit = np.arange(len(pair_of)) - np.repeat(np.cumsum(deep) - deep, deep)
    weight = np.left_shift(np.int64(1), np.maximum(digit - 1, 0))
    score = postings.column("score").to_numpy()[pair_of] * weight
    best = postings.column("is_best").to_numpy(zero_copy_only=False)[pair_of] * weight
    owner, place = unpack(data, offsets, width)
    sums, bests = np.zeros(8 * width, np.int64), np.zeros(8 * width, np.int64)
    np.add.at(sums, place, score[owner])
    np.add.at(bests, place, best[owner])
    places = np.flatnonzero(sums)
    return pa.table(
        {"block": np.full(len(places), block), "place": places.astype(np.int32), "n_best": bests[places], "count_sum": sums[places]}
    )


def align_documents(documents: DataFrame, first: str | None = None, second: str | None = None, with_groups: bool = False) -> DataFrame:
    """Sizes, groups and link scores of every document (doc_id, text).

    Null and empty texts, and texts that either vocabulary does not give back byte
    for byte, have no tokens: zeros and empty groups. Equal rows count each for
    itself, null ids stay null, other columns are not read, and an empty table gives
    an empty result. ``count_sum`` adds up, over the links of a document, how many
    links of all documents join the same two ids; ``n_best`` counts its links whose
    pair no pair of the same second id surpasses.
    """
    alignments = stored(read_alignments(documents, first, second, with_groups))
    scores = pair_counts(alignments).select("a", "b", F.col("n_links").alias("score"), "is_best")
    postings = alignments.filter(F.col("a").isNotNull()).select("block", "a", "b", "width", "planes")
    scored = postings.join(broadcast_if_small(scores), ["a", "b"]).select("block", "width", "planes", "score", "is_best")
    sums = scored.groupBy("block").applyInArrow(_return_scores, "block long, place int, n_best long, count_sum long")
    rows = alignments.filter(F.col("a").isNull()).join(sums, ["block", "place"], "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    groups = ["groups"] if with_groups else []
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *groups)
