"""Keyword search over an inverted index that lies in parts.

A part holds postings in blocks with the largest term frequency of each. The
terms of a query are added from the one with the largest possible share on; once
the rest cannot lift a new chunk among the best, only chunks seen so far are
looked up, and those whose block cannot lift them are dropped before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundplan.functions import text as X
from groundplan.functions.words import let
from groundplan.operators.parts import best_of_parts, meet, part_count, part_of

# bytes of chunk texts in a part, and below which a small table is not cut further
PART_BYTES = 8 * 1024 * 1024
_LEAST_PART_BYTES = 1024 * 1024
# postings under one bound
BLOCK = 64


def counted_tokens(text: Column) -> Column:
    """The distinct tokens of a text with their counts, from one sorted list."""

    def count(tokens: Column) -> Column:
        last = F.size(tokens)
        places = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
        heads = F.filter(places, lambda i: (i <= last) & ((i == 1) | (F.get(tokens, i - 1) != F.get(tokens, i - 2))))
        return let(heads, lambda at: F.transform(at, lambda i, n: F.struct(F.get(tokens, i - 1).alias("token"), (F.coalesce(F.get(at, n + 1), last + 1) - i).alias("tf"))))

    return let(F.array_sort(F.coalesce(X.tokens(text), F.array().cast("array<string>"))), count)


def postings(chunks: DataFrame) -> DataFrame:
    """Term frequency per token and chunk (chunk_id, text); ids are unique, so a row counts its own tokens and nothing is shuffled."""
    return chunks.select("chunk_id", F.explode(counted_tokens(F.col("text"))).alias("_t")).select(
        F.col("_t.token").alias("token"), "chunk_id", F.col("_t.tf").cast("long").alias("tf")
    )


class _Index:
    """Postings of one part, by token and then by place of the chunk in the order of ids."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("chunk_id").combine_chunks()
        _, first, place = np.unique(ids.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        self.ids, self.size = ids.take(pa.array(first)), len(first)
        lists = rows.column("tokens").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        words = lists.flatten().dictionary_encode()
        self.number = {token: i for i, token in enumerate(words.dictionary.to_pylist())}
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        times = rows.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        key = code * self.size + np.repeat(place, lengths)
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.tf = np.add.reduceat(times[order], heads) if len(heads) else times
        self.place, code = key[heads] % max(1, self.size), key[heads] // max(1, self.size)
        self.first = np.searchsorted(code, np.arange(len(self.number) + 1))
        counts = np.diff(self.first)
        blocks = -(-counts // BLOCK)
        self.first_block = np.concatenate([[0], np.cumsum(blocks)])
        starts = np.repeat(self.first[:-1] - BLOCK * self.first_block[:-1], blocks) + BLOCK * np.arange(blocks.sum())
        self.block_most = np.maximum.reduceat(self.tf, starts) if len(starts) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(self.block_most, self.first_block[:-1]) if len(starts) else np.zeros(0, np.int64)
        self.sums = np.zeros(self.size, np.int64)

    def terms(self, tokens: list[str], times: list[int]) -> list[tuple[int, int, int]]:
        """Largest share, number and weight of the query's tokens that the part holds, largest first."""
        known = [(self.number[t], n) for t, n in zip(tokens, times) if t in self.number]
        return sorted(((int(self.most[i]) * n, i, n) for i, n in known), reverse=True)

    def best(self, tokens: list[str], times: list[int], count: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hits of the ``count`` chunks with most hits; equal ones by smaller id."""
        terms, sums = self.terms(tokens, times), self.sums
        rest = np.cumsum([0, *[t[0] for t in reversed(terms)]])[::-1].tolist()  # what the terms from here on can add
        seen, least, at = [], 0, 0
        while at < len(terms) and (least == 0 or rest[at] >= least):
            _, term, weight = terms[at]
            rows = slice(self.first[term], self.first[term + 1])
            sums[self.place[rows]] += self.tf[rows] * weight
            seen.append(self.place[rows])
            at += 1
            found = np.unique(np.concatenate(seen)) if len(seen) > 1 else seen[0]
            seen = [found]
            if len(found) >= count and at < len(terms):
                least = int(np.partition(sums[found], len(found) - count)[len(found) - count])
        found = seen[0] if seen else np.zeros(0, np.int64)
        touched = found
        for _, term, weight in terms[at:]:
            found = found[sums[found] + rest[at] >= least]
            first, past = self.first[term], self.first[term + 1]
            place = self.place[first:past]
            near = np.searchsorted(place, found)
            block = self.first_block[term] + np.minimum(near, len(place) - 1) // BLOCK
            at += 1
            open_ = sums[found] + self.block_most[block] * weight + rest[at] >= least
            found, near = found[open_], near[open_]
            held = near < len(place)
            held[held] = place[near[held]] == found[held]
            sums[found[held]] += self.tf[first + near[held]] * weight
            if len(found) >= count:
                least = max(least, int(np.partition(sums[found], len(found) - count)[len(found) - count]))
        hits = sums[found]
        top = np.lexsort((found, -hits))[:count]
        found, hits = found[top], hits[top]
        sums[touched] = 0
        return found, hits

    def above(self, tokens: list[str], times: list[int], hits: int) -> int:
        """Number of chunks with more than ``hits`` hits."""
        sums = np.zeros(self.size, np.int64)
        for _, term, weight in self.terms(tokens, times):
            rows = slice(self.first[term], self.first[term + 1])
            sums[self.place[rows]] += self.tf[rows] * weight
        return int((sums > hits).sum())


def _best_of(count: int):
    def search(index: _Index, part: int, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        queries = asked.column("query_id").combine_chunks()
        found = [index.best(t, n, count) for t, n in zip(asked.column("asked").to_pylist(), asked.column("times").to_pylist())]
        lengths = [len(p) for p, _ in found]
        if sum(lengths):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(sum(lengths), part, np.int32)), queries.take(pa.array(np.repeat(np.arange(len(found)), lengths))),
                    index.ids.take(pa.array(np.concatenate([p for p, _ in found]))), pa.array(np.concatenate([h for _, h in found])),
                ],
                names=["part", "query_id", "chunk_id", "hits"],
            )

    return search


def _above(index: _Index, part: int, asked: pa.Table) -> Iterator[pa.RecordBatch]:
    columns = [asked.column(c).to_pylist() for c in ("asked", "times", "least")]
    counts = [index.above(*row) for row in zip(*columns)]
    yield pa.RecordBatch.from_arrays([asked.column("query_id").combine_chunks(), pa.array(columns[2], pa.int64()), pa.array(counts, pa.int64())], names=["query_id", "least", "n"])


def asked_tokens(queries: DataFrame) -> DataFrame:
    """Each query (query_id, text) with its distinct tokens and how often it repeats them; queries without one are left out."""
    rows = queries.select("query_id", counted_tokens(F.col("text")).alias("_t")).filter(F.size("_t") > 0)
    return rows.select("query_id", F.col("_t.token").alias("asked"), F.col("_t.tf").alias("times"))


def index_rows(chunks: DataFrame) -> tuple[DataFrame, int]:
    """The chunks (chunk_id, text) as rows of an index, and the number of its parts."""
    size = chunks.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = part_count(chunks, size, PART_BYTES, _LEAST_PART_BYTES)
    rows = chunks.select(part_of(F.col("chunk_id"), parts), "chunk_id", counted_tokens(F.col("text")).alias("_t")).filter(F.size("_t") > 0)
    return rows.select("part", "chunk_id", F.col("_t.token").alias("tokens"), F.col("_t.tf").alias("counts")), parts


def keyword_topk(queries: DataFrame, chunks: DataFrame, *, k: int = 20) -> DataFrame:
    """The ``k`` chunks with most hits of each query (query_id, text), with rank and keyword_score.

    Hits add up, over the query's tokens, how often the chunk holds them. Equal
    hits are ordered by chunk id; the score is the share of the query's most hits.
    Queries without a hit have no row.
    """
    held, parts = index_rows(chunks)
    kind = lambda df, name: df.schema[name].dataType.simpleString()
    schema = f"part int, query_id {kind(queries, 'query_id')}, chunk_id {kind(chunks, 'chunk_id')}, hits long"
    found = meet(held, asked_tokens(queries), parts, _Index, _best_of(k), schema)
    best = best_of_parts(found, ["query_id"], [F.desc("hits"), F.col("chunk_id")], k, parts)
    from pyspark.sql import Window

    most = F.max("hits").over(Window.partitionBy("query_id"))
    return best.withColumn("keyword_score", F.col("hits") / most)


def chunks_above(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many chunks have more hits than ``least`` (query_id, text, least): query_id, least, n."""
    held, parts = index_rows(chunks)
    rows = asked.select("query_id", "least", counted_tokens(F.col("text")).alias("_t"))
    rows = rows.select("query_id", F.col("least").cast("long").alias("least"), F.col("_t.token").alias("asked"), F.col("_t.tf").alias("times"))
    kind = asked.schema["query_id"].dataType.simpleString()
    counted = meet(held, rows, parts, _Index, _above, f"query_id {kind}, least long, n long")
    return counted.groupBy("query_id", "least").agg(F.sum("n").alias("n"))


def pair_hits(pairs: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits of given pairs (query_id, chunk_id), read from the two texts of each pair."""
    texts = chunks.select("chunk_id", F.col("text").alias("_chunk"))
    asked = queries.select("query_id", F.col("text").alias("_query"))
    rows = pairs.select("query_id", "chunk_id").distinct().join(texts, "chunk_id").join(asked, "query_id")

    def hits(wanted: Column, held: Column) -> Column:
        counts = F.map_from_entries(wanted)
        return F.aggregate(held, F.lit(0).cast("long"), lambda s, t: s + F.coalesce(F.element_at(counts, t["token"]), F.lit(0)) * t["tf"])

    shared = lambda wanted: let(F.filter(counted_tokens(F.col("_chunk")), lambda t: F.array_contains(F.transform(wanted, lambda w: w["token"]), t["token"])), lambda held: hits(wanted, held))
    return rows.select("query_id", "chunk_id", let(counted_tokens(F.col("_query")), shared).alias("hits")).filter(F.col("hits") > 0)
