"""Exact vector search and embedding jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.operators import cache
from groundplan.operators.parts import best_of_parts, meet, part_count, part_of, pass_by
from groundplan.session import stored

# query vectors scored at a time, and bytes of chunk vectors held by a task
BLOCK_QUERIES = 8_192
PART_BYTES = 32 * 1024 * 1024
# a small table of chunks is still cut into parts of about this size, up to the cores there are
_LEAST_PART_BYTES = 2 * 1024 * 1024
# so many queries and more are dealt to slices instead, of at most so many bytes of vectors
_MANY_QUERIES = 4_096
_SLICE_BYTES = 128 * 1024 * 1024
# clauses in one row of a query's limits
_CLAUSES_PER_ROW = 1024
# scores computed at a time in a task
_SCORES = 4_000_000
# scores are ranked at this precision, so that equal vectors tie
SCORE_DIGITS = 12
# more than rounding to it can change
_SLACK = 1e-11
# rows of a part are padded to a multiple of this
_LANES = 64
# bytes that queries held by a task take with their results, and queries and chunks that are screened at a time
_HELD_BYTES = 64 * 1024 * 1024
_SCREEN_QUERIES = 512
_SCREEN_CHUNKS = 1_024
# chunks of which the largest score is looked at first; _SCREEN_CHUNKS is a multiple of it
_LANE = 32
# pairs whose exact scores are computed at a time
_PAIRS = 16_384
# rows in a batch put out, and ids kept that no result needs
_ROWS_OUT = 65_536
_SPARE_IDS = 1_000_000


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(array.flatten(), dtype=np.float64).reshape(-1, size)


def _best(scores: np.ndarray, threshold: float, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded score of the ``count`` best columns of each row; equal scores by smaller column.

    The ``count`` best of the maxima of some groups of columns bound the best
    columns from below, so only those that reach the bound are rounded and sorted.
    """
    lanes = scores.reshape(len(scores), _LANES, -1).max(axis=1) if scores.shape[1] % _LANES == 0 and scores.shape[1] >= _LANES * count else scores
    least = np.full(len(scores), threshold)
    if lanes.shape[1] >= count:
        least = np.maximum(least, np.partition(lanes, lanes.shape[1] - count, axis=1)[:, lanes.shape[1] - count])
    row, column = np.nonzero(scores >= (least - _SLACK)[:, None])
    score = np.round(scores[row, column], SCORE_DIGITS)
    good = score >= threshold
    row, column, score = row[good], column[good], score[good]
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    top = np.arange(len(row)) - first[row] < count
    return row[top], column[top], score[top]


def _parents(clause: str) -> list[str]:
    parts = clause.split(".")
    return [".".join(parts[: i + 1]) for i in range(len(parts))]


class _Part:
    """The chunks of one part and vector length: unit vectors, sorted by id, with ``grouped`` by collection before that."""

    def __init__(self, rows: pa.Table, size: int, limited: bool, grouped: bool):
        groups = rows.column("target_index").to_numpy(zero_copy_only=False).astype(object)
        ids = rows.column("chunk_id").to_numpy(zero_copy_only=False)
        by_id = np.unique(ids, return_inverse=True)[1]
        # with a limit for each collection these lie one after the other, else the ids alone are the order
        order = np.lexsort((by_id, np.unique(groups, return_inverse=True)[1])) if grouped else np.argsort(by_id, kind="stable")
        rows = rows.take(pa.array(order))
        self.ids = rows.column("chunk_id").combine_chunks()
        self.group = rows.column("target_index").combine_chunks()
        vectors = _unit(_matrix(rows.column("chunk_vector"), size))
        self.size = len(vectors)
        self.vectors = np.zeros((-(-self.size // _LANES) * _LANES, size))
        self.vectors[: self.size] = vectors
        self.void = np.flatnonzero(~np.isfinite(self.vectors).all(axis=1))
        self.vectors[self.void] = 0.0
        groups = groups[order]
        heads = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if grouped else np.zeros(1, np.int64)
        self.groups = [(int(a), int(b)) for a, b in zip(heads, np.append(heads[1:], len(groups)))]
        self.below: dict[str, np.ndarray] = {}
        if limited:
            places: dict[str, list[int]] = {}
            for i, clause in enumerate(rows.column("clause_id").to_pylist()):
                for parent in _parents(clause or ""):
                    places.setdefault(parent, []).append(i)
            self.below = {clause: np.array(rows) for clause, rows in places.items()}

    def allowed(self, clauses: list[list[str]]) -> np.ndarray:
        """Queries x rows: whether the row's clause lies at or below one of the query's."""
        mask = np.zeros((len(clauses), len(self.vectors)), dtype=bool)
        for q, own in enumerate(clauses):
            for clause in own or []:
                if clause in self.below:
                    mask[q, self.below[clause]] = True
        return mask

    def hits(self, queries: np.ndarray, clauses: list[list[str]] | None, threshold: float, count: int):
        """Queries, rows and scores of the ``count`` best rows of each query, and of each collection if grouped, some queries at a time."""
        step = max(1, min(BLOCK_QUERIES, _SCORES // max(1, len(self.vectors))))
        for at in range(0, len(queries), step):
            scores = queries[at : at + step] @ self.vectors.T
            scores[:, self.size :] = -np.inf
            scores[:, self.void] = -np.inf
            if clauses is not None:
                scores[~self.allowed(clauses[at : at + step])] = -np.inf
            for first, past in self.groups:
                part = scores if len(self.groups) == 1 else scores[:, first:past]
                query, row, score = _best(part, threshold, count)
                yield at + query, first + row, score


def _read_part(limited: bool, grouped: bool):
    def read(table: pa.Table) -> dict[int, _Part]:
        sizes = pc.list_value_length(table.column("chunk_vector")).to_numpy()
        return {int(n): _Part(table.filter(pa.array(sizes == n)), int(n), limited, grouped) for n in np.unique(sizes)}

    return read


def _search_part(threshold: float, count: int, limited: bool):
    def search(held: dict[int, _Part], part: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = pc.list_value_length(rows.column("query_vector")).to_numpy()
        for n in np.unique(sizes).tolist():
            if n not in held:
                continue
            asked, chunks = rows.filter(pa.array(sizes == n)), held[n]
            ids = asked.column("query_id").combine_chunks()
            clauses = asked.column("clauses").to_pylist() if limited else None
            for found, at, scores in chunks.hits(_unit(_matrix(asked.column("query_vector"), n)), clauses, threshold, count):
                if len(found):
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), part, np.int32)), ids.take(pa.array(found)), chunks.ids.take(at), chunks.group.take(at), pa.array(scores)],
                        names=["part", "query_id", "chunk_id", "target_index", "score"],
                    )

    return search


class _Asked:
    """Queries of one vector length with their ``count`` best chunks so far; chunks come in the order of their ids.

    Scores are screened in single precision against the last of the best, less what
    rounding can change, and computed in double precision for the few pairs that pass.
    Those wait until twice the chunks have come by before they join the best.
    """

    def __init__(self, rows: pa.Table, size: int, threshold: float, count: int):
        self.ids = rows.column("query_id").combine_chunks()
        self.vectors = _unit(_matrix(rows.column("query_vector"), size))
        self.threshold, self.count = threshold, count
        self.slack = (size + 8) * 2.0**-23 + _SLACK
        self.heads = range(0, len(self.vectors), _SCREEN_QUERIES)
        self.screens = [np.ascontiguousarray(self.vectors[a : a + _SCREEN_QUERIES].T, dtype=np.float32) for a in self.heads]
        self.score = np.full((len(self.vectors), count), -np.inf)
        self.place = np.zeros((len(self.vectors), count), np.int64)
        self.least = np.full(len(self.vectors), threshold - self.slack, np.float32)
        self.waiting: list[list[tuple[np.ndarray, ...]]] = [[] for _ in self.heads]
        self.due = [0] * len(self.screens)
        self.most_waiting = max(_PAIRS, 2 * count * _SCREEN_QUERIES)
        self.space = np.empty(_SCREEN_QUERIES * _SCREEN_CHUNKS, np.float32)
        self.seen, self.kept, self.names = 0, 0, []

    def meet(self, names: pa.Table, chunks: np.ndarray) -> None:
        """Let chunks pass by: their chunk_id and target_index, and their unit vectors."""
        screens = np.zeros((-(-len(chunks) // _LANE) * _LANE, chunks.shape[1]), np.float32)
        screens[: len(chunks)] = chunks
        for block in range(len(self.screens)):
            for at in range(0, len(chunks), _SCREEN_CHUNKS):
                self._screen(block, screens[at : at + _SCREEN_CHUNKS], chunks[at : at + _SCREEN_CHUNKS], self.kept + at)
                if self.seen + min(at + _SCREEN_CHUNKS, len(chunks)) >= self.due[block] or sum(len(w[0]) for w in self.waiting[block]) > self.most_waiting:
                    self._join(block)
                    self.due[block] = 2 * (self.seen + at + _SCREEN_CHUNKS)
        self.names.append(names)
        self.seen, self.kept = self.seen + len(chunks), self.kept + len(chunks)
        if self.kept > 2 * self.score.size + _SPARE_IDS:
            self._forget()

    def _screen(self, block: int, screens: np.ndarray, chunks: np.ndarray, first: int) -> None:
        """Pairs of a block of queries and some chunks that can be among the best."""
        head, asked = self.heads[block], self.screens[block]
        scores = np.matmul(screens, asked, out=self.space[: screens.shape[0] * asked.shape[1]].reshape(len(screens), -1))
        scores[len(chunks) :] = -np.inf
        lanes = scores.reshape(-1, _LANE, asked.shape[1])
        most, least = lanes.max(axis=1), self.least[head : head + asked.shape[1]]
        lane, query = np.nonzero(most >= least)
        if len(lane) > 2 * self.count * asked.shape[1] and len(most) >= self.count:
            # as many chunks have the score of their lane, so that none below these can be among the best
            bound = np.partition(most, len(most) - self.count, axis=0)[len(most) - self.count]
            least = np.maximum(least, bound - np.float32(2 * self.slack))
            lane, query = np.nonzero(most >= least)
        pair, step = np.nonzero(lanes[lane, :, query] >= least[query][:, None])
        row, query = lane[pair] * _LANE + step, query[pair]
        for at in range(0, len(row), _PAIRS):
            r, q = row[at : at + _PAIRS], query[at : at + _PAIRS]
            score = np.round(np.einsum("ij,ij->i", chunks[r], self.vectors[head + q]), SCORE_DIGITS)
            # of equal scores the earlier chunk has the smaller id
            good = (score >= self.threshold) & (score > self.score[head + q, -1])
            self.waiting[block].append((q[good], first + r[good], score[good]))

    def _join(self, block: int) -> None:
        """Put waiting pairs among the best of their queries."""
        waiting, self.waiting[block] = self.waiting[block], []
        query, place, score = (np.concatenate(c) for c in zip(*waiting)) if waiting else (np.zeros(0, np.int64),) * 3
        if not len(query):
            return
        order = np.argsort(query, kind="stable")
        query, place, score = query[order], place[order], score[order]
        own, first, counts = np.unique(query, return_index=True, return_counts=True)
        line, column = np.repeat(np.arange(len(own)), counts), self.count + np.arange(len(query)) - np.repeat(first, counts)
        shape, at = (len(own), self.count + counts.max()), self.heads[block] + own
        scores, places = np.full(shape, -np.inf), np.zeros(shape, np.int64)
        scores[:, : self.count], places[:, : self.count] = self.score[at], self.place[at]
        scores[line, column], places[line, column] = score, place
        best = np.argsort(-scores, axis=1, kind="stable")[:, : self.count]
        self.score[at], self.place[at] = np.take_along_axis(scores, best, axis=1), np.take_along_axis(places, best, axis=1)
        self.least[at] = np.maximum(self.threshold, self.score[at, -1]) - self.slack

    def _settle(self) -> None:
        for block in range(len(self.screens)):
            self._join(block)

    def _forget(self) -> None:
        """Keep the ids of the best only, numbered anew in the same order."""
        self._settle()
        found = self.score > -np.inf
        used, place = np.unique(self.place[found], return_inverse=True)
        self.place[found] = place
        self.names, self.kept = [pa.concat_tables(self.names).take(pa.array(used))], len(used)

    def found(self, part: int) -> Iterator[pa.RecordBatch]:
        self._settle()
        if not self.names:
            return
        names = pa.concat_tables(self.names).combine_chunks()
        query, rank = np.nonzero(self.score > -np.inf)
        for at in range(0, len(query), _ROWS_OUT):
            q, r = query[at : at + _ROWS_OUT], rank[at : at + _ROWS_OUT]
            chunks = names.take(pa.array(self.place[q, r])).combine_chunks()
            columns = [chunks.column(c).chunk(0) for c in ("chunk_id", "target_index")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), part, np.int32)), self.ids.take(pa.array(q)), *columns, pa.array(self.score[q, r])],
                names=["part", "query_id", "chunk_id", "target_index", "score"],
            )


def _distinct(rows: pa.Table, size: int) -> pa.Table:
    """Rows of equal query_id and query_vector once each."""
    ids = rows.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    often = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(often):
        return rows
    again = np.column_stack([ids[often], _matrix(rows.column("query_vector").take(pa.array(often)), size)])
    kept = np.ones(len(ids), bool)
    kept[often] = False
    kept[often[np.unique(again, axis=0, return_index=True)[1]]] = True
    return rows.filter(pa.array(kept))


def _of_length(rows: pa.Table, sizes: np.ndarray, n: int) -> pa.Table:
    return rows if (sizes == n).all() else rows.filter(pa.array(sizes == n))


class _Slice:
    """The queries of one slice, by vector length."""

    def __init__(self, rows: pa.Table, threshold: float, count: int):
        self.part = rows.column("part")[0].as_py()
        sizes = pc.list_value_length(rows.column("query_vector")).to_numpy()
        self.asked = {n: _Asked(_distinct(_of_length(rows, sizes, n), n), n, threshold, count) for n in np.unique(sizes).tolist()}

    def meet(self, rows: pa.Table) -> None:
        sizes = pc.list_value_length(rows.column("chunk_vector")).to_numpy()
        for n in np.unique(sizes).tolist():
            if n in self.asked:
                own = _of_length(rows, sizes, n)
                vectors = _unit(_matrix(own.column("chunk_vector"), n))
                whole = np.isfinite(vectors).all(axis=1)
                if whole.any():
                    self.asked[n].meet(own.select(["chunk_id", "target_index"]).filter(pa.array(whole)), vectors[whole])

    def found(self) -> Iterator[pa.RecordBatch]:
        for asked in self.asked.values():
            yield from asked.found(self.part)


def _hold(threshold: float, count: int):
    return lambda rows: _Slice(rows, threshold, count)


def _limited(rows: DataFrame, within: DataFrame) -> DataFrame:
    """Each query with its clauses, in rows of a bounded number of them; queries without one are left out."""
    pairs = within.select("query_id", "clause").filter(F.col("clause").isNotNull()).distinct()
    counts = pairs.groupBy("query_id").agg(F.ceil(F.count(F.lit(1)) / _CLAUSES_PER_ROW).alias("_lists"))
    dealt = pairs.join(counts, "query_id").withColumn("_list", F.pmod(F.xxhash64("clause"), "_lists"))
    lists = dealt.groupBy("query_id", "_list").agg(F.collect_list("clause").alias("clauses")).drop("_list")
    return rows.join(lists, "query_id")


def _dealt(queries: DataFrame, chunks: DataFrame, count: int | None = None) -> tuple[int, int]:
    """Numbers of parts and of slices of the queries, from counts of both and the length of one vector.

    With ``count``, the results that each query keeps, slices are held and the parts pass by.
    """
    one = chunks.select(F.size("embedding").alias("n")).filter("n > 0").head()
    if one is None:
        return 1, 1
    size, asked = chunks.count() * 8 * one.n, queries.count()
    if asked < _MANY_QUERIES:
        return part_count(chunks, size, PART_BYTES, _LEAST_PART_BYTES), 1
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    few = asked // (_MANY_QUERIES // 4)
    if count is not None:
        # all slices take as long, so that a round of tasks fills the cores
        least = -(-asked * (8 * one.n + 16 * count) // _HELD_BYTES)
        slices = max(2, least, min(-(-least // cores) * cores, few))
        return max(1, min(-(-cores // slices), size // _LEAST_PART_BYTES)), slices
    parts = part_count(chunks, size, PART_BYTES, PART_BYTES)
    return parts, max(-(-asked * 8 * one.n // _SLICE_BYTES), min(-(-3 * cores // parts), few))


def vector_topk(
    queries: DataFrame,
    chunks: DataFrame,
    *,
    k: int = 10,
    threshold: float = V.SCORE_THRESHOLD,
    per_collection: int | None = None,
    within: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` chunks with the largest cosine for each query.

    ``queries`` has query_id and embedding; ``chunks`` has chunk_id, embedding
    and, when there are several collections, target_index. The chunk vectors are
    dealt to parts of bounded size by one shuffle, and every part meets all query
    rows, in slices where they are many: a task holds its part and scores the
    queries, which stream past, by matrix products. It keeps ``k`` rows per query,
    or ``per_collection`` of each collection, which are merged in two steps where
    there are many parts. Without such limits many queries are dealt to slices
    instead: a task holds one, and the chunks stream past in the order of their ids.
    Chunk texts stay out of the search. ``within`` (query_id, clause) limits a
    query to chunks at or below its clauses. Vectors are compared with those of their own length only; equal
    rows of queries count once, null and empty vectors not at all.
    """
    count, grouped = per_collection or k, per_collection is not None
    group = F.col("target_index") if "target_index" in chunks.columns else F.lit("main")
    clause = F.coalesce("clause_id", F.lit("")) if within is not None else F.lit(None).cast("string")
    rows = queries.select("query_id", F.col("embedding").cast("array<double>").alias("query_vector")).filter(F.size("query_vector") > 0)
    plain = within is None and not grouped
    parts, slices = _dealt(queries, chunks, k if plain else None)
    held = chunks.filter(F.size("embedding") > 0).select(
        part_of(F.col("chunk_id"), parts), "chunk_id", F.coalesce(group, F.lit("main")).alias("target_index"),
        clause.alias("clause_id"), F.col("embedding").alias("chunk_vector"),
    )
    kind = lambda df, name: df.schema[name].dataType.simpleString()
    schema = f"part int, query_id {kind(queries, 'query_id')}, chunk_id {kind(chunks, 'chunk_id')}, target_index string, score double"
    best = [F.desc("score"), F.col("chunk_id")]
    if plain and slices > 1:
        found = pass_by(rows, held.drop("part", "clause_id"), "chunk_id", parts, slices, _hold(threshold, k), schema)
        return best_of_parts(found, ["query_id"], best, k, parts)
    limited = within is not None
    rows = _limited(rows.distinct(), within) if limited else rows.distinct().withColumn("clauses", F.lit(None).cast("array<string>"))
    found = meet(held, rows, parts, _read_part(limited, grouped), _search_part(threshold, count, limited), schema, slices=slices)
    if limited:  # a query with many clauses stands in several rows
        found = found.dropDuplicates(["part", "query_id", "target_index", "chunk_id", "score"])
    if not grouped:
        return best_of_parts(found, ["query_id"], best, k, parts)
    candidates = best_of_parts(found, ["query_id", "target_index"], best, count, parts).drop("rank")
    in_query = Window.partitionBy("query_id").orderBy(*best)
    return candidates.withColumn("rank", F.row_number().over(in_query)).filter(F.col("rank") <= k)


def class_centres(vectors: DataFrame, by: str) -> DataFrame:
    """Mean vector of each class, summed inside the JVM without exploding."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return vectors.groupBy(by).agg(vector_to_array(mean).alias("embedding"))


def normalised(vector: Column) -> Column:
    """``vector`` at unit length."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.arrays_zip(vector.alias("x"), F.array_repeat(norm, F.size(vector)).alias("n")), lambda p: p["x"] / p["n"])


# --- embedding job ------------------------------------------------------


def _spaces() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*b" \t\n\x0b\x0c\r"]] = True
    return table


_SPACE = _spaces()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hash_encoder(size: int = 64) -> Callable[[pa.Array], np.ndarray]:
    """A feature-hash encoder: counts of words by hash, at unit length, one row per text.

    Words are runs of bytes other than ASCII white space, lower-cased from A to Z.
    The hash adds up the bytes of a word, weighted by 31 times their place plus 7.
    All texts of a batch are read from their Arrow buffers at once.
    """

    def encode(texts: pa.Array) -> np.ndarray:
        array = texts.fill_null("").cast(pa.large_string())
        out = np.zeros((len(array), size))
        _, offsets, data = array.buffers()
        if data is None or not len(array):
            return out
        places = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
        letters = _LOWER[np.frombuffer(data, np.uint8)[places[0] : places[-1]]]
        places = places - places[0]
        if not len(letters):
            return out
        word = ~_SPACE[letters]
        edge = np.ones(len(letters) + 1, bool)
        edge[1:-1] = word[1:] != word[:-1]
        edge[places] = True
        starts, ends = np.flatnonzero(edge[:-1] & word), np.flatnonzero(edge[1:] & word) + 1
        plain = np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])
        weighed = np.concatenate([[0], np.cumsum(letters * np.arange(len(letters), dtype=np.int64))])
        total = plain[ends] - plain[starts]
        hashes = 31 * (weighed[ends] - weighed[starts] - starts * total) + 7 * total
        rows = np.searchsorted(places, starts, side="right") - 1
        np.add.at(out, (rows, hashes % size), 1.0)
        return _unit(out)

    return encode


def embed_texts(texts: DataFrame, cached: DataFrame, encode: Callable[[pa.Array], np.ndarray], *, as_of, batch_size: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Vectors for texts (id, text): the answer, and the new cache entries.

    Texts are reduced to distinct keys, those with a live entry are taken from the
    cache, and only the others reach the encoder, ``batch_size`` texts at a time.
    New entries are stored before they are joined, so each is computed once
    however often both results are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                rows = np.ascontiguousarray(encode(part.column(1)), dtype=np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["key", "value"])

    asked = texts.withColumn("key", cache.embedding_key(F.col("text")))
    missing = cache.misses(asked, cached, as_of=as_of).select("key", "text")
    added = stored(cache.entries(missing.mapInArrow(run, "key string, value array<double>"), as_of=as_of))
    return cache.with_values(asked, cached, added, as_of=as_of).withColumnRenamed("value", "embedding"), added


def query_text(text: Column) -> Column:
    """The text that is encoded for a search query."""
    return F.concat(F.lit(V.QUERY_INSTRUCTION), text)
