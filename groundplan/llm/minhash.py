"""Near-duplicate documents by b-bit MinHash, every link confirmed on whole shingle sets.

1. Each text becomes its set of word shingles; equal sets are one class.
2. Minima of the set under many hash functions give band keys and, by their
   lowest bits, a packed signature. Classes that share a band key form clusters
   (connected components of stars around the smallest id of each key).
3. A cluster's sets come together in parts of bounded size. Inside a part the
   signatures estimate similarities, corrected for chance agreement of the bits;
   what may reach the limit is compared on whole sets, unless already connected.
   Only links that connect are put out, never all pairs.
4. Parts of a large cluster share some members, which ties them together. What
   then is outside a cluster's largest component meets all other parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.llm.components import components
from groundplan.llm.units import tidy
from groundplan.llm.words import LOWER, Texts, blocks, find_words, hash_words, mix, read_texts
from groundplan.session import stored

ROWS = 5  # minima in a band
BITS = 4  # kept of each minimum
# chance that a pair just at the limit shares no band
MISS = 1e-5
# a part of a cluster holds about this many sets and shingles at most
PART_SETS = 2000
PART_SHINGLES = 2_000_000
# members that all parts of a large cluster share
SHARED = 50


def band_count(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def shingles(texts: Texts, size: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text in order as hashes, end to end, and where each text's begin.

    Words are runs without ASCII white space, ``fold`` lower-cases A to Z. A text
    of fewer than ``size`` words is one shingle, one without words has none.
    """
    data = LOWER[texts.data] if fold else texts.data
    words = find_words(Texts(data, texts.offsets))
    hashes, firsts, counts = hash_words(data, words), words.firsts, words.counts
    sizes = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.empty(bounds[-1], np.uint64)
    factor = np.uint64(0xC2B2AE3D27D4EB4F)
    for length in range(1, size + 1):
        rows = np.flatnonzero(counts == length) if length < size else np.flatnonzero(counts >= size)
        start = np.repeat(firsts[rows] - bounds[rows], sizes[rows])
        put = np.repeat(bounds[rows] - (np.cumsum(sizes[rows]) - sizes[rows]), sizes[rows]) + np.arange(sizes[rows].sum())
        value = np.full(len(put), length, np.uint64)
        for k in range(length):
            value = (value ^ (value >> np.uint64(29))) * factor + hashes[put + start + k]
        flat[put] = mix(value)
    return flat, bounds


def shingle_sets(texts: Texts, size: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The same, sorted and each once."""
    flat, bounds = shingles(texts, size, fold)
    parts = [np.unique(flat[a:b]) if b - a > 1 else flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return (np.concatenate(parts) if parts else flat), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def minima(flat: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """Smallest value of each set under ``count`` hash functions; sets without members give zeros."""
    out = np.zeros((len(bounds) - 1, count), np.uint64)
    there = np.flatnonzero(np.diff(bounds))
    if len(there):
        salt = mix(np.arange(1, count + 1, dtype=np.uint64))
        factor = mix(salt) | np.uint64(1)
        for p in range(count):
            out[there, p] = np.minimum.reduceat((flat ^ salt[p]) * factor[p], bounds[there])
    return out


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The lowest bits of the minima, sixteen to a 64-bit word."""
    lanes = -(-least.shape[1] // 16) * 16
    low = np.zeros((len(least), lanes), np.uint64)
    low[:, : least.shape[1]] = least & np.uint64(2**BITS - 1)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(len(least), -1, 16) << shifts, axis=2)


def agreeing(one: np.ndarray, others: np.ndarray, count: int) -> np.ndarray:
    """How many of the ``count`` kept minima agree between one signature and each of the others."""
    differ = one ^ others
    differ |= differ >> np.uint64(1)
    differ |= differ >> np.uint64(2)
    return count - np.bitwise_count(differ & np.uint64(0x1111111111111111)).sum(axis=1).astype(np.int64)


def least_agreeing(percent: int, count: int) -> int:
    """Agreeing minima below which a pair is, but for a chance of about 3e-7, under the limit.

    Bits of different minima agree by chance once in 2^BITS times, which is
    part of what a pair at the limit is expected to show.
    """
    chance = percent / 100 + (1 - percent / 100) / 2**BITS
    return math.floor(count * chance - 5 * math.sqrt(count * chance * (1 - chance)))


def fingerprints(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Set size, set hash, band keys and packed signature of every document (doc_id, text)."""
    count = band_count(percent) * ROWS

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, past, texts in blocks(read_texts(batch.column(1))):
                flat, bounds = shingle_sets(texts, size)
                least = minima(flat, bounds, count)
                sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(np.column_stack([flat, mix(flat)]), axis=0, dtype=np.uint64)])
                whole = sums[bounds[1:]] - sums[bounds[:-1]]
                keys = np.zeros((len(least), count // ROWS), np.uint64)
                for k in range(ROWS):
                    keys = mix(keys + least[:, k::ROWS] + np.arange(1, count // ROWS + 1, dtype=np.uint64) * np.uint64(k + 1))
                bits = packed_bits(least)
                step = np.arange(len(least) + 1, dtype=np.int32) * keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, past - first).cast(pa.int64()),
                        pa.array(np.diff(bounds)),
                        pa.array(whole[:, 0].view(np.int64)), pa.array(whole[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(step), pa.array(keys.reshape(-1).view(np.int64))),
                        pa.array([b.tobytes() for b in bits], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"],
                )

    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits binary"
    return documents.select("doc_id", "text").mapInArrow(tidy(make), schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys from a sorted stream, one table for each run; a run is held whole, so it must be bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows > 1 else np.zeros(0, np.int64)
        if held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != c[0] for k, c in zip(keys, columns)):
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def connect(sets: list[np.ndarray], bits: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, count: int) -> list[tuple[int, int]]:
    """Links between a left and a right member that connect what ``root`` does not connect yet."""
    sizes = np.array([len(s) for s in sets])
    enough, links = least_agreeing(percent, count), []
    for x in np.flatnonzero(left).tolist():
        fit = right & (root != root[x]) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
        fit[:x] &= ~(left[:x] & right[x])  # met the other way round
        others = np.flatnonzero(fit)
        if not len(others):
            continue
        alike = agreeing(bits[x], bits[others], count)
        others = others[alike >= enough][np.argsort(-alike[alike >= enough], kind="stable")]
        taken = 8
        while len(others):
            part, others = others[:taken], others[taken:]
            flat = np.concatenate([sets[y] for y in part])
            at = np.minimum(np.searchsorted(sets[x], flat), sizes[x] - 1)
            shared = np.add.reduceat((sets[x][at] == flat).astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
            for y in part[100 * shared >= percent * (sizes[x] + sizes[part] - shared)].tolist():
                if root[y] != root[x]:
                    links.append((x, y))
                    root[root == root[y]] = root[x]
            others = others[root[others] != root[x]]
            taken *= 2
    return links


def _links(members: DataFrame, percent: int, count: int) -> DataFrame:
    """Links (a, b) found within each (cluster, part) of ``members``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["cluster", "part"]):
            if group.num_rows < 2:
                continue
            node = group.column("node").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)
            _, root = np.unique(group.column("known").to_numpy(), return_inverse=True)
            role = group.column("role").to_numpy()
            pairs = connect(sets, bits, root, role & 1 > 0, role & 2 > 0, percent, count)
            if pairs:
                a, b = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    columns = ["cluster", "part", "node", "known", "role", "bits", "shingles"]
    placed = members.select(*columns).repartition("cluster", "part").sortWithinPartitions("cluster", "part", "node")
    return placed.mapInArrow(tidy(find), "a long, b long")


def _with_sets(members: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """Members with the sorted hashes of their shingles, from the texts of the documents that stand for them alone."""
    rows = documents.select(F.col("doc_id").alias("named"), "text").join(members, "named").drop("named")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            for first, past, texts in blocks(read_texts(batch.column(batch.schema.get_field_index("text")))):
                flat, bounds = shingle_sets(texts, size)
                made = pa.array([flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                whole = [int(flat[a:b].sum(dtype=np.uint64).view(np.int64)) for a, b in zip(bounds[:-1], bounds[1:])]
                kept = [batch.column(i).slice(first, past - first) for i in rest]
                yield pa.RecordBatch.from_arrays([*kept, made, pa.array(whole, pa.int64())], [*[batch.schema.names[i] for i in rest], "shingles", "_set"])

    schema = rows.drop("text").schema.add("shingles", "binary").add("_set", "long")
    # a doc_id may stand on several texts: the one of the class, once
    return rows.mapInArrow(tidy(add), schema).filter(F.col("_set") == F.col("set_a")).drop("_set").dropDuplicates(["node"])


def _classes(prints: DataFrame) -> DataFrame:
    """One row for each distinct set that is not empty: a number of its own, and the smallest doc_id it stands on."""
    known = prints.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    sets = known.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("named"), F.min("bands").alias("bands"), F.min("bits").alias("bits"))
    return sets.withColumn("node", F.xxhash64("n_shingles", "set_a", "set_b"))


def _clusters(classes: DataFrame) -> DataFrame:
    """Classes connected by shared band keys: (node, cluster)."""
    keyed = classes.select("node", F.explode("bands").alias("key"))
    stars = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("_last")).filter(F.col("centre") != F.col("_last")).drop("_last")
    return components(keyed.join(stars, "key").filter(F.col("node") != F.col("centre")).select("node", "centre").distinct()).withColumnRenamed("component", "cluster")


def find_links(documents: DataFrame, prints: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the doc_ids of classes (a, b) that leave no two of one component unconnected."""
    count = band_count(percent) * ROWS
    classes = stored(_classes(prints))
    members = _clusters(classes).join(classes.drop("bands"), "node")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("_sets"), F.sum("n_shingles").alias("_shingles"))
    parts = F.greatest(F.ceil(F.col("_sets") / PART_SETS), F.ceil(F.col("_shingles") / PART_SHINGLES)).cast("int")
    members = members.join(sizes.select("cluster", "_sets", parts.alias("parts")), "cluster")
    ready = stored(_with_sets(members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), documents, size))
    shared = (F.col("parts") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("_sets")) < SHARED)
    first = ready.withColumn("part", F.explode(F.when(shared, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
    found = stored(_links(first.withColumns({"known": F.col("node"), "role": F.lit(3)}), percent, count))
    split = ready.filter(F.col("parts") > 1)
    if split.take(1):
        found = found.unionByName(_links(_across(split, found), percent, count))
    for side in ("a", "b"):
        found = found.join(classes.select(F.col("node").alias(side), F.col("named").alias(f"_{side}")), side)
    return found.select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def _across(split: DataFrame, found: DataFrame) -> DataFrame:
    """What is outside the largest component of a cluster in parts, against all parts of the cluster."""
    known = components(found)
    split = split.join(known, "node", "left").withColumn("known", F.coalesce("component", "node")).drop("component")
    counts = split.groupBy("cluster", "known").agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.groupBy("cluster").agg(F.max_by("known", F.struct("_n", "known")).alias("_largest"), F.sum("_n").alias("_all"), F.max("_n").alias("_most"))
    outside = largest.withColumn("_strips", F.ceil((F.col("_all") - F.col("_most")) / PART_SETS).cast("int")).filter(F.col("_strips") > 0)
    rows = split.join(outside.select("cluster", "_largest", "_strips"), "cluster")
    strip = F.pmod(F.xxhash64("node", F.lit(2)), F.col("_strips")).cast("int")
    rows = rows.withColumn("_strip", F.when(F.col("known") != F.col("_largest"), strip))
    # left members of a strip go to every part, right members of a part to every strip
    lefts = rows.filter(F.col("_strip").isNotNull()).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lefts = lefts.withColumn("role", F.when(F.col("_part") == F.col("own"), 3).otherwise(1))
    rights = rows.withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("_strips") - 1)))
    rights = rights.filter(F.col("_strip").isNull() | (F.col("_to") != F.col("_strip"))).withColumns({"_part": F.col("own"), "role": F.lit(2), "_strip": F.col("_to")}).drop("_to")
    return lefts.unionByName(rights).withColumn("part", F.col("_strip") * F.col("parts") + F.col("_part"))


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Size of the shingle set and component of every row of ``documents`` (doc_id, text).

    Two documents are linked when their sets of ``size``-word shingles share at
    least ``percent`` of a hundred of their union; ``component_id`` is the
    smallest doc_id that links lead to, the own one included, and ``kept`` marks
    the documents that carry it. Texts that are null or without words have an
    empty set and stand alone. Rows of one doc_id are one document, linked to copies of
    any of its texts and to what is near one of them. A row without doc_id stands alone, with no component, and is
    kept. Other columns are ignored.
    """
    prints = stored(fingerprints(documents, size, percent))
    links = find_links(documents, prints, size, percent)
    classes = prints.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    groups = classes.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("_last"))
    copies = classes.join(groups.filter(F.col("a") != F.col("_last")), ["n_shingles", "set_a", "set_b"]).select("a", F.col("doc_id").alias("b"))
    found = components(links.unionByName(copies)).withColumnRenamed("node", "doc_id")
    rows = prints.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    own = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one_of_each(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but one, the smallest doc_id, of each group of near duplicates.

    Rows equal in doc_id and text are one; unlike texts of one doc_id all stay or all go.
    """
    kept = near_duplicates(documents, size, percent).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = documents.join(kept, F.col("doc_id") == F.col("_kept")).drop("_kept").withColumn("_same", F.xxhash64("text")).dropDuplicates(["doc_id", "_same"]).drop("_same")
    return rows.unionByName(documents.filter(F.col("doc_id").isNull()))
