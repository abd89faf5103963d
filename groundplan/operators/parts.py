"""Tables too large for one task, met part by part by all rows of another table.

The held table is dealt to parts of bounded size by one shuffle. The asking rows
are few next to it; every part meets all of them. A task holds one part at a time
and the asking rows stream past it, so neither side passes through the driver.
Where the asking rows are many, they are dealt to slices, and a part meets one
slice in each task. ``pass_by`` turns this round for asking rows that are the
larger side: a task holds a slice of them, and the other table streams past it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# parts whose best rows are merged first
PARTS_PER_MERGE = 64


def part_count(df: DataFrame, size: int, part_bytes: int, least_bytes: int) -> int:
    """Parts of at most ``part_bytes`` for ``size`` bytes; small tables are cut up to the cores there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // part_bytes), min(cores, size // least_bytes))


def part_of(key: Column, parts: int) -> Column:
    """The part of a row by a hash of its key."""
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(parts)).cast("int").alias("part")


def _stream(build: Callable, search: Callable, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, held = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key = 2 * table.column("part").to_numpy().astype(np.int64) + table.column("asks").to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if key[a] // 2 != part:
                    part, waiting, held = key[a] // 2, [], None
                if key[a] % 2 == 0:
                    waiting.append(table.slice(a, b - a))
                elif waiting or held is not None:
                    if held is None:
                        held, waiting = build(pa.concat_tables(waiting)), []
                    yield from search(held, int(part) // slices, table.slice(a, b - a))

    return run


def meet(held: DataFrame, asks: DataFrame, parts: int, build: Callable, search: Callable, schema: str, *, slices: int = 1) -> DataFrame:
    """``search(build(rows of a part), part, asking rows)`` for every part.

    ``held`` has a column part; the names of both tables are unlike. ``build``
    gets one Arrow table, ``search`` yields record batches of ``schema``. With
    ``slices`` the asking rows are dealt to so many by a hash, and each part is
    built once for each of them.
    """
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if slices > 1:
        held = held.withColumn("_slice", numbers(slices)).withColumn("part", F.col("part") * slices + F.col("_slice")).drop("_slice")
        dealt = F.pmod(F.xxhash64(*asks.columns), F.lit(slices)).cast("int")
    else:
        dealt = F.lit(0)
    every = asks.select(numbers(parts).alias("part"), F.lit(True).alias("asks"), *asks.columns)
    every = every.withColumn("part", F.col("part") * slices + dealt)
    both = held.withColumn("asks", F.lit(False)).unionByName(every, allowMissingColumns=True)
    # one partition would pass for the distribution that the ranking after this needs
    return both.repartition(max(2, parts * slices), "part").sortWithinPartitions("part", "asks").mapInArrow(_stream(build, search, slices), schema)


def _passing(build: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            own = int(np.searchsorted(table.column("passing").to_numpy(zero_copy_only=False), True))
            if own:
                waiting.append(table.slice(0, own))
            if own < len(table) and (waiting or held is not None):
                if held is None:
                    held, waiting = build(pa.concat_tables(waiting)), []
                held.meet(table.slice(own))
        if held is not None:
            yield from held.found()

    return run


def pass_by(held: DataFrame, passing: DataFrame, order: str, parts: int, slices: int, build: Callable, schema: str) -> DataFrame:
    """What each of some slices of ``held`` finds among the rows of ``passing``, which come in the ``order`` of a column, nulls last.

    The rows of ``passing`` are dealt to ``parts`` by that column. A task holds one
    slice, as ``build`` makes it of an Arrow table, lets the rows of one part pass by its
    ``meet``, batch after batch, and puts out the record batches of its ``found``.
    The names of both tables are unlike.
    """
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = F.pmod(F.xxhash64(*held.columns), F.lit(slices)).cast("int")
    held = held.withColumn("_slice", own).select("*", numbers(parts).alias("_part"), F.lit(False).alias("passing"))
    # the rows go out many times each, so that all cores take part
    passing = passing.repartition(passing.sparkSession.sparkContext.defaultParallelism, order)
    passing = passing.withColumn("_part", part_of(F.col(order), parts)).select("*", numbers(slices).alias("_slice"), F.lit(True).alias("passing"))
    both = held.unionByName(passing, allowMissingColumns=True).withColumn("part", F.col("_slice") * parts + F.col("_part")).drop("_slice")
    dealt = both.repartitionById(max(2, parts * slices), "part").drop("part").withColumnRenamed("_part", "part")
    return dealt.sortWithinPartitions("passing", F.asc_nulls_last(order)).mapInArrow(_passing(build), schema)


def best_of_parts(found: DataFrame, keys: list[str], order: list[Column], count: int, parts: int) -> DataFrame:
    """The first ``count`` rows per keys, over some parts at a time where there are many."""

    def cut(rows: DataFrame, *more) -> DataFrame:
        window = Window.partitionBy(*keys, *more).orderBy(*order)
        return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= count)

    if parts > PARTS_PER_MERGE:
        found = cut(found, F.floor(F.col("part") / PARTS_PER_MERGE)).drop("rank")
    return cut(found).drop("part")
