"""Greedy blocks over sequences of any length.

Where a block ends depends on where it began, so a plain reading goes item by
item. Here every item learns where a block would end that began with it, for all
items at once, and the beginnings that are really reached from the first item are
found by doubling: each round doubles how many blocks ahead an item can see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundplan.operators.running import along
from groundplan.session import cut_lineage

# items, and characters in multiples of the limit, that are numbered in one task
_ITEMS_PER_PART = 4096
_LIMITS_PER_PART = 256


def _next_begins(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Where the block after one that begins at an item begins (keys, i, j), for items with such a block.

    A block ends with the first item whose running size reaches what the block
    needs. Sizes and needs are read together from the largest down, so each need
    finds the last size seen, the smallest one not below it.
    """
    need = F.greatest(F.col("_upto") - F.col("_size") + limit, F.when(F.col("_opens"), F.col("_upto") + 1).otherwise(0))
    sizes = rows.select(*keys, F.col("_upto").alias("_value"), F.lit(0).alias("_asks"), F.col("_i").alias("i"))
    needs = rows.select(*keys, need.alias("_value"), F.lit(1).alias("_asks"), F.col("_i").alias("i"))
    down = -F.floor(F.col("_value") / (limit * _LIMITS_PER_PART))
    order = [-F.col("_value"), F.col("_asks"), F.col("i")]
    read = along(sizes.unionByName(needs), keys, down, order, latest={"_last": F.when(F.col("_asks") == 0, F.col("i"))})
    return read.filter((F.col("_asks") == 1) & F.col("_last").isNotNull()).select(*keys, "i", (F.col("_last") + 1).alias("j"))


def greedy_blocks(rows: DataFrame, keys: list[str], at: str, size: Column, limit: int, opens: Column | None = None) -> DataFrame:
    """``rows`` with the number of their block within ``keys``, from 0, along the unique column ``at``.

    A block takes items until their sizes add up to ``limit``; the item that
    reaches it is its last. An item with ``opens``, which can only be the first of
    its sequence, never ends a block. Sequences below the limit are one block and
    take no part in the rounds.
    """
    opens = F.lit(False) if opens is None else opens
    rows = rows.withColumns({"_size": size.cast("long"), "_opens": opens})
    rows = cut_lineage(along(rows, keys, F.floor(F.col(at) / _ITEMS_PER_PART), [F.col(at)], totals={"_upto": F.col("_size")}, rank="_i"))
    totals = rows.groupBy(*keys).agg(F.max("_upto").alias("_total")).filter(F.col("_total") >= limit)
    most = totals.agg(F.max("_total")).first()[0]
    helpers = ["_size", "_opens", "_upto", "_i"]
    if most is None:
        return rows.withColumn("block", F.lit(0)).drop(*helpers)
    long = totals.select(*keys)
    steps = _next_begins(rows.join(long, keys, "left_semi"), keys, limit)
    begins = cut_lineage(long.withColumn("i", F.lit(1).cast("long")))
    for _ in range((most // limit + 1).bit_length()):
        steps = cut_lineage(steps)
        begins = cut_lineage(begins.unionByName(begins.join(steps, [*keys, "i"]).select(*keys, F.col("j").alias("i"))))
        further = steps.select(*keys, F.col("i").alias("j"), F.col("j").alias("_then"))
        steps = steps.join(further, [*keys, "j"]).select(*keys, "i", F.col("_then").alias("j"))
    begins = begins.distinct().select(*keys, F.col("i").alias("_i"), F.lit(1).alias("_begins"))
    marked = rows.join(begins, [*keys, "_i"], "left")
    counted = along(marked, keys, F.floor(F.col("_i") / _ITEMS_PER_PART), [F.col("_i")], totals={"_blocks": F.coalesce("_begins", F.lit(0))})
    return counted.withColumn("block", F.greatest(F.col("_blocks") - 1, F.lit(0)).cast("int")).drop(*helpers, "_begins", "_blocks")
