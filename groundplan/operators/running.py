"""Running totals and ranks over groups of any size.

A window over a whole group runs in one task. Here each group is cut along its
own order into buckets; bucket totals are few, so their running sum is cheap,
and the row level window only ever sees one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# group keys and bucket as one value: null keys then join like any other, and
# the rows are shuffled once for the join and the window alike
_PART = "_part"


def _parted(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    return df.withColumn(_PART, F.struct(*keys, bucket.alias("_bucket")))


def _before(keys: list[str]):
    """The buckets of a group ahead of each bucket."""
    window = Window.partitionBy(*[f"{_PART}.{k}" for k in keys]).orderBy(f"{_PART}._bucket")
    return window.rowsBetween(Window.unboundedPreceding, -1)


def along(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[Column],
    *,
    totals: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    rank: str | None = None,
) -> DataFrame:
    """Add, within ``keys`` and along ``order``, running sums of ``totals``, the
    latest non-null value of ``latest``, and a 1-based ``rank``.

    ``bucket`` must not decrease along ``order``, and ``order`` must be unique
    within a bucket.
    """
    totals, latest = totals or {}, latest or {}
    rows = _parted(df, keys, bucket)
    place = F.struct(*order)
    per_bucket = rows.groupBy(_PART).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()],
        *[F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_last_{n}") for n, c in latest.items()],
    )
    before = _before(keys)
    offsets = per_bucket.select(
        _PART,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals],
        *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_carried_{n}") for n in latest],
    )
    inside = Window.partitionBy(_PART).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {n: F.col(f"_before_{n}") + F.sum(c).over(upto) for n, c in totals.items()}
    added |= {n: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_carried_{n}")) for n, c in latest.items()}
    if rank:
        added[rank] = F.col("_rows_before") + F.row_number().over(inside)
    return rows.join(offsets, _PART).select(*df.columns, *[c.alias(n) for n, c in added.items()])


def running_totals(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], totals: dict[str, Column] | None = None, rank: str | None = None) -> DataFrame:
    """Running sums and rank only."""
    return along(df, keys, bucket, order, totals=totals, rank=rank)


def carry_forward(df: DataFrame, keys: list[str], bucket: Column, order: Column, values: dict[str, Column]) -> DataFrame:
    """Latest non-null values only."""
    return along(df, keys, bucket, [order], latest=values)
