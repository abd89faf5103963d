"""Size checks ahead of a broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# rows and bytes that every executor can hold
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def _bytes(name: str, kind: str) -> Column:
    size = F.octet_length(name) if kind in ("string", "binary") else 8 * F.size(name) if kind.startswith(("array", "map")) else F.lit(8)
    return F.coalesce(size, F.lit(0)) + 16


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``max_rows`` rows and about ``max_bytes``.

    Larger frames are returned as they are and join by shuffle. The check reads
    no more than ``max_rows`` + 1 rows.
    """
    total = sum((_bytes(n, k) for n, k in df.dtypes), F.lit(0))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df
