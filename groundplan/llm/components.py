"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.session import stored


def _large(links: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the node's smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("_least"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("_least"))
    tied = links.join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    own = least.select("a", F.col("_least").alias("b"))
    return tied.unionByName(own).filter(F.col("a") != F.col("b")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether no node that others are tied to is tied to another."""
    roots = links.select(F.col("b").alias("a")).distinct()
    return not links.select("a").join(roots, "a", "left_semi").take(1)


def components(links: DataFrame) -> DataFrame:
    """Smallest member (``component``) of the component of every linked ``node``.

    ``links`` has two columns of equal type, in either order and with repeats.
    Larger and smaller neighbours are tied to the smallest in turn, a logarithmic
    number of times, until every node is tied to a smallest one; each round is
    written out, and no round holds a node's links in one place. Nulls and links
    of a node to itself are left out.
    """
    a, b = links.columns
    now = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = stored(_small(now))
    while not _settled(now):
        now = stored(_small(_large(now)))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
