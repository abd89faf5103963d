"""Cache tables: keys, lookup, refresh, expiry, statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundplan import fixed_values as V


def _moment(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def embedding_key(text: Column) -> Column:
    return F.concat(F.lit(V.CACHE_PREFIXES["embedding"]), F.md5(text))


def answer_key(prompt: Column, system_prompt: Column, model: Column) -> Column:
    joined = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (prompt, system_prompt, model)])
    return F.concat(F.lit(V.CACHE_PREFIXES["answer"]), F.sha2(joined, 256))


def filters_text(filters: Column) -> Column:
    """A map of text filters as JSON text with sorted keys and ', ' and ': ' between parts."""
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    entries = F.array_sort(F.map_entries(F.coalesce(filters, F.expr("cast(map() as map<string, string>)"))))
    parts = F.transform(entries, lambda e: F.concat(quote(e["key"]), F.lit(": "), quote(e["value"])))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def search_key(query: Column, filters: Column) -> Column:
    return F.concat(F.lit(V.CACHE_PREFIXES["search"]), F.md5(F.concat_ws("|", query, filters_text(filters))))


def live(cache: DataFrame, *, as_of) -> DataFrame:
    return cache.filter(F.col("expires_at") > _moment(as_of))


def lookup(requests: DataFrame, cache: DataFrame, *, as_of) -> DataFrame:
    """Each request with a ``hit`` flag; requests carry their ``key``."""
    known = live(cache, as_of=as_of).select("key", F.lit(True).alias("_known"))
    return requests.join(known, "key", "left").withColumn("hit", F.col("_known").isNotNull()).drop("_known")


def misses(requests: DataFrame, cache: DataFrame, *, as_of) -> DataFrame:
    """The distinct keys, with one text each, that have no live entry."""
    asked = requests.groupBy("key").agg(F.min("text").alias("text"))
    return asked.join(live(cache, as_of=as_of).select("key"), "key", "left_anti")


def compute_missing(
    requests: DataFrame,
    cache: DataFrame,
    compute: Callable[[pd.Series], pd.Series],
    *,
    as_of,
    ttl_seconds: int = V.CACHE_TTL_SECONDS["embedding"],
    value_type: str = "string",
) -> DataFrame:
    """New cache entries for the missing keys; ``compute`` maps a batch of texts.

    Each distinct text is computed once, whatever the number of requests.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "value": compute(batch["text"])})

    return entries(misses(requests, cache, as_of=as_of).mapInPandas(run, f"key string, value {value_type}"), as_of=as_of, ttl_seconds=ttl_seconds)


def entries(made: DataFrame, *, as_of, ttl_seconds: int = V.CACHE_TTL_SECONDS["embedding"]) -> DataFrame:
    """New values (key, value) as cache entries that live ``ttl_seconds``."""
    now = _moment(as_of)
    return made.select(
        "key", "value", now.alias("created_at"), (now + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"),
        F.lit(0).cast("bigint").alias("access_count"), now.alias("last_accessed"),
    )


def with_values(requests: DataFrame, cache: DataFrame, added: DataFrame, *, as_of) -> DataFrame:
    """Requests with their stored or newly computed value, in request order columns."""
    values = live(cache, as_of=as_of).select("key", "value").unionByName(added.select("key", "value"))
    return requests.join(values, "key", "left")


def record_hits(cache: DataFrame, requests: DataFrame, *, as_of) -> DataFrame:
    """Cache with access counts and times moved on by the requests that hit."""
    hits = requests.groupBy("key").agg(F.count(F.lit(1)).alias("_hits"), F.max("ts").alias("_last"))
    rows = cache.join(hits, "key", "left")
    alive = (F.col("expires_at") > _moment(as_of)) & F.col("_hits").isNotNull()
    seen = F.col("last_accessed") if "last_accessed" in cache.columns else F.col("created_at")
    return rows.withColumns(
        {
            "access_count": F.col("access_count") + F.when(alive, F.col("_hits")).otherwise(0),
            "last_accessed": F.when(alive, F.col("_last")).otherwise(seen),
        }
    ).drop("_hits", "_last")


def expire(cache: DataFrame, *, as_of) -> tuple[DataFrame, DataFrame]:
    """The entries that stay, and a one-row count of those dropped."""
    gone = cache.agg(F.count(F.when(F.col("expires_at") <= _moment(as_of), 1)).alias("deleted"))
    return live(cache, as_of=as_of), gone


def delete_key(cache: DataFrame, key: str) -> DataFrame:
    return cache.filter(F.col("key") != key)


def cache_stats(cache: DataFrame, *, as_of) -> DataFrame:
    """Entries, expired entries and accesses per key prefix."""
    prefix = F.concat(F.substring_index("key", ":", 1), F.lit(":"))
    return cache.groupBy(prefix.alias("prefix")).agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count(F.when(F.col("expires_at") <= _moment(as_of), 1)).alias("expired_entries"),
        F.coalesce(F.sum("access_count"), F.lit(0)).alias("total_accesses"),
    )
