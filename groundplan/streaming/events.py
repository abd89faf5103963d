"""Event streams: upsert of the event table and the daily usage table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundplan import schemas
from groundplan.operators.usage import daily_usage, latest_events

_BUCKETS = 64


def read_events(spark: SparkSession, folder: str, *, schema=schemas.USAGE_EVENTS, max_files: int = 1000) -> DataFrame:
    """JSON event files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int").alias("bucket")


def write_batch(batch: DataFrame, batch_id: int, path: str, buckets: int = _BUCKETS) -> None:
    """Append the last writes of one batch as that batch's own folder.

    The folder name carries the batch, so a batch that is run again after a
    failure replaces its own output and nothing else.
    """
    rows = latest_events(batch).withColumn("batch_id", F.lit(batch_id))
    rows.withColumn("bucket", _bucket(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")


def upsert_events(events: DataFrame, path: str, checkpoint: str, *, available_now: bool = False, buckets: int = _BUCKETS) -> StreamingQuery:
    """Keep the last write of each event from a stream.

    Each batch only stores its own changes; ``current_events`` reads the table
    as of now and ``compact_events`` folds the batches together.
    """
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: write_batch(batch, batch_id, path, buckets)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _batches(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the folded folders and of the batch folders at a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
    number = lambda kind: sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))
    done = [n for n in number("folded") if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/folded={n}/_SUCCESS"))]
    return done, number("batch")


def _read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the last fold and of the batches after it."""
    folded, batches = _batches(spark, path)
    last = folded[-1] if folded else -1
    later = [f"{path}/batch={n}" for n in batches if n > last]
    frames = [spark.read.parquet(f"{path}/folded={last}")] if folded else []
    frames += [spark.read.option("basePath", path).parquet(*later).drop("batch", "bucket")] if later else []
    return reduce(DataFrame.unionByName, frames)


def fold_batches(spark: SparkSession, path: str, fold) -> None:
    """Write ``fold(rows)`` of all batches so far as one folder and delete what it replaces.

    The folder counts once it is whole, so a fold that fails leaves everything as
    it was; batches that arrive meanwhile have larger numbers and stay.
    """
    folded, batches = _batches(spark, path)
    if not batches or (folded and batches[-1] <= folded[-1]):
        return
    fold(_read_batches(spark, path)).write.mode("overwrite").parquet(f"{path}/folded={batches[-1]}")
    for old in [f"folded={n}" for n in folded] + [f"batch={n}" for n in batches]:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _latest_writes(rows: DataFrame) -> DataFrame:
    return latest_events(rows, order=["batch_id", "ts"])


def current_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table: for each event the last write of the latest batch."""
    return _latest_writes(_read_batches(spark, path)).drop("batch_id")


def fold_events(spark: SparkSession, path: str) -> None:
    """Fold the batches of the event table in place, so that readers open few files."""
    fold_batches(spark, path, _latest_writes)


def compact_events(spark: SparkSession, path: str, target: str, buckets: int = _BUCKETS) -> None:
    current_events(spark, path).withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy(
        "bucket"
    ).parquet(target)


def distinct_events(events: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """First arrival of each event within the watermark, as a stream."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def write_distinct_events(events: DataFrame, path: str, checkpoint: str, *, delay: str = "1 day", available_now: bool = False) -> StreamingQuery:
    """Keep the first arrival of each event; ids seen are remembered over restarts of the checkpoint for ``delay``.

    Rows later than that are dropped and counted, see ``late_rows``.
    """
    writer = distinct_events(events, delay=delay).writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: write_batch(batch, batch_id, path)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that the batches known to the query dropped as too late."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])


def daily_usage_stream(events: DataFrame, *, delay: str = "1 day", sketches: bool = False) -> DataFrame:
    """Daily usage from a stream; rows later than ``delay`` are dropped."""
    return daily_usage(events.withWatermark("ts", delay), sketches=sketches)


def write_daily_usage(events: DataFrame, path: str, checkpoint: str, *, delay: str = "1 day", available_now: bool = False, sketches: bool = False) -> StreamingQuery:
    """Keep the counts of every day up to now, the running one included, and with ``sketches`` its users and sessions.

    Each batch stores the days it changed in a folder of its own, which a batch
    that runs again replaces; ``current_daily_usage`` reads the latest of each and
    ``fold_daily_usage`` brings the folders together.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    daily = daily_usage_stream(events, delay=delay, sketches=sketches)
    writer = daily.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _latest_days(rows: DataFrame) -> DataFrame:
    counts = [c for c in rows.columns if c not in ("day", "event_type")]
    latest = rows.groupBy("day", "event_type").agg(F.max_by(F.struct(*counts), "batch_id").alias("_now"))
    return latest.select("day", "event_type", "_now.*")


def current_daily_usage(spark: SparkSession, path: str) -> DataFrame:
    """Daily usage as of now: the counts that the latest batch has for each day and type."""
    return _latest_days(_read_batches(spark, path)).drop("batch_id")


def fold_daily_usage(spark: SparkSession, path: str) -> None:
    fold_batches(spark, path, _latest_days)
