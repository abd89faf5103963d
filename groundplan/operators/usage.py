"""Usage analytics: event log, retrieval metrics, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _moment(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def since(df: DataFrame, *, as_of, days: int = 7) -> DataFrame:
    """Rows newer than ``days`` before ``as_of``."""
    cutoff = _moment(as_of) - F.make_dt_interval(F.lit(days))
    return df.filter(F.col("ts") > cutoff)


# --- event log ----------------------------------------------------------

_EVENT_KEYS = {
    "query": ["query"],
    "answer": ["query", "has_sources"],
    "document_ingest": ["document_name", "chunks_created"],
    "report_generate": ["project_name", "sections"],
    "validation": ["document_name", "pass_count", "fail_count"],
}


def typed_events(rows: DataFrame, event_type: str) -> DataFrame:
    """Event rows of one type, its own columns folded into ``metadata``.

    An answer is a success when it has sources; all other types always are.
    """
    pairs = [c for k in _EVENT_KEYS[event_type] for c in (F.lit(k), F.col(k).cast("string"))]
    success = F.col("has_sources") if event_type == "answer" else F.lit(True)
    return rows.select(
        "event_id", F.lit(event_type).alias("event_type"), "ts", "user_id", "session_id",
        F.create_map(*pairs).alias("metadata"), "duration_ms", success.alias("success"),
    )


def latest_events(writes: DataFrame, *, order: list[str] = ["ts"]) -> DataFrame:
    """The last write of each event.

    ``max_by`` keeps one row per event before the shuffle already, so an event
    written over and over does not gather in one task.
    """
    others = [c for c in writes.columns if c != "event_id"]
    last = writes.groupBy("event_id").agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last"))
    return last.select("event_id", *[F.col(f"last.{c}").alias(c) for c in others])


def merge_events(stored: DataFrame, writes: DataFrame, *, order: list[str] = ["ts"]) -> DataFrame:
    """Stored events with new writes replacing the rows of the same event."""
    new = latest_events(writes, order=order).select(*stored.columns)
    return stored.join(new.select("event_id"), "event_id", "left_anti").unionByName(new)


def retrieval_metrics(results: DataFrame) -> DataFrame:
    """Count, mean, best and worst score of each query with results."""
    return results.groupBy("query_id", "query", "ts").agg(
        F.count(F.lit(1)).alias("results_count"),
        F.avg("score").alias("avg_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
    )


def append_feedback(feedback: DataFrame, path: str) -> None:
    feedback.write.mode("append").parquet(path)


# --- statistics ---------------------------------------------------------


def usage_by_type(events: DataFrame, *, as_of, days: int = 7) -> DataFrame:
    return since(events, as_of=as_of, days=days).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.avg("duration_ms").alias("avg_duration_ms")
    )


def success_rate(events: DataFrame, *, as_of, days: int = 7) -> DataFrame:
    counts = since(events, as_of=as_of, days=days).agg(
        F.count(F.when(F.col("success"), 1)).alias("good"), F.count(F.lit(1)).alias("events")
    )
    rate = F.when(F.col("events") > 0, F.col("good") / F.col("events") * 100).otherwise(0.0)
    return counts.select("events", rate.alias("success_rate"))


def unique_users(events: DataFrame, *, as_of, days: int = 7, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return since(events, as_of=as_of, days=days).agg(
        count("user_id").alias("unique_users"), count("session_id").alias("unique_sessions")
    )


def retrieval_stats(metrics: DataFrame, *, as_of, days: int = 7) -> DataFrame:
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return since(metrics, as_of=as_of, days=days).agg(
        mean("avg_score").alias("avg_score"), mean("max_score").alias("avg_max_score"), mean("results_count").alias("avg_results")
    )


def feedback_distribution(metrics: DataFrame, *, as_of, days: int = 7) -> DataFrame:
    rows = since(metrics, as_of=as_of, days=days).filter(F.col("user_feedback").isNotNull())
    return rows.groupBy("user_feedback").agg(F.count(F.lit(1)).alias("answers"))


def popular_queries(metrics: DataFrame, *, as_of, days: int = 7, limit: int = 20) -> DataFrame:
    rows = since(metrics, as_of=as_of, days=days)
    counts = rows.groupBy("query").agg(F.count(F.lit(1)).alias("asked"), F.avg("avg_score").alias("avg_score"))
    return counts.orderBy(F.desc("asked"), "query").limit(limit)


def recent_feedback(feedback: DataFrame, *, limit: int = 20) -> DataFrame:
    return feedback.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


# a sketch of 2^14 counters is off by 0.8 % (one standard error)
SKETCH_BITS = 14


def daily_usage(events: DataFrame, *, sketches: bool = False) -> DataFrame:
    """Daily counts per type; the same plan runs on a table and on a stream.

    ``sketches`` adds HLL sketches of users and sessions, which days can unite.
    """
    seen = {"users": "user_id", "sessions": "session_id"} if sketches else {}
    return (
        events.groupBy(F.window("ts", "1 day").alias("window"), "event_type")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count(F.when(F.col("success"), 1)).alias("good"),
            F.sum("duration_ms").alias("duration_ms"),
            *[F.hll_sketch_agg(column, F.lit(SKETCH_BITS)).alias(name) for name, column in seen.items()],
        )
        .select(F.to_date("window.start").alias("day"), "event_type", "events", "good", "duration_ms", *seen)
    )


def _following(day: str, days: int):
    """The days whose window of ``days`` days holds a day."""
    return F.explode(F.sequence(F.col(day), F.date_add(day, days - 1))).alias("day")


def rolling_usage(daily: DataFrame, *, days: int = 7) -> DataFrame:
    """Usage over the last ``days`` days of each day with events, by type and, with type null, in all.

    ``daily`` is daily usage with sketches. Counts add up and sketches unite, so
    no event is read again: events, mean duration, success rate, users, sessions.
    """
    known = daily.select("day").distinct()
    spread = daily.withColumnRenamed("day", "_day").select(_following("_day", days), "event_type", "events", "good", "duration_ms", "users", "sessions")
    sums = spread.join(known, "day", "left_semi").groupingSets([("day", "event_type"), ("day",)], "day", "event_type").agg(
        F.sum("events").alias("events"), F.sum("good").alias("good"), F.sum("duration_ms").alias("_ms"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.hll_sketch_estimate(F.hll_union_agg("sessions")).alias("sessions"),
    )
    return sums.select(
        "day", "event_type", "events", (F.col("_ms") / F.col("events")).alias("avg_duration_ms"), (F.col("good") / F.col("events") * 100).alias("success_rate"),
        "users", "sessions",
    )


def rolling_distinct(events: DataFrame, *, days: int = 7) -> DataFrame:
    """Exact users and sessions of the same windows; each (day, user) is taken once before it is spread."""
    daily = events.select(F.to_date("ts").alias("_day"), "event_type", "user_id", "session_id")
    known = daily.select(F.col("_day").alias("day")).distinct()

    def counted(column: str, name: str) -> DataFrame:
        rows = daily.select("_day", "event_type", column).distinct().select(_following("_day", days), "event_type", column)
        return rows.join(known, "day", "left_semi").groupingSets([("day", "event_type"), ("day",)], "day", "event_type").agg(F.count_distinct(column).alias(name))

    users, sessions = counted("user_id", "users"), counted("session_id", "sessions").withColumnRenamed("day", "_d").withColumnRenamed("event_type", "_t")
    both = users.join(sessions, (F.col("day") == F.col("_d")) & F.col("event_type").eqNullSafe(F.col("_t")))
    return both.select("day", "event_type", "users", "sessions")
