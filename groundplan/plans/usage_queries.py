"""Queries of the usage and cache family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from groundplan.operators import cache, usage
from groundplan.plans.registry import Registry
from groundplan.sources.tables import AS_OF_TIME

REGISTRY = Registry()
query = REGISTRY.add

NOW = f"TIMESTAMP '{AS_OF_TIME}'"
RECENT = f"ts > {NOW} - INTERVAL 7 DAY"


@query("usage_by_type", "usage_events", f"""
SELECT event_type, count(*) events, round(avg(duration_ms), 6) avg_duration_ms FROM usage_events WHERE {RECENT} GROUP BY 1""")
def usage_by_type(events):
    return usage.usage_by_type(events, as_of=AS_OF_TIME).selectExpr("event_type", "events", "round(avg_duration_ms, 6) avg_duration_ms")


@query("success_rate", "usage_events", f"""
SELECT count(*) events, round(count(*) FILTER (success) * 100.0 / count(*), 6) success_rate FROM usage_events WHERE {RECENT}""")
def success_rate(events):
    return usage.success_rate(events, as_of=AS_OF_TIME).selectExpr("events", "round(success_rate, 6) success_rate")


@query("unique_users", "usage_events", f"""
SELECT count(DISTINCT user_id) unique_users, count(DISTINCT session_id) unique_sessions FROM usage_events WHERE {RECENT}""")
def unique_users(events):
    return usage.unique_users(events, as_of=AS_OF_TIME)


@query("retrieval_stats", "retrieval_metrics", f"""
SELECT round(avg(avg_score), 6) avg_score, round(avg(max_score), 6) avg_max_score, round(avg(results_count), 6) avg_results
FROM retrieval_metrics WHERE {RECENT}""")
def retrieval_stats(metrics):
    return usage.retrieval_stats(metrics, as_of=AS_OF_TIME).selectExpr(
        "round(avg_score, 6) avg_score", "round(avg_max_score, 6) avg_max_score", "round(avg_results, 6) avg_results"
    )


@query("feedback_distribution", "retrieval_metrics", f"""
SELECT user_feedback, count(*) answers FROM retrieval_metrics WHERE {RECENT} AND user_feedback IS NOT NULL GROUP BY 1""")
def feedback_distribution(metrics):
    return usage.feedback_distribution(metrics, as_of=AS_OF_TIME)


@query("popular_queries", "retrieval_metrics", f"""
SELECT query, count(*) asked, round(avg(avg_score), 6) avg_score FROM retrieval_metrics WHERE {RECENT} GROUP BY 1 ORDER BY asked DESC, query LIMIT 20""")
def popular_queries(metrics):
    return usage.popular_queries(metrics, as_of=AS_OF_TIME).selectExpr("query", "asked", "round(avg_score, 6) avg_score")


@query("recent_feedback", "user_feedback", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') ts, event_id, query, rating, feedback_text FROM user_feedback ORDER BY user_feedback.ts DESC, event_id DESC LIMIT 20""")
def recent_feedback(feedback):
    return usage.recent_feedback(feedback).selectExpr(
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') ts", "event_id", "query", "rating", "feedback_text"
    )


@query("event_upsert", "event_writes", """
SELECT event_id, event_type, user_id, duration_ms, write_no FROM event_writes
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, write_no DESC) = 1""")
def event_upsert(writes):
    return usage.latest_events(writes, order=["ts", "write_no"]).drop("ts")


# the fields that each type of event brings, derived from the number of its user and its duration
_FIELDS = {
    "query": {"query": "concat('question ', user_id)"},
    "answer": {"query": "concat('question ', user_id)", "has_sources": "success AND duration_ms > 100"},
    "document_ingest": {"document_name": "concat('Manual ', user_id)", "chunks_created": "duration_ms"},
    "report_generate": {"project_name": "concat('Tower ', user_id)", "sections": "duration_ms % 12"},
    "validation": {"document_name": "concat('Report ', user_id)", "pass_count": "duration_ms % 20", "fail_count": "duration_ms % 7"},
}
_FIELD_NAMES = sorted({f for own in _FIELDS.values() for f in own})


@query("event_metadata", "usage_events", "\nUNION ALL ".join(
    f"SELECT event_id, event_type, {', '.join(f'CAST({own[f]} AS VARCHAR) AS {f}' if f in own else f'CAST(NULL AS VARCHAR) AS {f}' for f in _FIELD_NAMES)}, "
    f"{own.get('has_sources', 'true')} AS success FROM usage_events WHERE event_type = '{kind}'" for kind, own in _FIELDS.items()))
def event_metadata(events):
    parts = [
        usage.typed_events(events.filter(F.col("event_type") == kind).withColumns({f: F.expr(e) for f, e in own.items()}), kind) for kind, own in _FIELDS.items()
    ]
    typed = reduce(lambda a, b: a.unionByName(b), parts)
    return typed.select("event_id", "event_type", *[F.col("metadata")[f].alias(f) for f in _FIELD_NAMES], "success")


@query("retrieval_log", "event_writes", """
SELECT user_id AS query_id, count(*) results_count, round(avg(duration_ms / 1000), 6) avg_score, round(max(duration_ms / 1000), 6) max_score, round(min(duration_ms / 1000), 6) min_score
FROM event_writes GROUP BY 1""")
def retrieval_log(writes):
    results = writes.selectExpr("user_id query_id", "concat('question ', user_id) query", "date '2024-01-01' ts", "duration_ms / 1000 score")
    return usage.retrieval_metrics(results).selectExpr(
        "query_id", "results_count", "round(avg_score, 6) avg_score", "round(max_score, 6) max_score", "round(min_score, 6) min_score"
    )


@query("daily_usage", "usage_events", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", event_type, count(*) events, count(*) FILTER (success) good, CAST(sum(duration_ms) AS BIGINT) duration_ms
FROM usage_events GROUP BY 1, 2""")
def daily_usage(events):
    return usage.daily_usage(events).selectExpr("cast(day as string) day", "event_type", "events", "good", "duration_ms")


CACHE_SQL = f"""
asked AS (SELECT request_id, ts, text, concat('embedding:', md5(text)) AS key FROM cache_requests),
alive AS (SELECT key FROM cache_entries WHERE expires_at > {NOW})"""


def _asked(requests):
    return requests.withColumn("key", cache.embedding_key(F.col("text")))


@query("cache_lookup", "cache_requests cache_entries", """
SELECT request_id, asked.key, alive.key IS NOT NULL AS hit FROM asked LEFT JOIN alive ON asked.key = alive.key""", CACHE_SQL)
def cache_lookup(requests, entries):
    return cache.lookup(_asked(requests), entries, as_of=AS_OF_TIME).select("request_id", "key", "hit")


@query("cache_misses", "cache_requests cache_entries", """
SELECT DISTINCT key, text FROM asked WHERE key NOT IN (SELECT key FROM alive)""", CACHE_SQL)
def cache_misses(requests, entries):
    return cache.misses(_asked(requests), entries, as_of=AS_OF_TIME)


@query("cache_access", "cache_requests cache_entries", """
SELECT e.key, e.access_count + CASE WHEN e.key IN (SELECT key FROM alive) THEN coalesce(n, 0) ELSE 0 END AS access_count
FROM cache_entries e LEFT JOIN (SELECT key, count(*) n FROM asked GROUP BY 1) a ON a.key = e.key""", CACHE_SQL)
def cache_access(requests, entries):
    return cache.record_hits(entries, _asked(requests), as_of=AS_OF_TIME).select("key", "access_count")


@query("cache_expiry", "cache_entries", f"""
SELECT key, access_count FROM cache_entries WHERE expires_at > {NOW}""")
def cache_expiry(entries):
    return cache.expire(entries, as_of=AS_OF_TIME)[0].select("key", "access_count")


@query("cache_stats", "cache_entries", f"""
SELECT 'embedding:' AS prefix, count(*) total_entries, count(*) FILTER (expires_at <= {NOW}) expired_entries, CAST(sum(access_count) AS BIGINT) total_accesses
FROM cache_entries""")
def cache_stats(entries):
    return cache.cache_stats(entries, as_of=AS_OF_TIME)


@query("cache_keys", "cache_requests", """
SELECT request_id, concat('embedding:', md5(text)) AS embedding_key, concat('llm:', sha256(concat(text, '|', 'system', '|', 'model'))) AS answer_key,
       concat('search:', md5(concat(text, '|', '{"clause_id": "6.1", "document_type": "code"}'))) AS search_key
FROM cache_requests""")
def cache_keys(requests):
    filters = F.create_map(F.lit("document_type"), F.lit("code"), F.lit("clause_id"), F.lit("6.1"))
    return requests.select(
        "request_id",
        cache.embedding_key(F.col("text")).alias("embedding_key"),
        cache.answer_key(F.col("text"), F.lit("system"), F.lit("model")).alias("answer_key"),
        cache.search_key(F.col("text"), filters).alias("search_key"),
    )


# --- streams ------------------------------------------------------------


def _stream(spark, folder):
    """The event table as a stream of its files, in the shape of usage events."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return rows.selectExpr(
        "concat(cast(user_id as string), '-', event_type) event_id", "event_type", "cast(ts as timestamp) ts", "cast(user_id as string) user_id",
        "cast(floor(value * 10) as bigint) duration_ms", "event_type <> 'error' success",
    )


def _folders(spark):
    from uuid import uuid4

    from groundplan.session import ensure_checkpoint_dir

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid4().hex}"
    return f"{base}/table", f"{base}/state"


def _event_upsert_stream(spark, folder):
    from groundplan.streaming import events

    table, state = _folders(spark)
    events.upsert_events(_stream(spark, folder), table, state, available_now=True, buckets=8).awaitTermination()
    return events.current_events(spark, table).select("event_id", "event_type", "user_id", "duration_ms", "success")


def _daily_usage_stream(spark, folder):
    from groundplan.streaming import events

    table, state = _folders(spark)
    events.write_daily_usage(_stream(spark, folder), table, state, available_now=True).awaitTermination()
    return events.current_daily_usage(spark, table).selectExpr("cast(day as string) day", "event_type", "events", "good", "duration_ms")


REGISTRY.add_plan("event_upsert_stream", _event_upsert_stream, "event_writes events", """
SELECT event_id, event_type, user_id, duration_ms, event_type <> 'error' AS success FROM event_writes
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts DESC) = 1""")
REGISTRY.add_plan("daily_usage_stream", _daily_usage_stream, "events", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", event_type, count(*) AS events, count(*) FILTER (event_type <> 'error') AS good, CAST(sum(floor(value * 10)) AS BIGINT) AS duration_ms
FROM events GROUP BY 1, 2""")


def _restarted(spark, folder):
    """Two runs of one checkpoint: the events of the first half of time, then all events again.

    What the second run sees anew is either known, too late, or of the second half.
    """
    from groundplan.sources.tables import view
    from groundplan.streaming import events

    table, state = _folders(spark)
    source = f"{table}/source"
    rows = view(spark, folder, "events").selectExpr("cast(event_id as string) event_id", "event_type", "ts")
    bounds = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    half = bounds.a + (bounds.b - bounds.a) / 2
    schema = rows.schema
    late = 0
    for part in (rows.filter(F.col("ts") < F.lit(half)), rows):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        run = events.write_distinct_events(stream, f"{table}/kept", state, available_now=True)
        run.awaitTermination()
        late += events.late_rows(run)
    events.compact_events(spark, f"{table}/kept", f"{table}/compact", 8)
    days = spark.read.parquet(f"{table}/compact").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return days.withColumn("late", F.lit(late).cast("long"))


REGISTRY.add_plan("event_stream_restart", _restarted, "events", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", event_type, count(*) AS events,
       (SELECT count(*) FROM events WHERE ts <= (SELECT max(ts) - INTERVAL 1 DAY FROM events WHERE ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events))) AS late
FROM events GROUP BY 1, 2""")


def _rolling(spark, folder):
    """Usage of the last seven days from the table that the stream keeps, next to exact counts."""
    from groundplan.streaming import events

    table, state = _folders(spark)
    rows = _stream(spark, folder)
    rows = rows.withColumn("session_id", F.concat_ws("-", "user_id", F.to_date("ts").cast("string")))
    events.write_daily_usage(rows, table, state, available_now=True, sketches=True).awaitTermination()
    events.fold_daily_usage(spark, table)
    shown = usage.rolling_usage(events.current_daily_usage(spark, table))
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
    exact = usage.rolling_distinct(spark.read.schema(schema).parquet(f"{folder}/events.parquet").selectExpr(
        "event_type", "cast(ts as timestamp) ts", "cast(user_id as string) user_id", "concat_ws('-', cast(user_id as string), cast(cast(ts as date) as string)) session_id"))
    exact = exact.select(F.col("day").alias("_d"), F.col("event_type").alias("_t"), F.col("users").alias("exact_users"), F.col("sessions").alias("exact_sessions"))
    both = shown.join(exact, (F.col("day") == F.col("_d")) & F.col("event_type").eqNullSafe(F.col("_t")))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.05 * F.col(b)
    return both.select(
        F.col("day").cast("string").alias("day"), F.coalesce("event_type", F.lit("all")).alias("event_type"), "events", F.round("avg_duration_ms", 6).alias("avg_duration_ms"),
        F.round("success_rate", 6).alias("success_rate"), F.col("exact_users").alias("users"), F.col("exact_sessions").alias("sessions"),
        near("users", "exact_users").alias("users_near"), near("sessions", "exact_sessions").alias("sessions_near"),
    )


REGISTRY.add_plan("rolling_usage", _rolling, "events", """
WITH known AS (SELECT DISTINCT CAST(ts AS DATE) AS "day" FROM events),
seen AS (SELECT CAST(ts AS DATE) AS d, event_type, user_id, CAST(floor(value * 10) AS BIGINT) AS ms FROM events)
SELECT CAST(k."day" AS VARCHAR) AS "day", coalesce(event_type, 'all') AS event_type, count(*) AS events, round(avg(ms), 6) AS avg_duration_ms,
       round(count(*) FILTER (event_type <> 'error') * 100.0 / count(*), 6) AS success_rate, count(DISTINCT user_id) AS users,
       count(DISTINCT concat(user_id, '-', d)) AS sessions, true AS users_near, true AS sessions_near
FROM known k JOIN seen s ON s.d BETWEEN k."day" - INTERVAL 6 DAY AND k."day" GROUP BY GROUPING SETS ((k."day", event_type), (k."day"))""")


@query("embedding_job", "documents", r"""
WITH texts AS (SELECT doc_id, text, concat('embedding:', md5(text)) AS key FROM documents),
words AS (SELECT DISTINCT key, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda w: w <> '')) AS word,
                 generate_subscripts(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda w: w <> ''), 1) AS at FROM texts),
spelled AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
hashed AS (SELECT word, list_sum(list_transform(range(0, len(h) // 2), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS INT), 2)) AS BIGINT) * (31 * i + 7))) % 64 AS slot FROM spelled),
counts AS (SELECT key, slot, CAST(count(*) AS DOUBLE) AS n FROM words JOIN hashed USING (word) GROUP BY ALL),
sums AS (SELECT key, sum(n) / sqrt(sum(n * n)) AS total, sum(n * (slot + 1)) / sqrt(sum(n * n)) AS weighed FROM counts GROUP BY 1),
half AS (SELECT DISTINCT key, md5(key) < '8' AS known FROM texts)
SELECT doc_id, t.key, known AS from_cache, round(CASE WHEN known THEN 64.0::DOUBLE ELSE coalesce(total, 0) END, 6) AS total, round(CASE WHEN known THEN 2080.0::DOUBLE ELSE coalesce(weighed, 0) END, 6) AS weighed,
       (SELECT count(*) FROM half WHERE NOT known) AS inserted
FROM texts t JOIN half USING (key) LEFT JOIN sums USING (key)""")
def embedding_job(docs):
    """Vectors of all documents; the cache holds a vector of ones for about every second key."""
    from groundplan.operators.vectors import embed_texts, word_hash_encoder

    now = F.lit(AS_OF_TIME).cast("timestamp")
    texts = docs.select("doc_id", "text")
    keys = texts.select(cache.embedding_key(F.col("text")).alias("key")).distinct().filter(F.md5("key") < "8")
    known = cache.entries(keys.select("key", F.array_repeat(F.lit(1.0), 64).alias("value")), as_of=now)
    made, added = embed_texts(texts, known, word_hash_encoder(64), as_of=AS_OF_TIME)
    weighed = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b)
    return made.select(
        "doc_id", "key", (F.md5("key") < "8").alias("from_cache"), F.round(total, 6).alias("total"), F.round(weighed, 6).alias("weighed"),
        F.lit(added.count()).cast("long").alias("inserted"),
    )
