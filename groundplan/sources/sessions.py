"""Stored sessions and document ingest jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from groundplan import schemas

# texts that a task turns into Python's own at a time
_FILES_AT_ONCE = 128


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Session files, one row each; a file that is no session is skipped."""
    rows = (
        spark.read.schema(schemas.SESSION_JSON).option("multiLine", True).option("pathGlobFilter", "session_*.json").option("mode", "DROPMALFORMED").json(folder)
    )
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"^session_|\.json$", "")
    return rows.select(F.coalesce("session_id", stem).alias("session_id"), *[c for c in rows.columns if c != "session_id"])


def session_sizes(sessions: DataFrame) -> DataFrame:
    """Sessions newest first with the length of both message lists."""
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    return sessions.select(
        "session_id", F.coalesce("saved_at", F.lit("")).alias("saved_at"), F.greatest(size("chat_history"), F.lit(0)).alias("chat_count"),
        F.greatest(size("designer_messages"), F.lit(0)).alias("designer_count"),
    ).orderBy(F.desc("saved_at"), "session_id")


def load_session(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.filter(F.col("session_id") == session_id)


def without_session(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.filter(F.col("session_id") != session_id)


# --- ingest jobs --------------------------------------------------------


def process_files(files: DataFrame, process: Callable[[str, str], int]) -> DataFrame:
    """Run ``process(path, text)`` on each file; one result row per file.

    A file that fails gives a row with its error and does not stop the job.
    ``files`` has job_id, path and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for batch in batches:
            for at in range(0, batch.num_rows, _FILES_AT_ONCE):
                out = []
                for job, path, text in zip(*[column.to_pylist() for column in batch.slice(at, _FILES_AT_ONCE).columns]):
                    start = time.perf_counter()
                    try:
                        made, error = process(path, text), None
                    except Exception as problem:  # the error is the result of the file
                        made, error = 0, str(problem)
                    out.append((job, path, error is None, made, error, (time.perf_counter() - start) * 1000))
                types = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*out), types)], names)

    names = ["job_id", "file_path", "success", "chunks_created", "error", "processing_time_ms"]
    schema = "job_id string, file_path string, success boolean, chunks_created int, error string, processing_time_ms double"
    return files.select(F.col("job_id").cast("string").alias("job_id"), "path", "text").mapInArrow(run, schema)


def write_results(results: DataFrame, path: str) -> dict[str, int | float]:
    """Write the result rows of ``process_files`` and return what was counted on the way.

    The totals are observed while the rows are written, so every file is
    processed once: files, failed files, chunks and milliseconds.
    """
    seen = Observation("ingest")
    watched = results.observe(
        seen, F.count(F.lit(1)).alias("files"), F.count(F.when(~F.col("success"), 1)).alias("failed"),
        F.coalesce(F.sum("chunks_created"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("processing_time_ms"), F.lit(0.0)).alias("milliseconds"),
    )
    watched.write.mode("overwrite").parquet(path)
    return seen.get


def job_status(results: DataFrame, *, shown: int = 10) -> DataFrame:
    """Totals, status and first errors of each job.

    The errors shown are cut to a top list first, so that a job with very many
    failures is not gathered.
    """
    from pyspark.sql import Window

    ok = F.col("success")
    count = lambda test: F.count(F.when(test, 1))
    sums = results.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_files"), count(ok).alias("processed_files"), count(~ok).alias("failed_files"),
        F.sum("chunks_created").alias("chunks_created"),
        *([F.sum("processing_time_ms").alias("processing_time_ms")] if "processing_time_ms" in results.columns else []),
    )
    first = Window.partitionBy("job_id").orderBy("file_path")
    failed = results.filter(~ok).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= shown)
    text = F.concat("file_path", F.lit(": "), "error")
    errors = failed.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("text")))), lambda e: e["text"]).alias("errors"))
    rows = sums.join(errors, "job_id", "left")
    return rows.withColumns(
        {
            "errors": F.coalesce("errors", F.expr("cast(array() as array<string>)")),
            "status": F.when(F.col("failed_files") == 0, "completed").otherwise("completed_with_errors"),
            "progress_percent": F.when(F.col("total_files") > 0, F.col("processed_files") / F.col("total_files") * 100).otherwise(0.0),
        }
    )


def read_documents(spark: SparkSession, folder: str, *, pattern: str = "*.txt", document_type: str = "code") -> DataFrame:
    """Extracted text files as documents, ready for chunking."""
    from groundplan.functions.text import document_key

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.substring_index("path", "/", -1)
    return rows.select(
        document_key(name).alias("document_id"), F.regexp_replace(name, r"\.[^.]*$", "").alias("document_name"),
        F.lit(document_type).alias("document_type"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "path",
    )
