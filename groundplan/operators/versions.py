"""Report versions, sessions and follow-up questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.functions.text import content_hash
from groundplan.functions.words import strip
from groundplan.operators.running import running_totals

_TURNS_PER_PART = 1024


def number_versions(drafts: DataFrame, *, order: str = "created_at", bucket: Column | None = None) -> DataFrame:
    """Drafts (report_id, content, ...) with version number, id and content hash.

    Numbers follow ``order``; ``bucket`` cuts that order into parts, by default
    days, so that a report with very many versions is not ranked in one task.
    """
    part = F.to_date(order) if bucket is None else bucket
    rows = running_totals(drafts, ["report_id"], part, [F.col(order)], rank="version_number")
    return rows.withColumns(
        {
            "version_id": F.concat(F.col("report_id"), F.lit("_v"), F.col("version_number").cast("string")),
            "content_hash": content_hash(F.col("content")),
        }
    )


def next_versions(stored: DataFrame, drafts: DataFrame, *, order: str = "created_at", bucket: Column | None = None) -> DataFrame:
    """Drafts numbered on from the latest stored version of their report."""
    latest = stored.groupBy("report_id").agg(F.max("version_number").alias("_latest"))
    rows = number_versions(drafts, order=order, bucket=bucket).join(latest, "report_id", "left")
    number = F.col("version_number") + F.coalesce("_latest", F.lit(0))
    return rows.withColumn("version_number", number).withColumn(
        "version_id", F.concat(F.col("report_id"), F.lit("_v"), F.col("version_number").cast("string"))
    ).drop("_latest")


def latest_version(versions: DataFrame) -> DataFrame:
    """The newest version of each report, by a map-side maximum."""
    others = [c for c in versions.columns if c != "report_id"]
    best = versions.groupBy("report_id").agg(F.max_by(F.struct(*others), "version_number").alias("v"))
    return best.select("report_id", *[F.col(f"v.{c}").alias(c) for c in others])


def version(versions: DataFrame, report_id: str, number: int | None = None) -> DataFrame:
    rows = versions.filter(F.col("report_id") == report_id)
    return latest_version(rows) if number is None else rows.filter(F.col("version_number") == number)


def all_versions(versions: DataFrame, report_id: str) -> DataFrame:
    return versions.filter(F.col("report_id") == report_id).orderBy("version_number")


def version_history(versions: DataFrame) -> DataFrame:
    shown = ["report_id", "version_number", "created_at", "created_by", "changes", "content_hash"]
    return versions.select(*[c for c in shown if c in versions.columns]).orderBy("report_id", "version_number")


def headings(content: Column) -> Column:
    """Second level headings of a markdown text."""
    return F.transform(F.regexp_extract_all(content, F.lit(r"(?md)^##\s+(.+)$"), F.lit(1)), strip)


def section_bodies(content: Column) -> Column:
    """Heading and body of each second level section, as an array."""
    # cut ahead of each mark: a section is then one element, however long
    sections = F.filter(F.split(content, r"(?=##\s)"), lambda s: s.rlike(r"(?d)^##\s+[^\n]+\n"))
    title = lambda s: F.regexp_extract(s, r"(?d)^##\s+([^\n]+)\n", 1)
    head = lambda s: F.char_length(F.regexp_extract(s, r"(?d)^(##\s+[^\n]+\n)", 1))
    return F.transform(sections, lambda s: F.struct(title(s).alias("title"), strip(F.substring(s, head(s) + 1, F.char_length(s))).alias("body")))


def compare(pairs: DataFrame) -> DataFrame:
    """Sections added, removed and changed between old_content and new_content.

    All sections are compared inside the row of their pair.
    """
    rows = pairs.withColumns(
        {
            "_old": headings(F.col("old_content")), "_new": headings(F.col("new_content")),
            "_old_bodies": section_bodies(F.col("old_content")), "_new_bodies": section_bodies(F.col("new_content")),
        }
    )
    body = lambda bodies, title: F.get(F.filter(bodies, lambda b: b["title"] == title), F.lit(0))["body"]
    changed = lambda t: ~F.coalesce(body(F.col("_old_bodies"), t) == body(F.col("_new_bodies"), t), F.lit(False))
    return rows.withColumns(
        {
            "sections_added": F.filter("_new", lambda s: ~F.array_contains(F.col("_old"), s)),
            "sections_removed": F.filter("_old", lambda s: ~F.array_contains(F.col("_new"), s)),
            "sections_modified": F.filter("_old", lambda s: F.array_contains(F.col("_new"), s) & changed(s)),
        }
    ).drop("_old", "_new", "_old_bodies", "_new_bodies", "old_content", "new_content")


def compare_consecutive(versions: DataFrame) -> DataFrame:
    """Changes of each version against the one before, by an equality join."""
    old = versions.select("report_id", (F.col("version_number") + 1).alias("version_number"), F.col("content").alias("old_content"))
    new = versions.select("report_id", "version_number", F.col("content").alias("new_content"))
    return compare(new.join(old, ["report_id", "version_number"]))


def compare_with_latest(versions: DataFrame, old_number: int) -> DataFrame:
    old = versions.filter(F.col("version_number") == old_number).select("report_id", F.col("content").alias("old_content"))
    new = latest_version(versions).select("report_id", "version_number", F.col("content").alias("new_content"))
    return compare(new.join(old, "report_id"))


# --- conversations ------------------------------------------------------


def follow_up_questions(exchanges: DataFrame) -> DataFrame:
    """Questions with the exchange before them put in front.

    ``exchanges`` has conversation_id, exchange_no, question and answer. The
    exchange before is found by its number, not by a window over a whole
    conversation.
    """
    before = exchanges.select(
        "conversation_id", (F.col("exchange_no") + 1).alias("exchange_no"), F.col("question").alias("_question"),
        F.substring("answer", 1, V.FOLLOW_UP_ANSWER_CHARS).alias("_answer"),
    )
    rows = exchanges.join(before, ["conversation_id", "exchange_no"], "left")
    text = F.concat(
        F.lit("Context from previous question: "), "_question", F.lit("\nPrevious answer summary: "), "_answer",
        F.lit("\n\nFollow-up question: "), "question",
    )
    return rows.select("conversation_id", "exchange_no", F.coalesce(text, F.col("question")).alias("question"))


def number_exchanges(turns: DataFrame) -> DataFrame:
    """Question and answer pairs from turns (conversation_id, turn, role, text).

    Questions are numbered along the conversation; an answer belongs to the
    question last asked before it, and a repeated answer replaces the first.
    """
    asked = F.when(F.col("role") == "user", 1).otherwise(0)
    part = F.floor(F.col("turn") / _TURNS_PER_PART)
    rows = running_totals(turns, ["conversation_id"], part, [F.col("turn")], {"exchange_no": asked})
    text = lambda role: F.when(F.col("role") == role, F.col("text"))
    turn = lambda role: F.when(F.col("role") == role, F.col("turn"))
    pairs = rows.groupBy("conversation_id", F.col("exchange_no").cast("int").alias("exchange_no")).agg(
        F.max_by(text("user"), turn("user")).alias("question"), F.max_by(text("assistant"), turn("assistant")).alias("answer")
    )
    return pairs.filter(F.col("question").isNotNull()).withColumn("answer", F.coalesce("answer", F.lit("")))


def list_sessions(messages: DataFrame) -> DataFrame:
    """Sessions newest first with the size of both message lists.

    ``messages`` has session_id, saved_at and kind ('chat' or 'designer').
    """
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return (
        messages.groupBy("session_id")
        .agg(F.max("saved_at").alias("saved_at"), count("chat").alias("chat_count"), count("designer").alias("designer_count"))
        .orderBy(F.desc("saved_at"), "session_id")
    )
