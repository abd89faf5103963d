"""The chunk table: append, route, filter, list, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundplan.functions.words import strip
from groundplan.operators.running import running_totals
from groundplan.operators.sizes import broadcast_if_small
from groundplan.session import stored

FILTER_COLUMNS = ["document_type", "document_id", "clause_id", "content_type", "regulatory_strength"]


def add_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks, laid out by index and document type."""
    chunks.write.mode("append").partitionBy("target_index", "document_type").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All chunks; rows without chunk id only mark a partition as empty."""
    return spark.read.parquet(path).filter(F.col("chunk_id").isNotNull())


def all_collections(*collections: DataFrame) -> DataFrame:
    """Chunks of several collections as one table; absent columns are null."""
    first, *others = collections
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def matching(chunks: DataFrame, **equal: object) -> DataFrame:
    """Chunks whose columns equal the given values; None means no filter."""
    for name, value in equal.items():
        if name not in FILTER_COLUMNS:
            raise ValueError(f"cannot filter by {name}")
        if value is not None:
            chunks = chunks.filter(F.col(name) == F.lit(value))
    return chunks


def by_chunk_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id).limit(1)


def without_document(chunks: DataFrame, document_id: object) -> DataFrame:
    """Chunks of all indexes except those of one document."""
    return chunks.filter(F.col("document_id") != F.lit(document_id))


def delete_document(spark: SparkSession, path: str, document_id: str) -> None:
    """Remove a document from every index.

    Only the partitions that hold the document are written again, in one write
    that replaces them when it commits. A partition left without chunks keeps a
    row without chunk id, which ``read_chunks`` leaves out.
    """
    chunks = spark.read.parquet(path)
    layout = ["target_index", "document_type"]
    # the partitions are few; a join by shuffle would bring each of them whole into one task
    touched = stored(chunks.filter(F.col("document_id") == document_id).select(*layout).distinct())
    rest = chunks.join(broadcast_if_small(touched), layout, "left_semi").filter(~F.col("document_id").eqNullSafe(F.lit(document_id)) & F.col("chunk_id").isNotNull())
    marks = touched.select(*[F.col(f.name) if f.name in layout else F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema])
    kept = stored(rest.unionByName(marks))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*layout).parquet(path)


def list_documents(chunks: DataFrame) -> DataFrame:
    """Document catalogue with chunk counts."""
    return chunks.groupBy(F.coalesce(F.col("document_id").cast("string"), F.lit("unknown")).alias("document_id")).agg(
        F.min("document_name").alias("document_name"), F.min("document_type").alias("document_type"), F.count(F.lit(1)).alias("chunk_count")
    )


def document_samples(chunks: DataFrame, *, limit: int = 5, collections: int = 3, order: list[str] = ["chunk_id"]) -> DataFrame:
    """Up to ``limit`` chunks of each document, spread evenly over the collections."""
    each = max(1, limit // collections)
    inside = Window.partitionBy("document_id", "target_index").orderBy(*order)
    rows = chunks.withColumn("_n", F.row_number().over(inside)).filter(F.col("_n") <= each)
    whole = Window.partitionBy("document_id").orderBy("target_index", *order)
    return rows.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= limit).drop("_n")


# --- text dump ----------------------------------------------------------

_RULE = "─" * 80


def chunk_block(number: Column) -> Column:
    """One chunk as a headed text block."""
    title = F.coalesce(F.nullif("clause_title", F.lit("")), F.nullif("section_title", F.lit("")))
    page = F.coalesce(F.nullif("page_number", F.lit(0)), F.col("page_no")).cast("string")
    shown = lambda c: F.coalesce(c, F.lit("N/A"))
    return F.concat(
        F.lit(f"{_RULE}\nCHUNK "), number.cast("string"), F.lit(f"\n{_RULE}\nIndex: "), shown(F.col("target_index")),
        F.lit(" | Page: "), shown(page), F.lit(" | Clause: "), shown(F.col("clause_id")), F.lit(" | Type: "), shown(F.col("content_type")),
        F.lit("\n"), F.when(title.isNotNull(), F.concat(F.lit("Title: "), title, F.lit("\n"))).otherwise(""),
        F.lit(f"{_RULE}\n\n"), strip(F.col("text")), F.lit("\n\n"),
    )


def dump_blocks(chunks: DataFrame, *, order: list[str], bucket: Column | None = None) -> DataFrame:
    """The readable text of each document in pieces: document_id, document_name, piece, block.

    Piece 0 is the head, the others are the chunks along ``order``; ``bucket``, if
    given, must not decrease along it and cuts the numbering of long documents.
    Texts are never gathered, so a document may have any number of chunks.
    """
    keys = ["document_id", "document_name"]
    numbered = running_totals(chunks, keys, F.lit(0) if bucket is None else bucket, [F.col(c) for c in order], rank="piece")
    blocks = numbered.select(*keys, F.col("piece").cast("long").alias("piece"), chunk_block(F.col("piece")).alias("block"))
    counts = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    head = F.concat(F.lit("Document: "), "document_name", F.lit("\nTotal Chunks: "), F.col("n").cast("string"), F.lit("\n" + "=" * 80 + "\n\n"))
    return counts.select(*keys, F.lit(0).cast("long").alias("piece"), head.alias("block")).unionByName(blocks)


def dump_texts(blocks: DataFrame) -> DataFrame:
    """The whole readable text of each document from its ``dump_blocks``: document_id, document_name, text.

    For documents whose text a row can hold; ``write_dumps`` takes any.
    """
    pieces = F.array_sort(F.collect_list(F.struct("piece", "block")))
    return blocks.groupBy("document_id", "document_name").agg(F.array_join(F.transform(pieces, lambda p: p["block"]), "").alias("text"))


def write_dumps(chunks: DataFrame, path: str, *, order: list[str], bucket: Column | None = None) -> None:
    """Write each document's readable text into a folder named after it.

    Pieces are dealt out by range, so the files of a folder, in the order of their
    names, hold one document from its head on, split where it is long.
    """
    from groundplan.functions.text import safe_file_name

    blocks = dump_blocks(chunks, order=order, bucket=bucket)
    # each block ends with an empty line, of which the writer adds the end
    named = blocks.select(safe_file_name(F.col("document_name")).alias("document"), "document_id", "piece", F.expr("left(block, length(block) - 1)").alias("value"))
    laid = named.repartitionByRange("document", "document_id", "piece").sortWithinPartitions("document", "document_id", "piece")
    laid.select("document", "value").write.mode("overwrite").partitionBy("document").text(path)
