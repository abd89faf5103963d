"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet in the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundplan.llm import decontam, langid, linedup, minhash, packing
from groundplan.session import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the network recognises."""
    return langid.keep_identified(docs)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of whole line runs, and documents of which nothing is left."""
    names = docs.columns
    # own columns called like the two counts step aside meanwhile
    own = [c for c in names if c.lower() in ("n_lines", "n_deleted")]
    for c in own:
        docs = docs.withColumnRenamed(c, f"_own_{c}")
    rest = linedup.delete_repeated_runs(docs).filter((F.col("n_deleted") == 0) | (F.col("n_lines") > F.col("n_deleted"))).drop("n_lines", "n_deleted")
    for c in own:
        rest = rest.withColumnRenamed(f"_own_{c}", c)
    counted = {"n_chars": F.char_length("text").cast("long")} if "n_chars" in names else {}
    return rest.withColumns(counted).select(*names)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group at a similarity of 0.8 on five-word shingles."""
    return minhash.keep_one_of_each(docs, size=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold items of the benchmark."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", delete_repeated_lines),
    ("minhash_near_dedup", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack_sequences),
]

# a trained network, approximate retrieval and a public tokenizer are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
