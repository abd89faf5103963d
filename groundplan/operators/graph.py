"""Reference graph between chunks: edges, neighbours, one-hop expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.operators.running import running_totals
from groundplan.operators.sizes import broadcast_if_small
from groundplan.session import cut_lineage

# primaries of a query that are numbered in one task
_RANKS_PER_PART = 4096


def edges_of(chunks: DataFrame, references: str = "references") -> DataFrame:
    """Distinct edges from chunks to the chunks they name."""
    rows = chunks.filter(F.col("chunk_id").isNotNull()).select(F.col("chunk_id").alias("src"), F.explode(references).alias("dst"))
    return rows.distinct()


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges with new ones added where absent."""
    return edges.unionByName(more).dropDuplicates(["src", "dst"])


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src string, dst string").parquet(path)


def graph_stats(edges: DataFrame) -> DataFrame:
    per_node = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return per_node.agg(F.count(F.lit(1)).alias("total_nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_edges"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Each node's references and referrers as rows; a node may have any number."""
    out = edges.select(F.col("src").alias("node"), F.lit("references").alias("direction"), F.col("dst").alias("neighbour"))
    return out.unionByName(
        edges.select(F.col("dst").alias("node"), F.lit("referenced_by").alias("direction"), F.col("src").alias("neighbour"))
    )


def degrees(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of references and referrers of every chunk, and whether it has any."""
    out = edges.groupBy(F.col("src").alias("chunk_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("chunk_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    rows = chunks.select("chunk_id").join(out, "chunk_id", "left").join(into, "chunk_id", "left").fillna(0)
    return rows.withColumn("has_references", F.col("out_degree") > 0)


def resolved_references(primaries: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct references of the primaries, from edges and from their own list, that exist; none to themselves.

    A primary stands once in a query, so that edges are made distinct and compared
    with the chunks before they meet the primaries, which are many more.
    """
    known = chunks.select(F.col("chunk_id").alias("ref_id"))
    links = edges.select(F.col("src").alias("chunk_id"), F.col("dst").alias("ref_id")).filter("chunk_id != ref_id")
    links = links.distinct().join(known, "ref_id", "left_semi")
    columns = ["query_id", "rank", "chunk_id", "ref_id"]
    pairs = primaries.select(columns[:3]).join(links, "chunk_id").select(columns)
    if "references" not in primaries.columns:
        return pairs
    own = primaries.select(*columns[:3], F.explode("references").alias("ref_id")).filter("chunk_id != ref_id")
    return pairs.unionByName(own.join(known, "ref_id", "left_semi")).distinct()


def _skipped(links: DataFrame) -> DataFrame:
    """Primaries (query_id, chunk_id) that an earlier one has fetched as a reference, from links (query_id, src, dst) to later primaries.

    A primary waits for the earlier ones that refer to it. In each round those
    that wait for none stand, what they refer to is skipped, and what the skipped
    refer to no longer waits for them. There are as many rounds as the longest
    chain of primaries that decide one another; only the links left are carried on.
    """
    links = cut_lineage(links)
    none, skipped = links.select("query_id", F.col("dst").alias("chunk_id")).limit(0), None
    while not links.isEmpty():
        key = lambda side, name: links.select("query_id", F.col(side).alias(name)).distinct()
        standing = key("src", "src").join(key("dst", "src"), ["query_id", "src"], "left_anti")
        now = cut_lineage(links.join(standing, ["query_id", "src"], "left_semi").select("query_id", F.col("dst").alias("chunk_id")).distinct())
        skipped = now if skipped is None else skipped.unionByName(now)
        gone = lambda name: now.select("query_id", F.col("chunk_id").alias(name))
        links = links.join(standing, ["query_id", "src"], "left_anti").join(gone("dst"), ["query_id", "dst"], "left_anti")
        links = cut_lineage(links.join(gone("src"), ["query_id", "src"], "left_anti"))
    return none if skipped is None else skipped


def expand(primaries: DataFrame, edges: DataFrame, chunks: DataFrame, *, max_depth: int = 1) -> DataFrame:
    """Primaries (query_id, rank, chunk_id) followed by the chunks they refer to.

    A primary already fetched, as such or as a reference, is skipped and adds
    nothing; a reference goes to the first primary that stands and names it. Whom
    to skip is settled for all queries at once, round by round, so a query may have
    any number of primaries. References of one primary are ordered by id.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    lists = ["references"] if "references" in primaries.columns else []
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    rows = primaries.select("query_id", "rank", text("chunk_id"), *[F.col(c).cast("array<string>").alias(c) for c in lists])
    rows = cut_lineage(rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n"))
    found = rows.select("query_id", "rank", "chunk_id", F.lit("primary").alias("role"), F.lit(None).cast("string").alias("referenced_from"))
    if max_depth > 0:
        refs = resolved_references(rows, edges.select(text("src"), text("dst")), chunks.select(text("chunk_id"))).filter("query_id IS NOT NULL")
        # which references are primaries of the query as well is found once, for the rounds and for the claims
        later = rows.select("query_id", F.col("chunk_id").alias("ref_id"), F.col("rank").alias("_rank"), F.lit(True).alias("_primary"))
        refs = cut_lineage(refs.join(later, ["query_id", "ref_id"], "left"))
        links = refs.filter(F.col("rank") < F.col("_rank")).select("query_id", F.col("chunk_id").alias("src"), F.col("ref_id").alias("dst"))
        skipped = broadcast_if_small(_skipped(links))
        found = found.join(skipped, ["query_id", "chunk_id"], "left_anti").select(found.columns)
        own = refs.join(skipped, ["query_id", "chunk_id"], "left_anti")
        # a reference that stands as a primary is there already
        fetched = own.filter(F.col("_primary")).join(skipped.withColumnRenamed("chunk_id", "ref_id"), ["query_id", "ref_id"], "left_semi")
        own = own.filter(F.col("_primary").isNull()).unionByName(fetched)
        claims = own.groupBy("query_id", "ref_id").agg(F.min(F.struct("rank", "chunk_id")).alias("_by"))
        found = found.unionByName(
            claims.select(
                "query_id", F.col("_by.rank").alias("rank"), F.col("ref_id").alias("chunk_id"), F.lit("reference").alias("role"),
                F.col("_by.chunk_id").alias("referenced_from"),
            )
        )
    order = [F.col("rank"), F.col("role"), F.col("chunk_id")]  # a primary comes ahead of its references
    bucket = F.floor(F.col("rank") / _RANKS_PER_PART)
    least, most = rows.agg(F.min(bucket), F.max(bucket)).first()
    if least == most:
        found = found.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    else:
        found = running_totals(found, ["query_id"], bucket, order, rank="position")
    score = F.when(F.col("role") == "reference", V.REFERENCE_SCORE).otherwise(1.0)
    return found.select("query_id", (F.col("position") - 1).cast("int").alias("position"), "chunk_id", "role", "referenced_from", score.alias("relevance_score"))


def expansion_counts(results: DataFrame) -> DataFrame:
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    return results.groupBy("query_id").agg(count("primary").alias("primary_count"), count("reference").alias("reference_count"))
