"""Deletion of repeated runs of lines, by a suffix array over line ids.

Every line of every document is a symbol (its hash), every document a string
of symbols. Prefix doubling sorts the suffixes: ranks by the first 2^j symbols
come from ranking the pairs (rank at p, rank at p + 2^j). Suffixes of one rank
form an interval whose common prefix has at least 2^j lines. A suffix leaves the
sort as soon as it stands alone, or as soon as its decisive prefix is ranked:
the fewest lines that hold ``min_chars`` characters. Whatever has a copy of that
prefix earlier in the collection is deleted; overlapping prefixes add up to the
maximal repeated runs, and the last one of a run goes on to where the copies
part: a prefix is followed line by line while what comes after its first line
holds fewer than ``min_chars`` characters; from there on the next prefix takes
over. All of it is DataFrame expressions, joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundplan.functions.words import let
from groundplan.operators.running import running_totals
from groundplan.session import stored

# characters that a repeated run holds at least
MIN_CHARS = 50
# ranges that the ranking of pairs is cut into
_RANGES = 1024
_PLACE = ["doc_id", "_text", "k"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _filled(line: Column) -> Column:
    """Lines with more than spaces, tabs and other ASCII blanks."""
    return line.rlike(r"[^ \t\x0B\f\r]")


def _needed(sizes: Column, k: Column, min_chars: int) -> Column:
    """How many lines from ``k`` on hold ``min_chars`` characters; null at the end of a text that has no more so many."""
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("lines"))
    step = lambda have, size: F.when(
        have["chars"] < min_chars, F.struct((have["chars"] + size).alias("chars"), (have["lines"] + 1).alias("lines"))
    ).otherwise(have)
    run = lambda: F.aggregate(
        F.slice(sizes, k + 1, min_chars), start, step, lambda have: F.when(have["chars"] >= min_chars, have["lines"])
    )
    return F.when(F.get(sizes, k) >= min_chars, F.lit(1)).otherwise(run())


def line_positions(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line that is not blank: its place (doc_id, hash of the text, number), id,
    the next line's id, and ``need``, the number of lines in its decisive prefix."""
    filled = F.filter(_lines(F.col("text")), _filled)
    rows = documents.select("doc_id", F.xxhash64("text").alias("_text"), filled.alias("_filled"))
    ids, sizes = F.transform("_filled", lambda line: F.xxhash64(line)), F.transform("_filled", lambda line: F.char_length(line))
    rows = rows.select("doc_id", "_text", ids.alias("_ids"), sizes.alias("_sizes"))
    each = F.transform(
        "_ids",
        lambda line, k: F.struct(line.alias("rank"), F.get("_ids", k + 1).alias("next"), _needed(F.col("_sizes"), k, min_chars).alias("need")),
    )
    return rows.select("doc_id", "_text", F.posexplode(each).alias("k", "_line")).select(*_PLACE, "_line.rank", "_line.next", "_line.need")


def _place() -> Column:
    return F.struct(*_PLACE)


def _later_copies(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Positions that are not the first of those with equal ``keys``: the later members of an interval."""
    groups = positions.groupBy(*keys).agg(F.min(_place()).alias("_first"), F.max(_place()).alias("_last"))
    repeated = groups.filter(F.col("_first") != F.col("_last")).drop("_last")
    return positions.join(repeated, keys).filter(_place() != F.col("_first")).select(*_PLACE, "need")


def _with_rank_at(here: DataFrame, there: DataFrame, distance: Column, name: str) -> DataFrame:
    """Rows of ``here`` with the rank that ``there`` has ``distance`` lines further on in the same text."""
    ahead = there.select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_same"), F.col("k").alias("_to"), F.col("rank").alias(name))
    match = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_same")) & (F.col("k") + distance == F.col("_to"))
    return here.join(ahead, match).drop("_doc", "_same", "_to")


def _ranked(pairs: DataFrame) -> DataFrame:
    """Suffixes with ``rank`` replaced by the place of (rank, next) among all such pairs that occur at two places or more."""
    groups = pairs.groupBy("rank", "next").agg(F.min(_place()).alias("_first"), F.max(_place()).alias("_last"))
    kinds = stored(groups.filter(F.col("_first") != F.col("_last")).select("rank", "next"))
    low, high = (float(x or 0) for x in kinds.agg(F.min("rank"), F.max("rank")).first())  # one row
    part = F.floor((F.col("rank").cast("double") - low) / ((high - low + 1) / _RANGES))
    order = running_totals(kinds, [], part, [F.col("rank"), F.col("next")], rank="_rank")
    return pairs.join(order, ["rank", "next"]).select(*_PLACE, F.col("_rank").alias("rank"), "need")


def _longer_prefixes(documents: DataFrame, min_chars: int) -> DataFrame:
    """Prefixes longer than the decisive one of which the lines after the first hold fewer than ``min_chars`` characters.

    ``need`` is the number of lines, ``rank`` the first line's id and ``_end`` a
    hash of all. There are at most as many as lines, and those at the ends of
    texts: a decisive prefix is no more than one line longer than the next one.
    """
    filled = F.filter(_lines(F.col("text")), _filled)
    rows = documents.select("doc_id", F.xxhash64("text").alias("_text"), filled.alias("_filled"))
    ids, sizes = F.transform("_filled", lambda line: F.xxhash64(line)), F.transform("_filled", lambda line: F.char_length(line))
    rows = rows.select("doc_id", "_text", ids.alias("_ids"), sizes.alias("_sizes"))
    needs = F.transform("_ids", lambda _, k: _needed(F.col("_sizes"), k, min_chars))
    rows = rows.select("doc_id", "_text", "_ids", needs.alias("_needs"))
    last = lambda k: F.coalesce(F.get("_needs", k + 1), F.size("_ids") - k)
    spans = F.transform("_needs", lambda need, k: F.when(last(k) > need, F.struct(k.alias("k"), (need + 1).alias("first"), last(k).alias("last"))))
    rows = rows.select("doc_id", "_text", "_ids", F.explode(F.array_compact(spans)).alias("_span"))
    rows = rows.select("doc_id", "_text", "_ids", F.col("_span.k").alias("k"), F.explode(F.sequence("_span.first", "_span.last")).alias("need"))
    run = F.slice("_ids", F.col("k") + 1, F.col("need"))
    return rows.select(*_PLACE, "need", F.get("_ids", F.col("k")).alias("rank"), F.xxhash64(run).alias("_end"))


def later_runs(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Prefixes with an earlier copy: place of the first line (doc_id, _text, k) and ``need``, the number of lines.

    Earlier means a smaller (doc_id, hash of the text, line). Rows equal in
    doc_id and text are one document. The prefixes cover every maximal repeated
    run to its end.
    """
    longer = _later_copies(_longer_prefixes(documents, min_chars), ["need", "rank", "_end"])
    return _later_prefixes(documents, min_chars).unionByName(longer)


def _later_prefixes(documents: DataFrame, min_chars: int) -> DataFrame:
    """Decisive prefixes with an earlier copy."""
    positions = line_positions(documents, min_chars)
    # prefixes are alike if they are as long and agree in what they begin and end with
    keys = ["need", "rank", "_end"]
    known = positions.filter(F.col("need") == 1).select(*_PLACE, "need", "rank", F.col("rank").alias("_end"))
    # longer prefixes, and the ends of texts, which are part of some
    short = F.coalesce(F.col("need") > 1, F.lit(True))
    pairs, depth = positions.filter(short & F.col("next").isNotNull()).distinct(), 2
    while True:
        suffixes = stored(_ranked(pairs))
        exact = suffixes.filter(F.col("need") == depth).withColumn("_end", F.col("rank"))
        # two overlapping prefixes of ``depth`` lines make up one of up to twice as many
        due = suffixes.filter((F.col("need") > depth) & (F.col("need") < 2 * depth))
        known = known.unionByName(exact).unionByName(_with_rank_at(due, suffixes, F.col("need") - depth, "_end"))
        if not suffixes.filter(F.col("need") >= 2 * depth).take(1):
            return _later_copies(known, keys)
        more = suffixes.filter(F.coalesce(F.col("need") >= 2 * depth, F.lit(True)))
        pairs = _with_rank_at(more, suffixes, F.lit(depth), "next")
        depth *= 2


def delete_repeated_runs(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents (doc_id, text and any others) without the later copies of repeated runs of lines.

    A run is deleted when it holds at least ``min_chars`` characters and the same
    lines stand one after another earlier on, in an earlier document by doc_id or
    higher up in the same one; the first copy stays. Runs go to their
    end, short lines included. Blank lines stay and do not part a run. ``text`` is
    the rest, '' when every filled line went; a null text stays null. Added are ``n_lines`` (filled lines) and ``n_deleted``.
    Rows equal in doc_id and text are one document and all get the same text;
    columns called like the two added ones are replaced.
    """
    runs = later_runs(documents, min_chars)
    gone = runs.groupBy("doc_id", "_text").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence("k", F.col("k") + F.col("need") - 1)))).alias("_gone")
    )
    own = [c for c in documents.columns if c.lower() not in ("n_lines", "n_deleted")]
    rows = documents.select(*own).withColumn("_hash", F.xxhash64("text"))
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_hash_of"), "_gone")
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_doc"]) & (rows["_hash"] == gone["_hash_of"]), "left")
    lines = _lines(F.col("text"))
    numbers = lambda lines: F.array_compact(F.transform(lines, lambda line, i: F.when(_filled(line), i)))

    def rest(lines: Column, filled: Column) -> Column:
        out = F.transform("_gone", lambda k: F.get(filled, k))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
        return F.when(F.size("_gone") == F.size(filled), F.lit("")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))

    cut = let(lines, lambda all_lines: let(numbers(all_lines), lambda filled: rest(all_lines, filled)))
    counted = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(lines, _filled)))
    return rows.select(
        *[F.when(F.col("_gone").isNull(), F.col("text")).otherwise(cut).alias(c) if c == "text" else F.col(c) for c in own],
        counted.cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_deleted"),
    )
