"""Conversations as a prefix tree of turns: shared first turns are formatted, tokenized and emitted once.

A turn's node is named by running hashes over the turns up to it, so equal
beginnings give equal nodes without comparing texts. Each node belongs to the
smallest conversation that passes it; what a conversation owns is one stretch
at its end, its chain. Chains are laid out depth first in one sequence per
tree: after a chain come the chains that leave it, the deepest branch first.
A node knows its offset there, the position of its first token on the path from
the root, and the intervals of the sequence that hold its ancestors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundplan.llm.words import kept_in_worker
from groundplan.operators.running import running_totals
from groundplan.session import stored

VOCABULARY = "byte_bpe_50k.json"
TRAINED_ROLE = "assistant"
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
# turns of a conversation that are numbered together
_STRETCH = 1024
# turns that a task encodes or decodes at a time
_TOGETHER = 200
_PIECE = re.compile(r"### ((?:[^\\:]|\\.)*): (.*) </turn>\n", re.DOTALL)


def escape(text: Column) -> Column:
    """Text in which ### and </turn> cannot occur: a backslash before every backslash, number sign and slash after <."""
    return F.regexp_replace(text, r"[\\#]|(?<=<)/", r"\\$0")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), ":", r"\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, text = _PIECE.fullmatch(piece).groups()
    return unescape(role), unescape(text)


def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True  # their strings are ordinary text here
    return tokenizer


def format_turns(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Every turn with its place, node and token ids.

    Rows are (conv_id, turn, role, text); null roles and texts are empty. Turns
    go by ``turn``, then role and text; a repeated row is a turn of its own.
    ``path_start`` counts the tokens of the turns before, ``loss_from`` and
    ``loss_to`` bound the text to be trained on within the formatted turn.
    """
    file = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col(c) for c in ("turn", "role", "text")]
    rows = running_totals(rows, ["conv_id"], F.floor(F.col("turn") / _STRETCH), order, rank="pos")
    head, body = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(AFTER_ROLE)), escape(F.col("text"))
    trained = F.col("role") == TRAINED_ROLE
    rows = rows.select(
        "conv_id", "pos",
        F.xxhash64("pos", "role", "text").cast("decimal(20,0)").alias("_one"), F.xxhash64("text", "role", "pos").cast("decimal(20,0)").alias("_two"),
        F.when(trained, F.char_length(head)).cast("int").alias("loss_from"), F.when(trained, F.char_length(F.concat(head, body))).cast("int").alias("loss_to"),
        F.concat(head, body, F.lit(CLOSE)).alias("piece"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept_in_worker(f"tokenizer {file}", lambda: _tokenizer(file))
        for batch in batches:
            at = batch.schema.get_field_index("piece")
            for first in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(first, _TOGETHER)
                ids = [np.array(e.ids, "<u4") for e in tokenizer.encode_batch(part.column(at).to_pylist(), add_special_tokens=False)]
                kept = [part.column(i) for i in range(part.num_columns) if i != at]
                names = [n for n in part.schema.names if n != "piece"]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64())], [*names, "ids", "n_tokens"]
                )

    schema = rows.drop("piece").schema.add("ids", "binary").add("n_tokens", "long")
    rows = stored(rows.mapInArrow(encode, schema))
    sums = {"_a": F.col("_one"), "_b": F.col("_two"), "_tokens": F.col("n_tokens")}
    rows = running_totals(rows, ["conv_id"], F.floor(F.col("pos") / _STRETCH), [F.col("pos")], totals=sums)
    name = lambda pos, a, b: F.md5(F.concat_ws(",", pos, a, b))
    before = name(F.col("pos") - 1, F.col("_a") - F.col("_one"), F.col("_b") - F.col("_two"))
    return rows.select(
        "conv_id", "pos", name(F.col("pos"), F.col("_a"), F.col("_b")).alias("node"), F.when(F.col("pos") > 1, before).alias("parent"),
        "ids", "n_tokens", (F.col("_tokens") - F.col("n_tokens")).alias("path_start"), "loss_from", "loss_to",
    )


def _routes(chains: DataFrame) -> DataFrame:
    """Steps from the root chain to each chain, joining ever longer stretches of the way."""
    ways = stored(chains.select("conv_id", "up", F.array(F.struct((1 - F.col("first_pos")).alias("branch"), F.col("conv_id").alias("conv"), "taken")).alias("steps")))
    while ways.filter(F.col("up").isNotNull()).take(1):
        above = ways.select(F.col("conv_id").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        open_ways = ways.filter(F.col("up").isNotNull()).join(above, "up")
        longer = open_ways.select("conv_id", F.col("_up").alias("up"), F.concat("_steps", "steps").alias("steps"))
        ways = stored(ways.filter(F.col("up").isNull()).unionByName(longer))
    return ways.drop("up")


def build_tree(turns: DataFrame) -> DataFrame:
    """Nodes of all trees from stored ``format_turns`` rows, each once.

    ``tree`` is the conversation whose chain begins at the root. ``offset`` is the
    place of the node's first token in the depth-first sequence of the tree,
    ``position`` its place on the path; a token attends to the ``ancestors``
    intervals of the sequence and to its own node up to itself.
    """
    owners = turns.groupBy("node").agg(F.min("conv_id").alias("owner"))
    owned = stored(turns.join(owners, "node").filter(F.col("conv_id").eqNullSafe(F.col("owner"))).drop("owner"))
    chains = owned.groupBy("conv_id").agg(
        F.min("pos").alias("first_pos"), F.min_by("parent", "pos").alias("parent"), F.min("path_start").alias("first"), F.sum("n_tokens").alias("tokens")
    )
    chains = stored(chains.join(owners.select(F.col("node").alias("parent"), F.col("owner").alias("up")), "parent", "left").drop("parent"))
    starts = chains.select(F.col("conv_id").alias("up"), F.col("first").alias("_above"))
    chains = chains.join(starts, "up", "left").withColumn("taken", F.col("first") - F.col("_above"))
    laid = _routes(chains)
    size = chains.select(F.col("conv_id").alias("_conv"), "first", "tokens")
    laid = laid.join(size, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv").withColumn("tree", F.col("steps")[0]["conv"])
    laid = stored(laid.repartitionByRange("tree", "steps").withColumn("_range", F.spark_partition_id()))
    laid = stored(running_totals(laid, ["tree"], F.col("_range"), [F.col("steps")], totals={"_end": F.col("tokens")}).withColumn("start", F.col("_end") - F.col("tokens")))
    # of each chain above: where it starts, and how much of it lies on the way
    pairs = F.transform(F.sequence(F.lit(0), F.size("steps") - 2), lambda i: F.struct(i.alias("i"), F.get("steps", i)["conv"].alias("conv"), F.get("steps", i + 1)["taken"].alias("taken")))
    above = laid.filter(F.size("steps") > 1).select("conv_id", F.explode(pairs).alias("_step")).select("conv_id", "_step.*")
    placed = above.join(laid.select(F.col("conv_id").alias("conv"), "start"), "conv")
    spans = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "start", (F.col("start") + F.col("taken")).alias("end")))).alias("_spans"))
    spans = spans.select(F.col("conv_id").alias("_of"), F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("_spans"))
    nodes = owned.join(laid.select(F.col("conv_id").alias("_conv"), "tree", "start", "first"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    nodes = nodes.join(spans, F.col("conv_id") == F.col("_of"), "left").drop("_of")
    offset = F.col("start") + F.col("path_start") - F.col("first")
    own = F.when(offset > F.col("start"), F.array(F.struct(F.col("start").alias("start"), offset.alias("end"))))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return nodes.select(
        "tree", "node", "parent", F.col("pos").alias("depth"), offset.alias("offset"), F.col("path_start").alias("position"), "n_tokens",
        F.concat(F.coalesce("_spans", none), F.coalesce(own, none)).alias("ancestors"), "ids", "loss_from", "loss_to",
    )


def format_conversations(conversations: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of the prefix trees, and the path (conv_id, pos, node) of every conversation through them."""
    turns = stored(format_turns(conversations, vocabulary))
    return build_tree(turns), turns.select("conv_id", "pos", "node")


def read_back(nodes: DataFrame, paths: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digest of every conversation, from the tokens and loss masks of the nodes on its path.

    ``turns_sha256`` is over role, line end, text, line end of every turn,
    ``loss_chars`` and ``loss_sha256`` are of the unescaped text under the loss
    mask, ``formatted_chars`` counts the characters with markers and escapes. A
    conversation is read as a stream, so its length does not matter.
    """
    file = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = paths.join(nodes.select("node", "ids", "loss_from", "loss_to"), "node").select("conv_id", "pos", "ids", "loss_from", "loss_to")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept_in_worker(f"tokenizer {file}", lambda: _tokenizer(file))
        now: list | None = None
        done: list[tuple] = []

        def close() -> None:
            if now is not None:
                done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        def emit() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            batch = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)
            done.clear()
            return batch

        for batch in (b.slice(first, _TOGETHER) for b in batches for first in range(0, b.num_rows, _TOGETHER)):
            convs, ids, begins, ends = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            pieces = tokenizer.decode_batch([np.frombuffer(i, "<u4").tolist() for i in ids], skip_special_tokens=False)
            for conv, piece, begin, end in zip(convs, pieces, begins, ends):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_piece(piece)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[5] += len(piece)
                if begin is not None:
                    trained = unescape(piece[begin:end])
                    now[3] += len(trained)
                    now[4].update(trained.encode())
            yield emit()
        close()
        yield emit()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(digest, schema)
