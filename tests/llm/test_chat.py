import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from groundplan.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, node string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own") for r in rows], SCHEMA).repartition(3)


def conversations(seed, count=60):
    """Conversations that leave one another at all depths."""
    rng = random.Random(seed)
    rows, known = [], [[]]
    for conv in range(count):
        turns = list(rng.choice(known))[: rng.randint(0, 6)]
        while len(turns) < rng.randint(1, 9) or not turns:
            turns.append((rng.choice(["user", "assistant", "system"]), rng.choice(["hi", "ok ### x", "</turn>", "a\\b", "", "é 😀\n", f"own {conv}"])))
        known.append(turns)
        rows += [(conv, i, *t) for i, t in enumerate(turns)]
    return rows


def plain(rows):
    result = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        n, whole, loss = result.get(conv, (0, "", ""))
        result[conv] = (n + 1, whole + f"{role or ''}\n{text or ''}\n", loss + (text or "" if role == "assistant" else ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {c: (n, sha(w), len(loss), sha(loss)) for c, (n, w, loss) in result.items()}


def digest(spark, rows):
    nodes, paths = chat.format_conversations(frame(spark, rows))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(nodes, paths).collect()}
    assert got == plain(rows)
    return nodes, paths


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_layout(spark, seed):
    rows = conversations(seed)
    nodes, paths = digest(spark, rows)
    nodes, paths = nodes.collect(), paths.collect()
    by_name = {n.node: n for n in nodes}
    prefixes = set()
    for conv in {r[0] for r in rows}:
        turns = tuple((r[2], r[3]) for r in sorted(rows) if r[0] == conv)
        prefixes |= {turns[: i + 1] for i in range(len(turns))}
    assert len(by_name) == len(nodes) == len(prefixes)
    for tree in {n.tree for n in nodes}:
        own = sorted((n for n in nodes if n.tree == tree), key=lambda n: n.offset)
        end, stack = 0, []
        for n in own:
            assert n.offset == end
            end += n.n_tokens
            while stack and stack[-1].node != n.parent:
                stack.pop()  # depth first: a branch is left for good
            assert bool(stack) == (n.parent is not None)
            assert n.position == sum(s.n_tokens for s in stack) and n.depth == len(stack) + 1
            seen = sorted(t for a in n.ancestors for t in range(a.start, a.end))
            assert seen == sorted(t for s in stack for t in range(s.offset, s.offset + s.n_tokens))
            stack.append(n)
    for p in paths:
        assert by_name[p.node].depth == p.pos


def test_control_strings_and_loss_mask(spark):
    marked = r"\### Assistant: </turn> ok"
    texts = [marked, "####", "<//turn>", "\\", "\\\\#", "<", "/", "<|endoftext|>", " lead and trail ", "\n", ""]
    rows = [(i, k, role, t) for i, t in enumerate(texts) for k, role in enumerate(["user", "assistant", "a:b# </turn>"])]
    nodes, _ = digest(spark, rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(chat.VOCABULARY))
    for n in nodes.collect():
        piece = tokenizer.decode(np.frombuffer(n.ids, "<u4").tolist(), skip_special_tokens=False)
        assert piece.count("###") == 1 and piece.count("</turn>") == 1
        assert (n.loss_from is not None) == (chat.parse_piece(piece)[0] == "assistant")


def test_long_conversation_and_shared_first_turn(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i % 7}") for i in range(3000)]
    rows += [(c, 0, "assistant", "turn 0") for c in range(2, 800)] + [(c, 1, "user", f"own {c}") for c in range(2, 800)]
    nodes, _ = digest(spark, rows)
    assert nodes.count() == 3000 + 798 and nodes.select("tree").distinct().count() == 1


def test_chain_of_branches(spark):
    rows = []
    for c in range(40):  # each leaves the one before one turn later
        rows += [(c, i, "user", f"branch {i}") for i in range(c)] + [(c, c, "assistant", f"end {c}")]
    nodes, _ = digest(spark, rows)
    assert max(len(n.ancestors) for n in nodes.collect()) >= 2


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, "user", "x"), (2, 0, "user", "x"), (None, 0, "assistant", "y" * 100_000), (3, 5, "user", "b"), (3, 5, "user", "a")]
    nodes, paths = chat.format_conversations(frame(spark, rows))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(nodes, paths).collect()}
    want = plain([r if r[1] is not None else (r[0], -1, *r[2:]) for r in rows if r[0] is not None])
    assert {c: g for c, g in got.items() if c is not None} == want and got[None][0] == 1 and got[None][2] == 100_000
    empty = frame(spark, rows).limit(0)
    nodes, paths = chat.format_conversations(empty)
    assert nodes.collect() == [] and chat.read_back(nodes, paths).collect() == []


def test_escape_is_native_and_reversible(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("\\#</turn>: \nx") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e")).collect():
        assert chat.unescape(r.e) == r.t and "##" not in r.e and "</" not in r.e
