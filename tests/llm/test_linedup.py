import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from groundplan.llm import linedup

SCHEMA = "doc_id long, text string, n_lines string"


def plain(rows, min_chars):
    """The same by loops: documents in order, every repeated run of lines by its content, however long."""
    seen, result = {}, {}
    for doc_id, text in rows:
        if text is None:
            result[doc_id] = (None, 0, 0)
            continue
        lines = text.split("\n")
        filled = [i for i, line in enumerate(lines) if line.strip(" \t\x0b\f\r")]
        gone = set()
        for k in range(len(filled)):
            chars, content = 0, []
            for last in range(k, len(filled)):
                chars += len(lines[filled[last]])
                content.append(lines[filled[last]])
                if chars >= min_chars:
                    if seen.setdefault(tuple(content), (doc_id, k)) != (doc_id, k):
                        gone |= set(filled[k : last + 1])
        rest = "" if filled and len(gone) == len(filled) else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        result[doc_id] = (rest, len(filled), len(gone))
    return result


def compare(spark, rows, min_chars):
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], SCHEMA).repartition(4)
    got = linedup.delete_repeated_runs(df, min_chars)
    assert got.columns == ["doc_id", "text", "n_lines", "n_deleted"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in got.collect()} == plain(rows, min_chars)


@pytest.mark.parametrize("seed,min_chars", [(1, 1), (2, 5), (3, 12), (4, 30)])
def test_random_short_lines(spark, seed, min_chars):
    rng = random.Random(seed)
    parts = [[rng.choice(["a", "b", "cc", "ddd", "", "  ", "e" * 9]) for _ in range(rng.randint(5, 40))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = [line for _ in range(rng.randint(0, 4)) for line in rng.choice(parts)[: rng.randint(1, 40)]]
        rows.append((i, "\n".join(lines)))
    compare(spark, rows, min_chars)


def test_hot_line_and_copies(spark):
    hot = "the same long first line of very many documents, again and again"
    rows = [(i, f"{hot}\nown text number {i} which is long enough to stand for itself alone") for i in range(400)]
    rows += [(i, "one copy of a text that is repeated\nin whole, line by line") for i in range(400, 600)]
    compare(spark, rows, 50)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "x" * 60), (5, "x" * 60), (6, "\r\n \t\n" + "x" * 60), (7, "short\nshort"), (8, "é" * 49 + "😀"), (9, "é" * 49 + "😀")]
    compare(spark, rows, 50)


def test_long_text_of_short_lines(spark):
    lines = [str(i % 7919 % 10) for i in range(30_000)]
    part = lines[5000:9000]
    df = spark.createDataFrame([(1, "\n".join(lines), "own"), (2, "\n".join(part), "own")], SCHEMA).repartition(4)
    got = {r.doc_id: r for r in linedup.delete_repeated_runs(df, 50).collect()}
    # the first document repeats itself with a period of 10 up to where 7919 breaks it
    def repeated(own, before):
        gone, heads = set(), {}
        for k in range(len(before) - 49):
            heads.setdefault(tuple(before[k : k + 50]), k)
        for k in range(len(own) - 49):
            if tuple(own[k : k + 50]) in heads and (own is not before or heads[tuple(own[k : k + 50])] < k):
                gone |= set(range(k, k + 50))
        return len(gone)
    assert got[1].n_deleted == repeated(lines, lines) and got[2].n_deleted == repeated(part, lines) == 4000


def test_repeated_rows_and_null_ids(spark):
    line = "a line with more than fifty characters, which is then repeated"
    rows = [(1, line), (1, line), (None, line), (2, line)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = sorted((r.doc_id or 0, r.text) for r in linedup.delete_repeated_runs(df).collect())
    assert got == [(0, line), (1, ""), (1, ""), (2, "")]
    assert linedup.delete_repeated_runs(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text"))
    plan = linedup.delete_repeated_runs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_whole(rows, min_chars):
    """Lines of maximal repeated runs by loops: the longest common prefix with any earlier suffix."""
    suffixes, gone = [], {i: set() for i, _ in rows}
    for doc_id, text in rows:
        lines = [line for line in text.split("\n") if line.strip(" \t\x0b\f\r")]
        for k in range(len(lines)):
            suffix = lines[k:]
            for other in suffixes:
                n = next((i for i, (a, b) in enumerate(zip(suffix, other)) if a != b), min(len(suffix), len(other)))
                if sum(map(len, suffix[:n])) >= min_chars:
                    gone[doc_id] |= set(range(k, k + n))
            suffixes.append(suffix)
    return {i: len(lines) for i, lines in gone.items()}


@pytest.mark.parametrize("seed,min_chars", [(1, 1), (2, 12), (3, 30)])
def test_whole_runs_at_random(spark, seed, min_chars):
    rng = random.Random(seed)
    parts = [[rng.choice(["a", "b", "cc", "ddd", "", "e" * 9, "f" * 29]) for _ in range(rng.randint(3, 20))] for _ in range(8)]
    rows = [(i, "\n".join(line for _ in range(rng.randint(1, 3)) for line in rng.choice(parts)[: rng.randint(1, 20)])) for i in range(40)]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], SCHEMA).repartition(4)
    got = linedup.delete_repeated_runs(df, min_chars)
    assert {r.doc_id: r.n_deleted for r in got.collect()} == plain_whole(rows, min_chars)


def test_short_line_at_the_end_of_a_run(spark):
    line = "a line of sixty characters, the head of a run that is repeat"
    rows = [(1, f"{line}\nAs.\nfirst end"), (2, f"{line}\nAs.\nother end"), (3, f"{line}\nAs.")]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], SCHEMA)
    got = {r.doc_id: r.text for r in linedup.delete_repeated_runs(df).collect()}
    assert got == {1: rows[0][1], 2: "other end", 3: ""}
    docs = df.drop("n_lines")
    assert sorted(r.text for r in corpus_pipeline.delete_repeated_lines(spark, docs, "").collect()) == sorted([rows[0][1], "other end"])


def test_pipeline_keeps_own_columns_of_the_counts(spark):
    df = spark.createDataFrame([(1, "some text", "seven", 3)], "doc_id long, text string, n_lines string, N_DELETED int")
    got = corpus_pipeline.delete_repeated_lines(spark, df, "").collect()
    assert [tuple(r) for r in got] == [(1, "some text", "seven", 3)] and got[0].__fields__ == ["doc_id", "text", "n_lines", "N_DELETED"]
