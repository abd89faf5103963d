import numpy as np
import pytest
from pyspark.sql import functions as F

from groundplan.operators import graph, keyword, parts, search, sizes, vectors
from groundplan.operators.context import assemble, source_blocks

CHUNK = "chunk_id int, embedding array<float>, target_index string, clause_id string"


def _vectors(seed, rows, size=8):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(rows, size)).astype(np.float32)
    made[10:40] = made[10]  # a group of copies
    return made


def _expected(queries, chunks, names, k, threshold, allowed=None):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(queries.astype(float)) @ unit(chunks.astype(float)).T, 12)
    out = set()
    for q, row in enumerate(scores):
        good = [i for i in range(len(row)) if row[i] >= threshold and (allowed is None or allowed(q, i))]
        kept = []
        for name in sorted(set(names)):
            mine = sorted((i for i in good if names[i] == name), key=lambda i: (-row[i], i))
            kept += mine[: 2 * k]
        for rank, i in enumerate(sorted(kept, key=lambda i: (-row[i], i))[:k], 1):
            out.add((q, i, rank, round(float(row[i]), 6)))
    return out


def _got(df):
    return {(r.query_id, r.chunk_id, r.rank, round(r.score, 6)) for r in df.collect()}


@pytest.fixture()
def corpus(frame):
    chunks = _vectors(1, 400)
    names = [("main", "section", "rule")[i % 3] for i in range(400)]
    clauses = [f"{i % 5}.{i % 4}" for i in range(400)]
    df = frame([(i, v.tolist(), names[i], clauses[i]) for i, v in enumerate(chunks)], CHUNK).repartition(7)
    queries = np.vstack([_vectors(2, 50), chunks[10:11]])
    asked = frame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id int, embedding array<float>")
    return queries, chunks, names, clauses, asked, df


def test_vector_search_equals_brute_force(corpus):
    queries, chunks, names, _, asked, df = corpus
    assert _got(vectors.vector_topk(asked, df, k=5)) == _expected(queries, chunks, names, 5, 0.3)


def test_vector_search_in_blocks_gives_the_same(corpus, monkeypatch):
    queries, chunks, names, _, asked, df = corpus
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(vectors, "_SCORES", 64)
    assert _got(vectors.vector_topk(asked, df, k=5)) == _expected(queries, chunks, names, 5, 0.3)


def test_vector_search_below_clauses(corpus, frame):
    queries, chunks, names, clauses, asked, df = corpus
    within = frame([(q, str(q % 5)) for q in range(30)] + [(q, f"{q % 5}.1") for q in range(30, 51)], "query_id int, clause string")
    allowed = lambda q, i: clauses[i].split(".")[0] == str(q % 5) if q < 30 else clauses[i] == f"{q % 5}.1"
    got = _got(vectors.vector_topk(asked, df, k=5, within=within))
    assert got == _expected(queries, chunks, names, 5, 0.3, allowed)


def test_no_query_gives_no_result(corpus):
    *_, asked, df = corpus
    assert vectors.vector_topk(asked.filter("query_id < 0"), df).count() == 0


def test_lone_keyword_hit_gets_a_reciprocal_rank(frame):
    semantic = frame([(1, 1, 0.8), (1, 2, 0.0)], "query_id int, chunk_id int, score double")
    hits = frame([(1, 1, 4), (1, 2, 2), (1, 3, 4)], "query_id int, chunk_id int, hits int")
    rows = {r.chunk_id: r for r in search.fuse(semantic, hits).collect()}
    assert rows[1].combined_score == pytest.approx(0.7 * 0.8 + 0.3)
    assert rows[2].semantic_score == pytest.approx(1 / 63) and rows[2].combined_score == pytest.approx(0.7 / 63 + 0.15)


def test_keyword_scores_with_stored_postings(frame):
    chunks = frame([(1, "soil soil load"), (2, "soil test"), (3, "none")], "chunk_id int, text string")
    queries = frame([(7, "Soil soil load")], "query_id int, text string")
    direct = search.keyword_scores(search.keyword_hits(queries, chunks)).orderBy("chunk_id").collect()
    kept = search.keyword_scores(search.keyword_hits(queries, chunks, stored=search.postings(chunks))).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.hits, r.keyword_score) for r in direct] == [(1, 5, 1.0), (2, 2, 0.4)]
    assert [(r.chunk_id, r.hits) for r in kept] == [(1, 5), (2, 2)]


def test_shuffle_join_gives_the_same_keyword_scores(frame, monkeypatch):
    from groundplan.operators import sizes

    chunks = frame([(i, "soil " * (i % 7) + f"w{i}") for i in range(50)], "chunk_id int, text string")
    queries = frame([(1, "soil wx")], "query_id int, text string")
    small = search.keyword_hits(queries, chunks).collect()
    monkeypatch.setattr(search, "broadcast_if_small", lambda df, n=0: sizes.broadcast_if_small(df, 0))
    assert sorted(search.keyword_hits(queries, chunks).collect()) == sorted(small)


def test_second_stage_scores(frame):
    queries = frame([(1, "soil")], "query_id int, text string")
    chunks = frame([(1, "a"), (2, "abc"), (3, "ab")], "chunk_id int, text string")
    first = frame([(1, 1, 0.9, 1), (1, 2, 0.8, 2), (1, 3, 0.7, 3)], "query_id int, chunk_id int, combined_score double, rank int")
    out = search.second_stage(first, queries, chunks, F.length("chunk_text").cast("double"), k=2)
    assert [(r.chunk_id, r.rank) for r in out.orderBy("rank").collect()] == [(2, 1), (3, 2)]
    assert search.second_stage(first, queries, chunks, None, k=1).first().chunk_id == 1
    assert search.result_scores(out).first().score == 3.0


def test_embedding_job_computes_each_text_once(spark, frame):
    texts = frame([(1, "a b"), (2, "a b"), (3, "c")], "id int, text string")
    empty = spark.createDataFrame([], "key string, value array<double>, created_at timestamp, expires_at timestamp, access_count bigint, last_accessed timestamp")
    made, added = vectors.embed_texts(texts, empty, vectors.word_hash_encoder(16), as_of="2024-01-01 00:00:00")
    assert added.count() == 2
    rows = {r.id: r.embedding for r in made.collect()}
    assert rows[1] == rows[2] and sum(x * x for x in rows[1]) == pytest.approx(1.0)
    again, more = vectors.embed_texts(texts, added, vectors.word_hash_encoder(16), as_of="2024-01-02 00:00:00")
    assert more.count() == 0 and {r.id: r.embedding for r in again.collect()} == rows
    late = vectors.embed_texts(texts, added, vectors.word_hash_encoder(16), as_of="2024-02-02 00:00:00")[1]
    assert late.count() == 2


def test_normalised(frame):
    got = frame([([3.0, 4.0],)], "v array<double>").select(vectors.normalised(F.col("v")).alias("v")).first().v
    assert got == [0.6, 0.8]


# --- graph --------------------------------------------------------------


@pytest.fixture()
def linked(frame):
    chunks = frame(
        [("rule_6.1.2", "6.1.2", "Flexure", 40, "rule", ["table_6.1", "eq_6.1"]), ("rule_6.1.3", "6.1.3", "Shear", 41, "rule 2", ["table_6.1", "lost"]),
         ("table_6.1", "6.1.1", "Strength", 37, "table", []), ("eq_6.1", "6.1.2", "Equation", 40, "eq", ["rule_6.1.3"])],
        "chunk_id string, clause_id string, clause_title string, page_number int, text string, references array<string>",
    )
    return chunks, graph.edges_of(chunks)


def test_expansion_shares_a_reference(frame, linked):
    chunks, edges = linked
    primaries = frame([(1, 1, "rule_6.1.2"), (1, 2, "rule_6.1.3")], "query_id int, rank int, chunk_id string")
    rows = graph.expand(primaries, edges, chunks).orderBy("position").collect()
    assert [(r.chunk_id, r.role, r.referenced_from) for r in rows] == [
        ("rule_6.1.2", "primary", None), ("eq_6.1", "reference", "rule_6.1.2"), ("table_6.1", "reference", "rule_6.1.2"), ("rule_6.1.3", "primary", None),
    ]
    assert [r.relevance_score for r in rows] == [1.0, 0.8, 0.8, 1.0]
    counts = graph.expansion_counts(graph.expand(primaries, edges, chunks)).first()
    assert (counts.primary_count, counts.reference_count) == (2, 2)


def test_primary_fetched_as_reference_is_skipped(frame, linked):
    chunks, edges = linked
    primaries = frame([(1, 1, "eq_6.1"), (1, 2, "rule_6.1.3")], "query_id int, rank int, chunk_id string")
    rows = graph.expand(primaries, edges, chunks).orderBy("position").collect()
    assert [(r.chunk_id, r.role) for r in rows] == [("eq_6.1", "primary"), ("rule_6.1.3", "reference")]
    bare = graph.expand(primaries, edges, chunks, max_depth=0).collect()
    assert {(r.chunk_id, r.role) for r in bare} == {("eq_6.1", "primary"), ("rule_6.1.3", "primary")}


def test_edges(spark, frame, tmp_path):
    edges = frame([("chunk_1", "chunk_2"), ("chunk_1", "chunk_3")], "src string, dst string")
    more = graph.add_edges(edges, frame([("chunk_1", "chunk_2"), ("chunk_3", "chunk_2")], "src string, dst string"))
    graph.write_edges(more, str(tmp_path / "edges"))
    back = graph.read_edges(spark, str(tmp_path / "edges"))
    stats = graph.graph_stats(back).first()
    assert (stats.total_nodes, stats.total_edges) == (2, 3)
    into = graph.neighbours(back).filter("node = 'chunk_2' and direction = 'referenced_by'").collect()
    assert {r.neighbour for r in into} == {"chunk_1", "chunk_3"}


def test_context(frame, linked):
    chunks, edges = linked
    primaries = frame([(1, 1, "rule_6.1.2")], "query_id int, rank int, chunk_id string")
    rows = graph.expand(primaries, edges, chunks).join(chunks.drop("references"), "chunk_id").withColumn("query", F.lit("Q"))
    text = assemble(rows).first().context
    assert text.startswith("Query: Q\n\n## Retrieved Engineering Knowledge\n\n### [6.1.1] Strength (Page 37)\n[REFERENCED]:\ntable\n\n### [6.1.2] Flexure (Page 40)\n[PRIMARY]:\nrule\n\n[REFERENCED]:\neq\n\n")
    assert text.endswith("provided Clause IDs and Page Numbers.\n")
    blocks = frame([(1, 1, "D", None, 3, "t"), (1, 2, None, "S", None, "u")], "query_id int, rank int, document_name string, section_title string, page_number int, text string")
    assert source_blocks(blocks).first().context == "[Source: D | Section: N/A | Page: 3]\nt\n\n---\n\n[Source: Unknown | Section: S | Page: N/A]\nu"


def test_vectors_meet_only_their_own_length(frame):
    asked = frame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0])], "query_id int, embedding array<double>")
    chunks = frame([("a", [1.0, 0.0]), ("b", [0.0, 0.0, 0.0, 1.0]), ("c", [2.0, 0.0, 0.0, 0.0])], "chunk_id string, embedding array<double>")
    got = {(r.query_id, r.chunk_id, round(r.score, 6)) for r in vectors.vector_topk(asked, chunks, k=2, threshold=0.0).collect()}
    assert got >= {(1, "a", 1.0), (2, "c", 1.0)} and all((q, c) in {(1, "a"), (2, "b"), (2, "c")} for q, c, _ in got)


def test_repeated_query_ids_over_many_blocks(spark, frame, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 10)
    asked = spark.range(60).selectExpr("cast(1 as int) query_id", "array(cast(id as double) + 1, 1D) embedding")
    chunks = frame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    got = vectors.vector_topk(asked, chunks, k=1, threshold=0.0).collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, "a")]


def test_a_hundred_clauses_of_one_query(frame):
    asked = frame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    chunks = frame([(f"c{i}", [1.0, float(i)], f"{i}.1") for i in range(200)], "chunk_id string, embedding array<double>, clause_id string")
    within = frame([(1, str(i)) for i in range(50, 150)], "query_id int, clause string")
    got = {r.chunk_id for r in vectors.vector_topk(asked, chunks, k=200, threshold=0.0, within=within).collect()}
    assert got == {f"c{i}" for i in range(50, 150)}


def test_broadcast_is_bounded_by_bytes(spark):
    texts = spark.range(100).selectExpr("repeat('x', 1000) AS t")
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(sizes.broadcast_if_small(texts)) and "broadcast" not in plan(sizes.broadcast_if_small(texts, max_bytes=50_000))


def test_rank_fusion_asks_every_item(spark):
    from groundplan.plans.search_queries import REGISTRY

    folder = "/root/testdata/sf0.001"
    items = {r.item_id for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    assert {r.query_id for r in REGISTRY.plans["rank_fusion"](spark, folder).collect()} == items


def test_many_queries_with_a_hundred_clauses_each(spark):
    """20,000 queries, each limited to 100 of 1,000 clauses; the nearest allowed chunk is known by its angle."""
    chunks = spark.range(4000).selectExpr("id AS chunk_id", "array(cos(id * 0.0003), sin(id * 0.0003)) AS embedding", "concat(id % 1000, '.1') AS clause_id")
    asked = spark.range(20_000).selectExpr("id AS query_id", "array(cos(id * 0.00005), sin(id * 0.00005)) AS embedding")
    within = asked.selectExpr("query_id", "explode(sequence(0, 99)) AS n").selectExpr("query_id", "cast((query_id + n * 10) % 1000 AS string) AS clause")
    rows = vectors.vector_topk(asked, chunks, k=1, threshold=0.0, within=within).collect()
    assert len(rows) == 20_000
    for r in rows[::97]:
        allowed = [c for c in range(4000) if (c % 1000 - r.query_id) % 10 == 0]
        least = min(abs(c * 0.0003 - r.query_id * 0.00005) for c in allowed)
        assert abs(r.chunk_id * 0.0003 - r.query_id * 0.00005) == pytest.approx(least, abs=1e-6) and r.chunk_id in allowed


def test_many_parts_and_long_clause_lists_give_the_same(corpus, frame, monkeypatch):
    queries, chunks, names, clauses, asked, df = corpus
    monkeypatch.setattr(vectors, "PART_BYTES", 400)
    monkeypatch.setattr(parts, "PARTS_PER_MERGE", 5)
    monkeypatch.setattr(vectors, "_CLAUSES_PER_ROW", 2)
    assert _got(vectors.vector_topk(asked, df, k=5)) == _expected(queries, chunks, names, 5, 0.3)
    within = frame([(q, f"{a}.{b}") for q in range(51) for a in range(3) for b in range(4)], "query_id int, clause string")
    got = _got(vectors.vector_topk(asked, df, k=5, within=within))
    assert got == _expected(queries, chunks, names, 5, 0.3, lambda q, i: int(clauses[i].split(".")[0]) < 3)


def test_vector_search_plans_without_the_driver():
    import inspect

    text = inspect.getsource(vectors) + inspect.getsource(parts)
    assert "toArrow" not in text and ".collect()" not in text and "broadcast" not in text


def _plain_hits(queries, chunks):
    """Hits of all pairs by counting words."""
    import re

    from groundplan import fixed_values as V

    tokens = lambda t: [w for w in re.split(r"[^\w]+", (t or "").lower()) if re.fullmatch("[a-z]{2,}", w) and w not in V.STOP_WORDS]
    return {q: {c: n for c, text in chunks if (n := sum(tokens(text).count(t) for t in tokens(asked)))} for q, asked in queries}


def _made_chunks(count, seed=3):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)])
    share = 1 / np.arange(1, 151)
    texts = [" ".join(rng.choice(words, rng.integers(0, 60), p=share / share.sum())) for _ in range(count)]
    return [(i, t) for i, t in enumerate(texts)], [(i, " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(40)]


@pytest.mark.parametrize("k", [1, 3, 20, 1000])
def test_keyword_topk_equals_counting_all_pairs(frame, monkeypatch, k):
    monkeypatch.setattr(keyword, "PART_BYTES", 20_000)
    monkeypatch.setattr(keyword, "BLOCK", 4)
    monkeypatch.setattr(parts, "PARTS_PER_MERGE", 2)
    chunks, queries = _made_chunks(400)
    chunks.append((400, None))
    hits = _plain_hits(queries, chunks)
    got = search.keyword_topk(frame(queries, "query_id int, text string"), frame(chunks, "chunk_id int, text string"), k=k).collect()
    want = {q: sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k] for q, found in hits.items()}
    rows = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        rows.setdefault(r.query_id, []).append((r.chunk_id, r.hits))
        assert r.keyword_score == r.hits / want[r.query_id][0][1]
    assert rows == {q: w for q, w in want.items() if w}


def test_pruning_leaves_most_postings_unread():
    """The search over blocks is checked term by term above; here it reads fewer postings than there are."""
    import pyarrow as pa

    size = 20_000
    rows = pa.table({"chunk_id": np.arange(size), "tokens": [["rare", "common"] if i % 2000 == 0 else ["common"] for i in range(size)],
                     "counts": [[50, 1] if i % 2000 == 0 else [1] for i in range(size)]})
    index = keyword._Index(rows)
    found, hits = index.best(["common", "rare"], [1, 1], 5)
    assert found.tolist() == [0, 2000, 4000, 6000, 8000] and set(hits.tolist()) == {51} and not index.sums.any()


def test_fusion_over_an_index_equals_fusion_over_all_hits(frame):
    chunks, queries = _made_chunks(120, 5)
    asked, held = frame(queries, "query_id int, text string"), frame(chunks, "chunk_id int, text string")
    rng = np.random.default_rng(8)
    near = [(q, int(c), round(float(rng.choice([0.0, 0.4, 0.7])), 6)) for q, _ in queries for c in rng.choice(120, 12, replace=False)]
    semantic = frame(near, "query_id int, chunk_id int, score double")
    shown = lambda df: {(r.query_id, r.chunk_id, round(r.semantic_score, 9), round(r.keyword_score, 9), round(r.combined_score, 9), r.rank) for r in df.collect()}
    assert shown(search.fuse_indexed(semantic, asked, held, k=8)) == shown(search.fuse(semantic, search.keyword_hits(asked, held), k=8))


def test_postings_and_keyword_search_shuffle_no_pairs(frame):
    chunks, queries = _made_chunks(50)
    asked, held = frame(queries, "query_id int, text string"), frame(chunks, "chunk_id int, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(search.postings(held))
    import re

    exchanges = re.findall(r"hashpartitioning\(([^)]*)\)", plan(search.keyword_topk(asked, held)))
    assert exchanges and not any("query_id" in e and "chunk_id" in e for e in exchanges)


def _plain_expansion(primaries, refs):
    found, seen = [], set()
    for p in primaries:
        if p in seen:
            continue
        found.append((p, None))
        seen.add(p)
        for r in sorted(refs.get(p, ())):
            if r not in seen:
                found.append((r, p))
                seen.add(r)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_expansion_equals_a_plain_loop(frame, seed):
    rng = np.random.default_rng(seed)
    edges = sorted({(f"c{a}", f"c{b}") for a, b in rng.integers(0, 40, (90, 2))} | {("c1", "gone")})
    refs = {}
    for a, b in edges:
        if b != "gone":
            refs.setdefault(a, []).append(b)
    primaries = {q: [f"c{i}" for i in rng.integers(0, 40, 30)] for q in range(5)}
    df = frame([(q, n + 1, c) for q, own in primaries.items() for n, c in enumerate(own)], "query_id int, rank int, chunk_id string")
    chunks = frame([(f"c{i}",) for i in range(40)], "chunk_id string")
    got = graph.expand(df, frame(edges, "src string, dst string"), chunks).orderBy("query_id", "position").collect()
    for q, own in primaries.items():
        mine = [(r.position, r.chunk_id, r.referenced_from) for r in got if r.query_id == q]
        assert mine == [(i, *x) for i, x in enumerate(_plain_expansion(own, refs))]


def test_expansion_of_a_hundred_thousand_primaries(spark):
    count = 100_000
    primaries = spark.range(count).selectExpr("1 AS query_id", "cast(id + 1 as int) AS rank", "cast(id * 7 % 100003 as string) AS chunk_id")
    edges = spark.range(150_000).selectExpr("cast(id as string) AS src", "cast(id * 31 % 150000 as string) AS dst").filter("src != dst")
    chunks = spark.range(150_000).selectExpr("cast(id as string) AS chunk_id")
    got = graph.expand(primaries, edges, chunks).orderBy("position").collect()
    refs = {str(i): [str(i * 31 % 150_000)] for i in range(150_000) if i * 31 % 150_000 != i}
    assert [(r.chunk_id, r.referenced_from) for r in got] == _plain_expansion([str(i * 7 % 100_003) for i in range(count)], refs)


def test_many_queries_meet_the_chunks_in_slices(frame, monkeypatch):
    from groundplan.operators import vectors

    monkeypatch.setattr(vectors, "_MANY_QUERIES", 40)
    rng = np.random.default_rng(5)
    held, asked = np.round(rng.normal(size=(700, 4)), 1), rng.normal(size=(150, 4))
    held[100:130] = held[7]  # copies, which tie
    chunks = frame([(i, v.tolist(), "abc"[i % 3]) for i, v in enumerate(held)], "chunk_id int, embedding array<double>, target_index string")
    queries = frame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, embedding array<double>")
    assert vectors._dealt(queries, chunks)[1] > 1
    got = [tuple(r) for r in vectors.vector_topk(queries, chunks, k=4).orderBy("query_id", "rank").select("query_id", "rank", "chunk_id").collect()]
    scores = np.round((asked / np.linalg.norm(asked, axis=1)[:, None]) @ (held / np.linalg.norm(held, axis=1)[:, None]).T, 12)
    want = [(q, r + 1, int(c)) for q in range(150) for r, c in enumerate(np.lexsort((np.arange(700), -scores[q]))[:4]) if scores[q, c] >= 0.3]
    assert got == want


@pytest.mark.parametrize("columns", [50, 640, 4096])
def test_best_of_a_block_is_bounded_by_maxima(columns):
    from groundplan.operators import vectors

    scores = np.round(np.random.default_rng(columns).normal(size=(30, columns)), 2)
    rows, places, found = vectors._best(scores, 0.3, 5)
    want = [(q, int(c)) for q in range(30) for c in np.lexsort((np.arange(columns), -scores[q]))[:5] if scores[q, c] >= 0.3]
    assert list(zip(rows.tolist(), places.tolist())) == want and (found == scores[rows, places]).all()


def _passed_by(monkeypatch, queries, chunks, batch, threshold, count, **sizes):
    """Ids and scores of the chunks that ``_Asked`` keeps while chunks pass by in batches."""
    import pyarrow as pa

    for name, value in sizes.items():
        monkeypatch.setattr(vectors, name, value)
    rows = pa.table({"query_id": pa.array(range(len(queries))), "query_vector": pa.array(queries.tolist(), pa.list_(pa.float64()))})
    asked = vectors._Asked(rows, queries.shape[1], threshold, count)
    for at in range(0, len(chunks), batch):
        ids = pa.array(range(at, min(at + batch, len(chunks))))
        asked.meet(pa.table({"chunk_id": ids, "target_index": pa.array(["main"] * len(ids))}), vectors._unit(chunks[at : at + batch]))
    rows = [r for b in asked.found(0) for r in b.to_pylist()]
    return [(r["query_id"], r["chunk_id"], r["score"]) for r in rows]


@pytest.mark.parametrize("threshold, count, sizes", [
    (0.3, 5, {}), (0.3, 5, {"_SCREEN_QUERIES": 7, "_SCREEN_CHUNKS": 32, "_PAIRS": 10, "_ROWS_OUT": 9}), (-1.0, 300, {}), (0.0, 3, {"_SPARE_IDS": -100_000, "_SCREEN_CHUNKS": 64}),
])
def test_chunks_that_pass_by_leave_the_best(monkeypatch, threshold, count, sizes):
    """Also with many ties, zero vectors, scores that all pass and scores that differ by less than single precision tells."""
    rng = np.random.default_rng(11)
    queries, chunks = np.round(rng.normal(size=(60, 6)), 1), np.round(rng.normal(size=(900, 6)), 1)
    chunks[200:500] = chunks[7]
    chunks[600:700] = np.abs(chunks[600:700])
    chunks[700:750] = chunks[600] + 1e-9 * rng.normal(size=(50, 6))
    chunks[[3, 800]], queries[5] = 0.0, 0.0
    queries[:20] = np.abs(queries[:20])
    got = _passed_by(monkeypatch, queries, chunks, 130, threshold, count, **sizes)
    scores = np.round(vectors._unit(queries) @ vectors._unit(chunks).T, 12)
    want = [(q, int(c)) for q in range(60) for c in np.lexsort((np.arange(900), -scores[q]))[:count] if scores[q, c] >= threshold]
    assert [(q, c) for q, c, _ in got] == want and all(abs(s - scores[q, c]) < 1e-11 for q, c, s in got)


def test_many_queries_of_odd_kinds_equal_brute_force(frame, monkeypatch):
    """Repeated and null ids, equal rows, vectors of other lengths, empty and null ones and such with NaN."""
    rng = np.random.default_rng(3)
    chunks = [(None if i % 97 == 5 else f"c{i:03d}", None if i % 50 == 3 else [] if i % 50 == 4 else rng.normal(size=4 if i % 3 else 5).round(1).tolist()) for i in range(300)]
    chunks[8] = ("c008", [float("nan")] * 4)
    asked = [(None if i % 60 == 7 else i // 2, None if i % 40 == 9 else rng.normal(size=4 if i % 4 else 5).round(1).tolist()) for i in range(240)]
    asked += asked[:30] + [(500, [1.0, float("nan"), 0.0, 0.0])]
    df = lambda rows, name: frame(rows, f"{name} {'string' if name == 'chunk_id' else 'int'}, embedding array<double>")
    few = vectors.vector_topk(df(asked, "query_id"), df([c for c in chunks if c[0] is not None], "chunk_id"), k=4, threshold=0.2)
    monkeypatch.setattr(vectors, "_MANY_QUERIES", 40)
    monkeypatch.setattr(vectors, "_LEAST_PART_BYTES", 1_000)
    assert vectors._dealt(df(asked, "query_id"), df(chunks, "chunk_id"), 4)[1] > 1
    many = vectors.vector_topk(df(asked, "query_id"), df([c for c in chunks if c[0] is not None], "chunk_id"), k=4, threshold=0.2)
    rows = lambda found: sorted(repr((r.query_id, r.rank, r.chunk_id, r.target_index, round(r.score, 9))) for r in found.collect())
    assert rows(many) == rows(few) and len(rows(few)) > 400
    assert vectors.vector_topk(df(asked, "query_id"), df(chunks, "chunk_id"), k=4, threshold=0.2).filter("chunk_id is null").count() > 0


def test_each_slice_has_a_task_and_every_query_is_held_once(spark):
    """Slices that share a task by chance of a hash leave cores idle; queries sent to every part of the chunks grow with both."""

    class Counted:
        def __init__(self, rows):
            self.part, self.held, self.passed = rows.column("part")[0].as_py(), rows.num_rows, 0

        def meet(self, rows):
            self.passed += rows.num_rows

        def found(self):
            import pyarrow

            yield pyarrow.RecordBatch.from_pydict({"part": [self.part], "held": [self.held], "passed": [self.passed]})

    asked, chunks = spark.range(4_000).withColumnRenamed("id", "query_id"), spark.range(500).withColumnRenamed("id", "chunk_id")
    count = lambda n, slices: parts.pass_by(asked, chunks, "chunk_id", n, slices, lambda rows: Counted(rows), "part long, held long, passed long").withColumn("task", F.spark_partition_id()).collect()
    rows = count(1, 16)
    assert len({r.task for r in rows}) == 16 and sum(r.held for r in rows) == 4_000 and {r.passed for r in rows} == {500}
    rows = count(3, 4)
    assert len({r.task for r in rows}) == 12 and sum(r.held for r in rows) == 12_000 and sum(r.passed for r in rows) == 2_000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_results_are_shuffled_once(frame):
    columns = "query_id int, chunk_id int, rank int, document_name string, section_title string, page_number int, text string"
    base = frame([(q, c, c + 1, "D", f"{c % 3}", c % 2, f"text {c % 4}") for q in range(4) for c in range(8)], columns)
    extra = frame([(q, c, c + 1, "D" if c else None, f"{c % 5}", c % 2, f"text {c % 4}") for q in range(2, 6) for c in range(9)], columns)
    merged = search.merge_results(base, extra, k=3)
    assert _plan(merged).count("Exchange") == 1
    for q in range(6):
        own = [(0, c, ("D", f"{c % 3}", c % 2, f"text {c % 4}")) for c in range(8) if q < 4]
        own += [(1, c, ("D" if c else "", f"{c % 5}", c % 2, f"text {c % 4}")) for c in range(9) if q > 1]
        want = list({key: c for _, c, key in reversed(own)}.items())
        first = list(dict.fromkeys(key for *_, key in own))
        want = [dict(want)[key] for key in first][:12]
        assert [r.chunk_id for r in merged.filter(F.col("query_id") == q).orderBy("merged_rank").collect()] == want


def test_edges_are_distinct_before_they_meet_the_primaries(frame):
    """Primaries with their references are many more rows than edges; they are not shuffled to be distinct or compared with the chunks."""
    primaries = frame([(q, r, f"c{r}") for q in range(5) for r in range(4)], "query_id int, rank int, chunk_id string")
    edges = frame([("c1", "c2"), ("c1", "c2"), ("c1", "c1"), ("c2", "gone"), ("c3", "c9"), ("c3", None)], "src string, dst string")
    chunks = frame([(f"c{i}",) for i in range(10)] + [("c2",)], "chunk_id string")
    found = graph.resolved_references(primaries, edges, chunks)
    keys = [line for line in _plan(found).splitlines() if "Aggregate" in line]
    assert keys and not any("rank" in line for line in keys)
    assert sorted(map(tuple, found.select("query_id", "rank", "chunk_id", "ref_id").collect())) == [x for q in range(5) for x in ((q, 1, "c1", "c2"), (q, 3, "c3", "c9"))]


def test_expansion_without_a_query_id_keeps_its_primaries(frame):
    primaries = frame([(None, 1, "a"), (None, 2, "b"), (1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 9000, "b"), (2, 1, "c")], "query_id int, rank int, chunk_id string")
    edges = frame([("a", "b"), ("b", "d"), ("c", "b"), ("c", "e")], "src string, dst string")
    chunks = frame([(c,) for c in "abcde"], "chunk_id string")
    rows = graph.expand(primaries, edges, chunks).collect()
    got = {q: [(r.chunk_id, r.role, r.referenced_from) for r in sorted(rows, key=lambda r: r.position) if r.query_id == q] for q in (None, 1, 2)}
    assert got[None] == [("a", "primary", None), ("b", "primary", None)]
    assert got[1] == [("a", "primary", None), ("b", "reference", "a"), ("c", "primary", None), ("e", "reference", "c")]
    assert got[2] == [("c", "primary", None), ("b", "reference", "c"), ("e", "reference", "c")]


def test_of_equal_scores_a_chunk_without_id_comes_last(spark, frame, monkeypatch):
    monkeypatch.setattr(vectors, "_MANY_QUERIES", 8)
    monkeypatch.setattr(vectors, "_LEAST_PART_BYTES", 1 << 40)
    chunks = frame([(None, [1.0, 0.0]), (7, [2.0, 0.0]), (3, [1.0, 0.0]), (1, [0.0, 1.0])], "chunk_id int, embedding array<double>")
    asked = spark.range(40).selectExpr("id AS query_id", "array(1D, 0D) AS embedding")
    rows = vectors.vector_topk(asked, chunks, k=2).collect()
    assert {r.query_id for r in rows} == set(range(40)) and {(r.rank, r.chunk_id) for r in rows} == {(1, 3), (2, 7)}
