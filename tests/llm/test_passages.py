import random

import numpy as np
import pytest

from groundplan.llm import passages

SCHEMA = "doc_id long, text string, similarity string"


def plain_windows(values, width):
    """Every token's widest span as its first smallest, by loops."""
    found = set()
    for c, own in enumerate(values):
        if own == 0:
            continue
        left, right = c, c
        while left and values[left - 1] > own:
            left -= 1
        while right + 1 < len(values) and values[right + 1] >= own:
            right += 1
        if right - left + 1 >= width:
            found.add((c, left, right))
    return found


@pytest.mark.parametrize("width", [1, 2, 5, 46])
@pytest.mark.parametrize("seed", range(6))
def test_windows_equal_the_tree(seed, width):
    rng = np.random.default_rng(seed)
    values, longest = [0], 0
    for _ in range(rng.integers(0, 6)):
        text = rng.integers(1, rng.choice([3, 1000]), rng.integers(0, 200))
        longest = max(longest, len(text))
        values += [*text.tolist(), 0]
    got = passages.compact_windows(np.array(values, np.uint64), width, longest)
    assert set(zip(*[x.tolist() for x in got])) == plain_windows(values, width)


def own_words(rng, count):
    return [f"w{rng.randrange(10**9)}" for _ in range(count)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)


def found_in(spark, rows):
    return passages.find_passages(frame(spark, rows)).collect()


def test_planted_passages_and_clean_documents(spark):
    rng = random.Random(1)
    rows, planted = [], set()
    for p in range(12):
        passage = own_words(rng, rng.randint(52, 160))
        for k in range(rng.choice([2, 3, 30])):
            body = own_words(rng, rng.randint(0, 400))
            at = rng.randint(0, len(body))
            copy = [w.upper() if rng.random() < 0.1 else w for w in passage]
            rows.append((len(rows), " ".join(body[:at] + copy + body[at:])))
            planted.add(len(rows) - 1)
    for _ in range(40):  # shares less than a passage
        rows.append((len(rows), " ".join(own_words(rng, 200) + passage[:40] + own_words(rng, 100))))
    got = found_in(spark, rows)
    assert {r.doc_id for r in got} | {r.other_id for r in got} == planted
    texts = dict(rows)
    for r in got:
        one, two = texts[r.doc_id].lower().split()[r.start_word : r.end_word], texts[r.other_id].lower().split()[r.other_start : r.other_end]
        assert r.doc_id < r.other_id and len(one) >= 50 and len(two) >= 50
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (one, two))
        assert len(a & b) / len(a | b) == pytest.approx(r.similarity) and r.similarity >= 0.8


def test_passages_with_changed_words(spark):
    rng = random.Random(2)
    rows = []
    for p in range(30):
        passage = own_words(rng, 150)
        for k in range(2):
            copy = list(passage)
            if k:
                for i in rng.sample(range(150), 2):
                    copy[i] = "changed"
            rows.append((len(rows), " ".join(own_words(rng, 60) + copy + own_words(rng, 60))))
    got = found_in(spark, rows)
    assert {(r.doc_id, r.other_id) for r in got} == {(2 * p, 2 * p + 1) for p in range(30)}


def test_copies_of_whole_texts(spark):
    rng = random.Random(3)
    text, short = " ".join(own_words(rng, 60)), " ".join(own_words(rng, 40))
    got = found_in(spark, [(i, text) for i in range(300)] + [(i, short) for i in range(300, 400)])
    assert sorted((r.doc_id, r.other_id, r.start_word, r.end_word, r.similarity) for r in got) == [(0, i, 0, 60, 1.0) for i in range(1, 300)]


def test_odd_texts_and_empty_tables(spark):
    rng = random.Random(4)
    text = " ".join(own_words(rng, 70))
    rows = [(1, None), (2, ""), (3, "x"), (4, text), (4, text), (None, text), (5, "again " * 100_000), (6, "again " * 60), (7, f"{text} {text}")]
    got = {(r.doc_id, r.other_id) for r in found_in(spark, rows)}
    assert (4, 7) in got and all(a in (4, 5, 6) and b in (6, 7) for a, b in got)
    assert passages.find_passages(frame(spark, rows).limit(0)).collect() == []


def test_passages_around_a_notice_of_many(spark):
    rng = random.Random(5)
    rows, pairs = [], set()
    for n in range(2):
        notice = own_words(rng, 45)
        for p in range(100):
            before = rng.randint(0, 15)
            passage = own_words(rng, before) + notice + own_words(rng, 15 - before)
            pairs.add((len(rows), len(rows) + 1))
            rows += [(len(rows) + k, " ".join(own_words(rng, 60) + passage + own_words(rng, 60))) for k in range(2)]
        rows += [(len(rows) + k, " ".join(own_words(rng, 60) + notice + own_words(rng, 60))) for k in range(200)]
    assert {(r.doc_id, r.other_id) for r in found_in(spark, rows)} == pairs


def own_text(rng, before, passage, after):
    return " ".join(own_words(rng, before) + passage + own_words(rng, after))


def linked(rows, one, two):
    """Whether two documents have a row in common, or rows with the same third one."""
    ties = {frozenset((r.doc_id, r.other_id)) for r in rows}
    others = [{x for t in ties if d in t for x in t if x != d} for d in (one, two)]
    return two in others[0] or bool(others[0] & others[1])


def test_no_partner_is_lost_among_many_holders_of_a_run(spark):
    # the partner is never next to a text in the order of either side: the run that many hold is cut by changed words
    rng = random.Random(6)
    notice, rows, pairs = own_words(rng, 30), [], []
    for p in range(60):
        one = own_words(rng, 10) + notice + own_words(rng, 40)
        two = list(one)
        two[8], two[41] = f"x{p}", f"y{p}"
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows) + k, own_text(rng, 40, passage, 40)) for k, passage in enumerate((one, two))]
    rows += [(len(rows) + k, own_text(rng, 50, notice, 50)) for k in range(200)]
    got = found_in(spark, rows)
    assert {(r.doc_id, r.other_id) for r in got} == set(pairs)


@pytest.mark.parametrize("block", [passages.BLOCK_TEXTS, 40])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(passages, "BLOCK_TEXTS", block)
    rng = random.Random(7)
    lines = [own_words(rng, 24) for _ in range(3)]
    rows = []
    for k in range(150):  # texts of a few common lines, with words changed here and there
        words = own_words(rng, 30) + [w for _ in range(rng.randint(1, 4)) for w in rng.choice(lines)] + own_words(rng, 30)
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"z{k}"
        rows.append((k, " ".join(words)))
    cut = [passages.shingles(passages.read_texts(passages.pa.array([t])), passages.SIZE)[0] for _, t in rows]
    got = found_in(spark, rows)
    for one in range(len(rows)):
        for two in range(one + 1, len(rows)):
            windows = [{tuple(x[i : i + passages.WIDTH].tolist()) for i in range(len(x) - passages.WIDTH + 1)} for x in (cut[one], cut[two])]
            assert not windows[0] & windows[1] or linked(got, one, two)


def test_repeated_lines_hide_no_passage():
    rng = np.random.default_rng(8)
    line, rest = rng.integers(1, 1 << 60, 60).astype(np.uint64), rng.integers(1, 1 << 60, 70).astype(np.uint64)
    one, two = np.concatenate([line[10:], rest]), np.concatenate([line, line, line, rest[:20], line])
    assert any(to - at >= 50 and t2 - a2 >= 50 for at, to, a2, t2, _ in passages.shared_passages(one, two))


def test_unlike_texts_under_one_id(spark):
    rng = random.Random(9)
    rows = []
    for p in range(20):
        passage = own_words(rng, 70)
        rows += [(p, own_text(rng, 20, passage, 20)), (p, own_text(rng, 50, [], 50)), (100 + p, own_text(rng, 20, passage, 20))]
    assert {(r.doc_id, r.other_id) for r in found_in(spark, rows)} == {(p, 100 + p) for p in range(20)}


def test_every_document_of_a_passage_has_one_row(spark):
    rng = random.Random(10)
    rows, planted = [], {}
    for p in range(6):
        passage = own_words(rng, 60)
        ids = range(len(rows), len(rows) + rng.choice([2, 3, 30]))
        for k in ids:
            before = rng.randint(0, 40)
            planted[k] = (ids[0], [(before, before + 60)])
            rows.append((k, own_text(rng, before, passage, 40)))
    rows += [(len(rows) + k, own_text(rng, 80, [], 0)) for k in range(20)]
    copies = [(len(rows) + k, rows[0][1]) for k in range(5)]
    planted |= {k: planted[0] for k, _ in copies}
    got = passages.by_document(passages.find_passages(frame(spark, rows + copies))).collect()
    assert len(got) == len(planted) and {r.doc_id for r in got} == set(planted)
    for r in got:
        # a copy of a whole text is one stretch
        stretches = [(0, len(rows[0][1].split()))] if planted[r.doc_id] == planted[0] and r.doc_id in {0, *(k for k, _ in copies)} else planted[r.doc_id][1]
        assert r.class_id == planted[r.doc_id][0] and [(x.start_word, x.end_word) for x in r.passages] == stretches
        assert r.n_passages == len(stretches) and r.n_words == sum(b - a for a, b in stretches) and all(x.with_doc != r.doc_id for x in r.passages)


def test_near_copies_are_joined_by_few_pairs(spark):
    rng, count = random.Random(11), 160
    text = own_words(rng, 300)
    rows = []
    for k in range(count):
        words = list(text)
        for i in rng.sample(range(300), 9):
            words[i] = f"x{k}x{i}"
        rows.append((k, " ".join(words)))
    found = passages.find_passages(frame(spark, rows))
    # a tree for each of some thirty minima, not all 12,720 pairs
    assert len({(r.doc_id, r.other_id) for r in found.collect()}) < 30 * count
    assert {(r.doc_id, r.class_id) for r in passages.by_document(found).collect()} == {(k, 0) for k in range(count)}


def test_a_text_of_one_line_with_the_same_word_changed(spark):
    rng = random.Random(12)
    line = own_words(rng, 30)
    rows = [(k, " ".join((line[:9] + [f"y{k}"] + line[10:]) * 40 + line)) for k in range(2)] + [(2, " ".join(line * 3 + own_words(rng, 60)))]
    one, two = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (t.split() for _, t in rows[:2]))
    assert len(one & two) / len(one | two) >= 0.7
    assert {r.doc_id for r in passages.by_document(passages.find_passages(frame(spark, rows))).collect()} >= {0, 1}
