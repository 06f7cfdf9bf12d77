import random

import numpy as np
import pytest

from sievewright.llm import spans


def brute(docs, least):
    at = {}
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            at.setdefault(t[i : i + least], set()).add(d)
    marked = {}
    for d, t in docs:
        m = marked.setdefault(d, [])
        for i in range(len(t or "") - least + 1):
            if len(at[t[i : i + least]]) > 1:
                if m and i <= m[-1][1]:
                    m[-1][1] = i + least
                else:
                    m.append([i, i + least])
    return {(d, a, b) for d, m in marked.items() for a, b in m}


def corpus(seed, n=25, hot=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeäж𝗥", k=rng.randrange(2, 6)))
    passages = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(5)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(15)) for _ in range(4)]
        docs.append((i, " ".join(parts)))
    docs += [(n, docs[0][1]), (n + 1, ""), (n + 2, None), (n + 3, "x" * 400), (n + 4, "y" + "x" * 300)]
    docs += [(1000 + i, f"{word()} {word()} {passages[0]} {word()}") for i in range(hot)]
    return docs


@pytest.mark.parametrize(("seed", "least", "hot"), [(1, 30, 0), (2, 60, 0), (3, 40, 70)])
def test_against_brute_force(spark, seed, least, hot):
    docs = corpus(seed, hot=hot)
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc_id bigint, text string, grp string, pos int")
    got = {tuple(r) for r in spans.shared_spans(df, least).collect()}
    assert got == brute(docs, least)


def test_shares_and_empty(spark):
    df = spark.createDataFrame([(1, "a" * 20 + "b" * 20), (2, "b" * 20 + "cd"), (3, None)], "doc_id bigint, text string")
    s = spans.shared_spans(df, 20)
    got = {r["doc_id"]: (r["shared_chars"], r["share"]) for r in spans.shared_shares(df, s).collect()}
    assert got == {1: (20, 0.5), 2: (20, round(20 / 22, 6)), 3: (0, 0.0)}
    assert spans.shared_spans(df.limit(0), 20).count() == 0


def test_sketch_never_misses_a_repeat():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    s = spans.Sketch(12)
    s.add(h)
    s.add(h[:100])
    got = spans.repeated(s.packed(), 12, h)
    assert got[:100].all()
    a, b = s._at(h)
    assert (got == (np.minimum(s.cells[0][a], s.cells[1][b]) > 1)).all()


def test_anchor_in_every_stretch():
    rng = np.random.default_rng(2)
    points = rng.integers(97, 101, 3000).astype(np.uint32)
    at, _ = spans.anchors(points, np.array([0, 3000]), 50)
    k, _ = spans.sizes(50)
    for i in range(2950):
        assert ((at >= i) & (at + k <= i + 50)).any()


@pytest.mark.parametrize(("part", "block"), [(40, 64), (1, 100), (1 << 20, 48)])
def test_parts_and_blocks_of_any_size(spark, monkeypatch, part, block):
    monkeypatch.setattr(spans, "PART", part)
    monkeypatch.setattr(spans, "BLOCK", block)
    docs = corpus(5, hot=60)
    got = {tuple(r) for r in spans.shared_spans(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), 40).collect()}
    assert got == brute(docs, 40)


def test_rows_of_one_id_share_nothing_with_each_other(spark):
    long, other = "abcdefgh" * 10, "zyxwvuts" * 10
    rows = [(1, "1" + long), (1, long + "2"), (1, long + "2"), (2, other), (3, other + "3")] * 2
    got = {tuple(r) for r in spans.shared_spans(spark.createDataFrame(rows, "doc_id bigint, text string"), 40).collect()}
    assert got == {(2, 0, 80), (3, 0, 80)}


def test_the_sketch_filters_as_well_however_much_there_is(spark):
    """A block's cells grow with its anchors, so that as few single windows pass in a large table as in a small one."""
    passing = []
    for n in (1_000, 30_000, 1_000_000):
        h = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        s = spans.Sketch(max(10, (spans.CELLS * n).bit_length()))
        s.add(h)
        passing.append(spans.repeated(s.packed(), s.bits, h).mean())
    assert max(passing) < 0.06
    rng = random.Random(4)
    docs = [(i, "".join(rng.choices("abcdefghij ", k=500))) for i in range(300)] + [(900, "x" * 500)]
    assert spans.repeated_places(spark.createDataFrame(docs, "doc_id bigint, text string"), 60).count() == 0
