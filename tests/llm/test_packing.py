import math
import random
import time

import pytest

from sievewright.llm import packing, queries


def check(spark, sizes, specs, group=4):
    sz = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    spec = spark.createDataFrame(specs, "container_id int, capacity_tokens int, separator_tokens int, doc_id string")
    rows = packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), spec, group, sizes=sz).collect()
    out = {}
    for cid, capacity, sep, _ in {s[0]: s for s in specs}.values():
        own = [r for r in rows if r["container_id"] == cid]
        tokens, used = {}, {}
        for r in own:
            tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
            if r["container_no"] is not None:
                used.setdefault(r["container_no"], []).append(r)
        assert tokens == dict(enumerate(sizes))
        for rs in used.values():
            rs.sort(key=lambda r: r["slot"])
            at = 0
            for i, r in enumerate(rs):
                assert r["slot"] == i and r["offset"] == at
                at += r["n_tokens"] + sep
            assert at - sep <= capacity
        pieces = {}
        for r in own:
            pieces.setdefault(r["doc_id"], []).append(r)
        for d, rs in pieces.items():
            assert len(rs) == 1 or sizes[d] > capacity
            rs.sort(key=lambda r: r["piece_no"])
            assert [r["token_start"] for r in rs] == [sum(x["n_tokens"] for x in rs[:i]) for i in range(len(rs))]
        assert sorted(used) == list(range(len(used)))
        out[cid] = (len(used), math.ceil(sum(sizes) / capacity))
    return out


def best_fit_decreasing(sizes, capacity, sep):
    full = sum(s // capacity for s in sizes if s > capacity)
    free = []
    for s in sorted((s % capacity if s > capacity else s for s in sizes), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= s + sep]
        if fits:
            free[min(fits, key=free.__getitem__)] -= s + sep
        elif s:
            free.append(capacity - s)
    return len(free) + full


def test_every_text_once_and_full(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 7, 30, 64, 65, 200, 513]) if rng.random() < 0.3 else rng.randrange(1, 120) for _ in range(600)]
    got = check(spark, sizes, [(1, 128, 0, "c"), (2, 256, 1, "c"), (2, 256, 1, "c"), (3, 64, 2, "c")])
    for cid, capacity, sep in ((1, 128, 0), (2, 256, 1), (3, 64, 2)):
        assert got[cid][0] <= best_fit_decreasing(sizes, capacity, sep)


def test_hot_size_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 10)
    check(spark, [33] * 100 + [31] * 90 + [300] * 7 + [5] * 3, [(1, 100, 1, "c")])


def test_empty(spark):
    assert check(spark, [], [(1, 10, 0, "c")]) == {1: (0, 0)}
    assert check(spark, [0, 0], [(1, 10, 0, "c")]) == {1: (0, 0)}


def test_plan_leaves_nothing():
    rng = random.Random(5)
    for sep in (0, 1, 3):
        h = {s: rng.randrange(1, 50) for s in rng.sample(range(1, 101), 40)}
        p = packing.plan(h, 100, sep)
        assert sum(n for _, n in p.fills) == p.n_containers and all(f <= 100 for f, _ in p.fills)


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a b " * 30_000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_sizes(df).collect()}
    assert got[2] == got[3] == 0 and got[1] > 1 and got[4] >= 60_000


def test_every_container_has_one_step(spark):
    rng = random.Random(6)
    sizes = [rng.randrange(300, 2000) for _ in range(60)] + [rng.randrange(0, 120) for _ in range(300)]
    specs = [(1, 128, 1, "c"), (2, 256, 0, "c")]
    sz = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    spec = spark.createDataFrame(specs, "container_id int, capacity_tokens int, separator_tokens int, doc_id string")
    rows = packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), spec, 4, sizes=sz).collect()
    for cid, capacity, *_ in specs:
        steps, tier_of, groups = {}, {}, {}
        for r in rows:
            if r["container_id"] == cid and r["container_no"] is not None:
                steps.setdefault(r["container_no"], set()).add(r["step"])
                tier_of.setdefault(r["step"], set()).add(r["tier"])
                group = groups.setdefault((r["tier"], r["step"]), [set(), 0])
                group[0].add(r["container_no"])
                group[1] += r["n_tokens"]
        assert all(len(s) == 1 and None not in s for s in steps.values())
        assert all(len(t) == 1 for t in tier_of.values())
        for tier in {t for t, _ in groups}:
            own = [g for (t, _), g in groups.items() if t == tier]
            assert max(len(c) for c, _ in own) <= 4 and max(n for _, n in own) - min(n for _, n in own) <= capacity


def test_steps_hold_all_tokens(spark, data):
    documents, spec = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/container_spec.parquet")
    tokens = packing.token_sizes(documents).groupBy().sum("n_tokens").first()[0]
    got = {r[0]: r[1] for r in queries.p7_steps(spark, data).filter("step IS NOT NULL").groupBy("container_id").sum("tokens").collect()}
    assert got == {r["container_id"]: tokens for r in spec.collect()}


def test_tiers_are_packed_by_themselves_and_gaps_from_shorter():
    """A container is opened by the longest text of its tier; what follows is of that tier as long as one fits."""
    rng = random.Random(3)
    capacity, sep = 1000, 2
    histogram = {s: rng.randrange(1, 5) for s in rng.sample(range(1, capacity + 1), 300)}
    stock = packing._Stock(histogram, capacity)
    left = dict(histogram)
    for tier in range(packing.TIERS):
        high, low = capacity >> tier, capacity >> tier + 1 if tier < packing.TIERS - 1 else 0
        for inside, many in packing._pack_tier(stock, low, high, capacity, sep):
            assert max(inside) <= high and packing.route(max(inside), capacity) == tier
            assert sum(s * k for s, k in inside.items()) + sep * (sum(inside.values()) - 1) <= capacity
            for s, k in inside.items():
                left[s] -= k * many
                assert left[s] >= 0
            gap = capacity - sum((s + sep) * k for s, k in inside.items())
            # no size that is left when the container is closed fits into its gap
            assert not any(n > 0 and s <= gap for s, n in left.items()) or many > 1
        assert not any(n for s, n in left.items() if s > low)
    assert not any(left.values())


@pytest.mark.parametrize("capacity", [1, 2, 5, 131_072])
def test_planner_is_quick_at_any_capacity(capacity):
    start = time.time()
    p = packing.plan({s: 1 + s % 3 for s in range(1, capacity + 1)}, capacity, 1)
    assert time.time() - start < 5
    tokens = sum(s * (1 + s % 3) for s in range(1, capacity + 1))
    assert capacity < 100 or tokens / (p.n_containers * capacity) > 0.99


def test_numbers_do_not_depend_on_the_parts(spark, monkeypatch):
    sizes = spark.createDataFrame([(i, 3 if i % 3 else i % 40) for i in range(900)], "doc_id bigint, n_tokens bigint")
    specs = spark.createDataFrame([(1, 16, 1)], "container_id int, capacity_tokens int, separator_tokens int")
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    one = {tuple(r) for r in packing.pack(docs, specs, sizes=sizes).collect()}
    monkeypatch.setattr(packing, "PART_ROWS", 50)
    assert {tuple(r) for r in packing.pack(docs, specs, sizes=sizes).collect()} == one
