import random
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sievewright.operators.changes import current_entries, fold_changes, instant_ns, live_fields

SCHEMA = "registry string, entry_key string, recorded_at string, updated_at string, deleted boolean, fields map<string,string>, writer string, seq bigint, extra string, mark string, top string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "clash", "clash") for r in rows], SCHEMA)


def brute(rows):
    """The rule applied change by change."""
    state = {}
    seen = {}
    for r in rows:
        seen[r[6], r[7]] = r
    t = lambda s: datetime.fromisoformat(s.replace("Z", "+00:00"))
    for reg, key, rec, upd, deleted, fields, writer, seq in sorted(seen.values(), key=lambda r: (t(r[3] or r[2]), r[7], r[6])):
        if key is None or not key.strip():
            continue
        e = state.setdefault((reg, key), {})
        if deleted:
            e.clear()
        else:
            e.update({k: (v, writer, seq) for k, v in (fields or {}).items() if v})
    return {(reg, key, f, v, w, s) for (reg, key), e in state.items() for f, (v, w, s) in e.items()}


def random_rows(rng, n):
    out = []
    for i in range(n):
        at = datetime(2025, 1, 1) + timedelta(hours=rng.randrange(6))
        text = rng.choice([at.strftime("%Y-%m-%dT%H:%M:%SZ"), (at + timedelta(hours=2)).strftime("%Y-%m-%dT%H:%M:%S.000+02:00")])
        deleted = rng.choice([None, None, False, True])
        fields = rng.choice([None, {}]) if deleted else {f: rng.choice(["1", "2", "", None]) for f in rng.sample("abc", rng.randrange(4))}
        out.append((rng.choice("rs"), rng.choice(["k", "K", "l", None, "  "]), text if rng.random() < 0.3 else None, text, deleted, fields, rng.choice("uv"), i))
    return out


def got(state):
    return {(r["registry"], r["entry_key"], r["field_name"], r["value"], r["writer"], r["seq"]) for r in live_fields(state).collect()}


def test_any_order_repetition_and_split_gives_the_same(spark):
    rng = random.Random(5)
    rows = random_rows(rng, 60)
    want = brute(rows)
    noisy = rows + rng.sample(rows, 20)
    rng.shuffle(noisy)
    assert got(fold_changes(frame(spark, noisy))) == want
    a, b, c = noisy[:25], noisy[25:50], noisy[50:]
    state = fold_changes(frame(spark, c))
    for part in (a, b):
        state = fold_changes(frame(spark, part), state)
    assert got(state) == want


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_against_brute_force(spark, seed):
    rows = random_rows(random.Random(seed), 30)
    assert got(fold_changes(frame(spark, rows))) == brute(rows)


def test_late_change_meets_the_tombstone(spark):
    gone = [("r", "k", None, "2025-01-02T00:00:00Z", True, None, "w", 2)]
    late = [("r", "k", None, "2025-01-01T00:00:00Z", None, {"a": "1"}, "w", 1)]
    state = fold_changes(frame(spark, late), fold_changes(frame(spark, gone)))
    assert live_fields(state).count() == 0 and current_entries(state).count() == 0
    again = [("r", "k", None, "2025-01-03T00:00:00Z", False, {"b": "2", "c": ""}, "w", 3)]
    assert [(r["fields"]) for r in current_entries(fold_changes(frame(spark, again), state)).collect()] == [{"b": "2"}]


def test_empty_feed_and_entry_without_values(spark):
    assert fold_changes(frame(spark, [])).count() == 0
    e = current_entries(fold_changes(frame(spark, [("r", "k", "2025-01-01T00:00:00Z", None, None, {"a": ""}, "w", 1), (None, "n", "2025-01-01T00:00:00Z", None, None, {"a": "1"}, None, None)])))
    assert {(r["registry"], r["entry_key"]): r["fields"] for r in e.collect()} == {("r", "k"): {}, (None, "n"): {"a": "1"}}


def test_instants(spark):
    rows = [("2025-01-01T00:00:00Z", 0), ("2025-01-01t01:00:00+01:00", 0), ("2024-12-31T23:00:00.000-01:00", 0), ("2025-01-01T00:00:00.000000001Z", 1), ("nonsense", None), (None, None)]
    base = 1735689600 * 10**9
    out = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    for r in out.select("i", instant_ns(out["t"]).alias("n")).collect():
        want = rows[r["i"]][1]
        assert r["n"] == (None if want is None else base + want)


def test_tables_written_in_a_scope_go_with_it(spark, tmp_path):
    import os

    from sievewright import staging

    root = staging.shared_dir(spark).removeprefix("file://") + "/sievewright"
    outer = staging.written(spark.range(3), "outer")
    before = set(os.listdir(root))
    with staging.scope():
        assert staging.written(spark.range(5), "inner").count() == 5
        assert len(set(os.listdir(root)) - before) == 1
    assert set(os.listdir(root)) == before and outer.count() == 3


def test_sources_and_first_records_merge_with_the_fields(spark):
    from sievewright.operators import changes

    schema = "registry string, entry_key string, recorded_at string, updated_at string, deleted boolean, fields map<string,string>, source struct<mailbox:string,uid:bigint,attachment_index:int,sha256:string,saved_path:string>, writer string, seq bigint"
    day = lambda n: f"2025-01-{n:02d}T00:00:00Z"
    rows = [
        ("r", "k", day(1), None, None, {"a": "1"}, ("box", 7, 0, "s1", None), "w", 1), ("r", "k", day(1), day(2), None, {"b": "2"}, ("", 0, None, "s2", "p"), "w", 2), ("r", "k", None, day(3), True, None, None, "w", 3),
        ("r", "k", None, day(4), None, {"a": "9"}, (None, 8, None, None, None), "w", 4), ("r", "k", day(5), None, None, {}, ("new", None, 2, "", None), "w", 5),
        ("r", "m", day(6), None, None, {"a": "1"}, ("box", 7, 0, "s1", None), "w", 6), ("r", "m", day(6), day(7), None, {"a": ""}, ("", 0, None, "s2", "p"), "w", 7), ("r", "n", day(8), None, None, {"a": "1"}, None, "w", 8), ("r", " ", day(8), None, None, {"a": "1"}, None, "w", 9),
    ]
    for order in (rows, rows[::-1] + rows):
        got = {r["entry_key"]: (r["fields"], tuple(r["source"]), r["recorded_at"]) for r in changes.merged_entries(spark.createDataFrame(order, schema)).collect()}
        assert got == {"k": ({"a": "9"}, ("new", 8, 2, None, None), day(5)), "m": ({"a": "1"}, ("box", 7, 0, "s2", "p"), day(6)), "n": ({"a": "1"}, (None,) * 5, day(8))}
