import random

from sievewright.llm import leakage

D, I = "doc_id bigint, text string, item_id string, n int", "item_id bigint, text string, doc_id string"


def brute(docs, items, least):
    grams = {}
    for i, t in items:
        w = leakage.words(t or "")
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    return {(d, i) for d, t in docs for w in [leakage.words(t or "")] for k in range(len(w) - least + 1) for i in grams.get(tuple(w[k : k + least]), ())}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 25)))) for i in range(30)] + [(30, None), (31, "")]
    docs = []
    for d in range(120):
        w = rng.choices([*vocabulary, "other", "more"], k=40)
        if rng.random() < 0.6:
            own = leakage.words(rng.choice(items[:30])[1])
            a = rng.randrange(len(own))
            w[10:10] = [x.upper() if rng.random() < 0.3 else x for x in own[a:]]
        docs.append((d, "".join(x + rng.choice([" ", ", ", "\n> ", " - "]) for x in w)))
    docs += [(200, None), (201, ""), (202, "w1 " * 50_000)]
    df, it = spark.createDataFrame([(*d, "c", 1) for d in docs], D), spark.createDataFrame([(*i, "c") for i in items], I)
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(df, it, 5).collect()}
    assert got == brute(docs, items, 5)


def test_longest_matches_and_removal(spark):
    item = "one two three four five six seven"
    df = spark.createDataFrame([(1, "x one, TWO three. four five y one two three four z", "c", 1), (2, "nothing here", "c", 1)], D)
    it = spark.createDataFrame([(7, item, "c"), (7, item, "c")], I)
    p = leakage.leaked_passages(df, it, 4)
    assert sorted(tuple(r) for r in p.collect()) == [(1, 7, 1, 0, 5), (1, 7, 7, 0, 4)]
    assert [r["doc_id"] for r in leakage.without_leaks(df, p).collect()] == [2]
    assert leakage.leaks(p).first()["longest"] == 5
    assert leakage.leaked_passages(df, it.limit(0), 4).count() == 0 and leakage.leaked_passages(df.limit(0), it, 4).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 20)
    df = spark.createDataFrame([(1, "a b c d e f", "c", 1)], D)
    it = spark.createDataFrame([(1, "a b c x", "c"), (2, "d e f y", "c"), (3, "q r s t", "c")], I)
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(df, it, 3).collect()} == {(1, 1), (1, 2)}
