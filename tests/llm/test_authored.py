import random

import numpy as np
import pytest

from sievewright.llm import authored

MAIL = """Hallo B. Muster,

bitte zahlen Sie bis Montag.

-- Achtung: neue Anschrift --

Viele Grüße
A. Beispiel

-- 
A. Beispiel
Einkauf
Tel. +49 000 123456

Am 01.02.2025 schrieb C. Dritte
<c@d.example>:
> Guten Tag,
>
> das ist der alte Text und wurde
umgebrochen, ohne Zeichen
> und geht weiter.

Eine Antwort dazwischen.

> Noch mehr alter Text.
"""


def test_blocks_and_labels():
    blocks, x, labels = authored.describe(MAIL)
    own = [b.lines[0] for b, v in zip(blocks, labels) if v != 1]
    assert own[:4] == ["Hallo B. Muster,", "bitte zahlen Sie bis Montag.", "-- Achtung: neue Anschrift --", "Viele Grüße"]
    gone = {i for b, v in zip(blocks, labels) if v == 1 for i in range(b.first, b.last + 1)}
    lines = MAIL.split("\n")
    for text in ("A. Beispiel\nEinkauf", "Am 01.02", "<c@d.example>:", "> das ist", "umgebrochen", "> Noch mehr"):
        assert next(i for i, line in enumerate(lines) if line.startswith(text.split("\n")[-1])) in gone
    assert x.shape == (len(blocks), len(authored.FEATURES))


@pytest.mark.parametrize("head", ["-----Original Message-----\nFrom: A <a@b.example>\nSent: now", "________________________________\nVon: A <a@b.example>\nGesendet: heute", "*From:* A <a@b.example>\n*Sent:* now"])
def test_forwarded_to_the_end(head):
    blocks, _, labels = authored.describe(f"Text of mine.\n\nBest wishes\nA. Bee\n\n{head}\n\nOld text.\n\nMore of it.")
    assert [v for b, v in zip(blocks, labels)][:2] == [0, 0] and set(labels[2:]) == {1}


def test_trees_learn_and_handle_nothing():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = authored.fit_trees(x[:2000], y[:2000])
    assert ((t.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    assert authored.fit_trees(x[:0], y[:0]).margin(x[:3]).tolist() == [0, 0, 0]


def test_frame(spark, data):
    real = spark.read.parquet(f"{data}/mail_parsed.parquet").select("msg_id", "text_body", "message_from")
    rows = [(900001, MAIL, "A"), (900001, MAIL, "A"), (900002, None, "A"), (900003, "", None), (900004, "Nur ein Satz von mir.\r\n\r\n> alt\r\n", None), (900005, "Mein Text ist lang. " * 20_000, "A")]
    df = real.unionByName(spark.createDataFrame(rows, "msg_id bigint, text_body string, message_from string")).selectExpr("*", "1 AS line_no", "'c' AS label", "'c' AS x")
    found = authored.foreign_lines(df)
    got = [(r["msg_id"], r["line_no"]) for r in found.collect()]
    assert len(got) == len(set(got))
    lines = MAIL.split("\n")
    mine = {n for m, n in got if m == 900001}
    for i, line in enumerate(lines, 1):
        if line.startswith(("Hallo", "bitte", "Viele")):
            assert i not in mine
        if line.startswith((">", "Am 01", "<c@d")):
            assert i in mine
    assert {n for m, n in got if m == 900004} == {3} and not [m for m, _ in got if m in (900002, 900003, 900005)]
    own = {r["msg_id"]: r["authored"] for r in authored.authored_text(df.filter("msg_id > 900000"), found).collect()}
    assert own[900004] == "Nur ein Satz von mir." and own[900003] == "" and 900002 not in own
    assert authored.foreign_lines(df.limit(0)).count() == 0


def test_stripping_takes_marks_and_keeps_labels():
    text, of = authored.stripped(MAIL)
    lines = text.split("\n")
    assert len(lines) == len(of) and not any(line.startswith((">", "Am 01")) or line.strip() == "--" for line in lines)
    by = dict(zip(lines, of))
    assert by["bitte zahlen Sie bis Montag."] == 0 and by["Noch mehr alter Text."] == 1 and by["Einkauf"] == 1 and by["Guten Tag,"] == 1


def threads(n, marked):
    """Mails that answer earlier ones between their paragraphs; some without any marks."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghilmnoprstu", k=rng.randrange(3, 9)))
    paragraph = lambda: "\n".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(rng.randrange(1, 4)))
    rows, foreign = [], {}
    for i in range(n):
        own = [paragraph() for _ in range(rng.randrange(2, 5))]
        old = [rows[j][1] for j in rng.sample(range(max(0, i - 40), i), 1)] if i > 20 and rng.random() < 0.8 else []
        parts: list[tuple[str, bool]] = [(p, False) for p in own]
        plain = i % 5 == 0 and not marked
        for body in old:
            for p in body.split("\n\n")[:3]:
                k = rng.randrange(len(parts) + 1)
                p = "\n".join(line.lstrip("> ") for line in p.split("\n"))
                parts.insert(k, (p if plain else "\n".join("> " + line for line in p.split("\n")), True))
        text, lines = "", set()
        for p, alien in parts:
            start = text.count("\n") + 1
            if alien:
                lines |= set(range(start, start + p.count("\n") + 1))
            text += p + "\n\n"
        rows.append((i, text, f"S{rng.randrange(30)}", f"2025-01-01 00:00:{0:02d}", i))
        if plain:
            foreign[i] = lines
    return rows, foreign


def test_ancestors_tell_history_without_marks(spark):
    rows, foreign = threads(700, False)
    df = spark.createDataFrame([(i, t, w, k) for i, t, w, _, k in rows], "msg_id bigint, text_body string, message_from string, k long").selectExpr("*", "timestamp_seconds(1735689600 + k * 60) AS sent_at")
    got = {(r["msg_id"], r["line_no"]) for r in authored.foreign_lines(df).collect() if r["msg_id"] in foreign}
    true = {(i, n) for i, lines in foreign.items() for n in lines}
    by_rules = {(i, n + 1) for i, t, *_ in rows if i in foreign for b, v in zip(*(lambda d: (d[0], d[2]))(authored.describe(t))) if v == 1 for n in range(b.first, b.last + 1)}
    assert len(true) > 200 and len(by_rules & true) < 0.2 * len(true)
    assert len(got & true) >= 0.9 * len(true) and len(got & true) >= 0.9 * len(got)


def test_hot_keys_and_the_rest_meet_alike(spark):
    rows = [(i, f"Ein fester Satz, den alle am Ende senden.\n\nNur diese Nachricht hat die Nummer {i} in sich, sonst keine.\n\nEin Satz von Paar {i // 2}, den zwei Nachrichten haben.", f"S{i % 3}") for i in range(3000)]
    d, m = authored._described_with_matches(spark.createDataFrame(rows, "msg_id bigint, text_body string, message_from string"), 10, "msg_id", "text_body", "message_from", "sent_at")
    found = {r["msg_id"]: sorted((f["place"], f["n"], f["flag"]) for f in r["found"] if f["place"] % 2 == 0) for r in m.filter("variant = 0").collect()}
    assert found[0] == [(0, 3000, 0), (4, 2, 0)] and found[1] == [(0, 3000, 1), (4, 2, 1)] and found[3] == [(0, 3000, 2), (4, 2, 1)]
