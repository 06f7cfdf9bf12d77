import pytest

from sievewright.llm import langdata, language


@pytest.fixture(scope="module")
def model(spark, data):
    return language.fit_on(spark.read.parquet(f"{data}/documents.parquet"))


def test_automaton_knows_exactly_the_substrings():
    text = "ababcaab"
    a = language.SuffixAutomaton(text)
    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def state(s):
        q = 0
        for c in s:
            if (q := a.edges[q].get(ord(c))) is None:
                return None
        return q

    import itertools

    for n in range(1, 5):
        for s in map("".join, itertools.product("abcd", repeat=n)):
            q = state(s)
            assert (q is not None) == (s in subs)
            if q is not None:
                assert a.times[q] == sum(text.startswith(s, i) for i in range(len(text)))


def greedy(text, known):
    """Longest phrases of ``known``, by substring search."""
    out, i = [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in known:
            j += 1
        out.append(text[i:j])
        i = j
    return out


def test_phrases_run_across_words():
    import math

    own = ["der Hund und die Katze und der Hund", "die Rechnung ist offen"]
    m = language.fit({"a": own, "b": ["the dog and the cat sleep well"]})
    who = language.Identifier(m)
    known = "\n".join(map(language.running, own))
    n_states = len(m.edges[0][0]) - 1
    for s in ("und die Katze ist offen", "Hund Hund", "die Rechnung und der Hund", "offen der Katze"):
        phrases = greedy(language.running(s), known)
        assert any(" " in p.strip() for p in phrases) or not s.startswith("und")
        times = [sum(known.startswith(p, i) for i in range(len(known))) for p in phrases]
        assert who.prices(language.words_of(s))[0] == pytest.approx(sum(math.log2((n_states + 1) / n) for n in times), abs=0.05 * len(phrases))
        assert who.prices(language.words_of(s)) == who.prices(language.words_of(s))


def test_three_words_are_decided(model):
    who = language.Identifier(model)
    got = [who.verdict(s)[0] for s in ("Wir warten noch.", "We still wait.", "Мы ещё ждём.")]
    assert got == ["de", "en", "ru"]
    assert who.verdict("")[0] is None and who.verdict("12 - 34")[0] is None


def test_languages_beyond_the_eight(spark):
    da = ["Vi venter stadig på jeres svar på den sidste faktura.", "Fakturaen er endnu ikke betalt, og vi beder om en hurtig løsning."]
    en = ["We still wait for your answer to the last invoice.", "The invoice has not been paid yet and we ask for a quick solution."]
    rows = [(i, c, t) for i in range(6) for c, ts in (("da-DK", da), ("en", en)) for t in ts]
    m = language.fit_on(spark.createDataFrame(rows, "doc_id int, lang string, text string"))
    assert m.languages == ["da", "en"]
    assert language.Identifier(m).verdict("Vi beder om jeres svar på fakturaen.")[0] == "da"


@pytest.mark.parametrize(("label", "code"), [("de-DE", "de"), ("DE", "de"), ("ger", "de"), ("German", "de"), ("en_US", "en"), ("nl-BE", "nl"), ("und", None), ("??", None), ("", None), (None, None), ("x-none", None), ("unknown", None), (" fr ", "fr")])
def test_labels(label, code):
    assert langdata.label_code(label) == code


def test_held_out_accuracy(spark, model):
    """Other documents than the sample's, by their label. About one label in fourteen is wrong, so documents are held against it as a whole first."""
    who = language.Identifier(model)
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL").limit(600).collect()]
    agree = right = total = 0
    for lang, text in docs:
        got = [x for x, _ in who.verdicts(language.whole_sentences(text)[:6]) if x]
        if got and max(set(got), key=got.count) == lang:
            agree += 1
            right += got.count(lang)
            total += len(got)
    assert agree / len(docs) > 0.88 and total > 1000 and right / total > 0.97


def test_mixed_disguised_and_blank(spark, model):
    de = "Könnten Sie uns bis nächste Woche die Gutschrift schicken? Der Betrag fehlt uns noch immer."
    en = "Please pay the invoice before the end of the month, otherwise we will stop the delivery."
    ru = "Просим перевести сумму до конца месяца, иначе поставка будет остановлена."
    rows = [(1, f"{de}\n\n> {en}\n\n{de}"), (2, None), (3, "  \n"), (4, ru.encode().decode("latin-1")), (5, "".join(chr(ord(c) + 0xFEE0) if c.isalpha() and c.isascii() else c for c in en)), (6, "12 34 € - 5"), (7, en + " " + en * 3000)]
    df = spark.createDataFrame([(i, t, None, "x", "y", 1.0) for i, t in rows], "msg_id bigint, body string, subject string, key string, lang string, confidence double")
    got = {r["msg_id"]: r for r in language.identify(df, model, "msg_id", "body", "subject").collect()}
    assert [s["lang"] for s in got[1]["segments"]] == ["de", "en", "de"] and got[1]["lang"] == "de" and 0 < got[1]["confidence"] <= 1
    assert [got[i]["lang"] for i in (2, 3, 6)] == [None] * 3
    assert got[4]["lang"] == "ru" and got[5]["lang"] == "en" and got[7]["lang"] == "en"
    assert language.identify(df.limit(0), model, "msg_id", "body").count() == 0


def test_sample_has_every_language_of_a_sorted_table(spark):
    rows = [(i, c, f"{c} text {i}") for i, c in enumerate(["de-DE"] * 500 + ["??"] * 50 + [None] * 50 + ["French"] * 300 + [" pl\t"] * 5)]
    df = spark.createDataFrame(rows, "doc_id int, lang string, text string").coalesce(1)
    got = langdata.labelled_texts(df, "lang", "text", 100)
    assert {c: len(t) for c, t in got.items()} == {"de": 48, "fr": 47, "pl": 5}
    assert got == langdata.labelled_texts(df.repartition(7), "lang", "text", 100)
    assert max(int(t.split()[2]) for t in got["de"]) > 400 and min(int(t.split()[2]) for t in got["de"]) < 100
    every = langdata.labelled_texts(df, "lang", "text", 1000)
    assert {c: len(set(t)) for c, t in every.items()} == {"de": 500, "fr": 300, "pl": 5}
    assert set(langdata.labelled_sentences(df, most_texts=100)) == {"de", "fr", "pl"}
    assert langdata.labelled_texts(df.limit(0), "lang", "text", 100) == {}
    assert len(langdata.labelled_texts(spark.createDataFrame([(1, "de", "same")] * 400, df.schema), "lang", "text", 100).get("de", [])) <= 100


@pytest.mark.parametrize("label", ["de-DE", " ger\t", "DEUTSCH", "en_US", "und", "??", "", None, "x-none", "fr@euro", "русский"])
def test_label_column_is_the_same_rule(spark, label):
    df = spark.createDataFrame([(label,)], "t string")
    assert df.select(langdata.label_column(df["t"])).first()[0] == langdata.label_code(label)
