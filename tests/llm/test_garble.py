import pytest

from sievewright.llm import garble

DE = "Sehr geehrte Damen und Herren, bitte überweisen Sie den Betrag für die Lüftungsgitter bis zum nächsten Montag. Mit freundlichen Grüßen. Über die Prüfgeräte sprachen wir zuletzt, größere Mengen wären nötig."
RU = "Уважаемые коллеги, просим перевести сумму до конца месяца. Счёт подлежит оплате и до сих пор не оплачен. Доставка ожидается завтра, товар прибыл повреждённым."
FR = "Chère équipe, vous trouverez ci-joint la facture échue, vérifiée par la société. Suite à votre message, le dossier est à l’étude. Nous annulons l’été prochain."
PL = "Dzień dobry, w załączeniu faktura wystawiona przez spółkę. Prosimy zapłacić kwotę do piątku, w przeciwnym razie dostawa zostanie wstrzymana. Państwa wiadomość została przyjęta."
EN = "Good morning, please find attached the invoice for the delivery. We’ll put the order on hold until payment. With reference to your letter we confirm the case."


def sample(text):
    return [s.strip() + "." for s in text.split(".") if s.strip()] * 8


@pytest.fixture(scope="module")
def mender():
    return garble.Mender(garble.fit({k: sample(v) for k, v in {"de": DE, "ru": RU, "fr": FR, "pl": PL, "en": EN}.items()}))


@pytest.mark.parametrize(("text", "right", "wrong"), [
    (DE, "utf-8", "cp1252"), (DE, "utf-8", "cp437"), (DE, "utf-8", "mac_roman"), (DE, "cp1252", "cp850"), (DE, "cp1252", "mac_roman"), (FR, "utf-8", "latin-1"),
    (RU, "utf-8", "latin-1"), (RU, "cp1251", "cp1252"), (RU, "cp1251", "koi8_r"), (RU, "koi8_r", "cp1251"), (PL, "iso8859_2", "latin-1"), (PL, "utf-8", "cp1250"),
])
def test_round_trip(mender, text, right, wrong):
    text = text.replace("’", "'") if right not in ("utf-8", "cp1252") else text
    bad = text.encode(right).decode(wrong, "replace")
    if "�" in bad:  # bytes that the wrong page leaves open
        bad = "".join(garble._codec(wrong)[1][b] for b in text.encode(right))
    out, chain = mender.mend(bad)
    assert out == text and chain


def test_garbled_twice_and_in_part(mender):
    twice = "Grüße aus München".encode().decode("cp1252").encode().decode("cp1252")
    assert mender.mend(twice)[0] == "Grüße aus München"
    part = "Mit freundlichen Grüßen\n\n" + "bitte überweisen Sie für größere Mengen".encode().decode("cp1252")
    assert mender.mend(part)[0] == "Mit freundlichen Grüßen\n\nbitte überweisen Sie für größere Mengen"


def test_lost_characters_count(mender):
    assert mender.mend("Gr��e f�r Sie") == ("Gr��e f�r Sie", "lost")


@pytest.mark.parametrize("text", ["", "plain", DE, RU, FR, PL, EN, "JOÃO TAVARÃES <jt@saobrasia.example>", "Ångsholm Ø-Trafik", "12 m² für 3 ½ € – № 5", "LOGÍSTICA", "ООО Klinghof"])
def test_clean_text_stays(mender, text):
    assert mender.mend(text) == (text, None)


def test_frame(spark, mender):
    model = garble.fit({"de": sample(DE)})
    df = spark.createDataFrame([(1, "fÃ¼r", "c", "r"), (1, "fÃ¼r", "c", "r"), (2, None, "c", None), (3, "", None, None), (4, "x" * 200_000 + " fÃ¼r", "c", "r")], "id int, text string, chain string, restored string")
    got = {r["id"]: (r["restored"], r["chain"] is not None) for r in garble.restore(df, "text", model).collect()}
    assert got == {1: ("für", True), 2: (None, False), 3: ("", False), 4: ("x" * 200_000 + " für", True)}
    assert garble.restore(df.limit(0), "text", model).count() == 0


def test_no_sentences_to_train_on():
    assert garble.Mender(garble.fit({})).mend("fÃ¼r")[0] in ("für", "fÃ¼r")
    assert garble.Mender(garble.fit({"de": ["kurz"]})).mend("plain") == ("plain", None)


def test_every_voted_step_is_described_under_all_languages(mender):
    assert mender.mend("die wir bis Montag. wir ⁿber È źródło") == ("die wir bis Montag. wir über È źródło", "cp1252 read as cp437")
    assert mender.mend("è ù ц╢ w wstrzymana. przez razie") == ("è ù ô w wstrzymana. przez razie", "utf-8 read as koi8_r")


def test_chain_whose_first_step_does_not_pay_alone(mender):
    """Both steps of a chain count together; all chains up to the longest are described."""
    text = "Bitte prüfen Sie die Gutschrift für größere Mengen, wir können später zahlen."
    once = text.encode("utf-8").decode("cp1252")
    twice = once.encode("utf-8").decode("cp850")
    first = [new for _, _, new in mender._undone(twice) if new == once]
    assert first, "the first step is a candidate"
    got, chain = mender.mend(twice)
    assert got == text and chain.count(";") == 1
    real = mender.length
    try:
        # were the first step alone to cost as much as nothing undone, the chain would still be found
        mender.length = lambda t, below=1e9: real(twice) + 50 if t == once else real(t, below)
        assert mender.mend(twice)[0] == text
    finally:
        mender.length = real


def test_lost_characters_are_told_by_length(mender):
    got, chain = mender.mend("Die Rechnung f\ufffdr Mai liegt bei.")
    assert chain == "lost" and "\ufffd" in got
    assert mender.mend("Die Rechnung liegt bei.") == ("Die Rechnung liegt bei.", None)
