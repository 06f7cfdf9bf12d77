import random
import unicodedata

import numpy as np
import pyarrow as pa

from sievewright.llm import uniform
from sievewright.llm.arrowtext import code_points, slices, strings


def run(texts):
    a = pa.array(texts, pa.string())
    out, starts, case = uniform.consistent(*code_points(a))
    return list(zip(strings(out, starts, a.is_valid().to_numpy(zero_copy_only=False)).to_pylist(), case.tolist()))


def test_cases_and_what_stays():
    assert run(["Ｇｕｔ　ＬＳ－１", "über", "a​b­c", "a b c", "Lіеfеrung", "ЅАЅ Rotbаch", "Зaречторг", "𝗥𝗲𝗰𝗵", "①"]) == [("Gut LS-1", True), ("über", True), ("abc", True), ("a b c", True), ("Lieferung", True), ("SAS Rotbach", True), ("Заречторг", True), ("Rech", True), ("1", True)]
    for same in ("", "plain", "Grüße", "ООО Feldbach", "АО Оксмет", "x²½ﬁ№µ…–„“", "fГјr GrГјn", "pЕ‚atnoЕ›ci", "a\tb\r\n", "Ð\x9f", "Ã  b", "Р СѓС‡РµР№", "Вопрос о поставке"):
        assert run([same]) == [(same, False)]
    assert run([None]) == [(None, False)]


def test_marks_compose_as_in_the_standard():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aeoucnsAZ \n") + "".join(rng.choices("̧̨̀́̈̌", k=rng.randrange(2))) for _ in range(30)) for _ in range(50)]
    for (out, _), t in zip(run(texts), texts):
        assert out == unicodedata.normalize("NFC", t)


def test_stable_and_independent_of_neighbours():
    texts = ["́a", "b", None, "", "é", "е" * 3, "ｘ", "́"] * 3
    alone = [run([t])[0] for t in texts]
    assert run(texts) == alone
    assert [r[0] for r in run([o for o, _ in alone])] == [o for o, _ in alone]


def test_slices_cover_all_rows():
    n = np.array([5, 0, 10, 3, 3, 40, 1])
    parts = list(slices(n, 10))
    assert parts[0][0] == 0 and parts[-1][1] == len(n) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_frame(spark):
    long = "ａ" + "x" * 100_000
    df = spark.createDataFrame([(1, "ａ", "k", True), (1, "ａ", "k", True), (2, None, "k", None), (3, "", None, None), (4, long, "k", None)], "id int, text string, consistent string, inconsistent boolean")
    got = {r["id"]: (r["consistent"], r["inconsistent"]) for r in uniform.to_consistent(df, "text").collect()}
    assert got == {1: ("a", True), 2: (None, False), 3: ("", False), 4: ("a" + "x" * 100_000, True)}
    assert uniform.to_consistent(df.limit(0), "text").count() == 0
