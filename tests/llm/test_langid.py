import random
import re

import numpy as np
import pytest

from pagework.llm import langid

ROOTS = {"aa": ["kor", "tul", "meb", "zan"], "bb": ["wiss", "shto", "prell", "och"], "cc": ["éla", "ñoa", "íue", "oó"]}


def text_of(numbers, lang, words):
    return " ".join("".join(numbers.choices(ROOTS[lang], k=numbers.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    numbers = random.Random(11)
    return [(i, text_of(numbers, lang, numbers.randrange(3, 60)), lang) for i in range(240) for lang in [numbers.choice("abc") * 2]]


@pytest.fixture(scope="module")
def model(spark, rows):
    from pagework.llm.common import ship_package

    ship_package(spark)
    more = [(900, None, "aa"), (901, "12 !", "bb"), (902, "kor tul", None)]
    return langid.fit(spark.createDataFrame(rows + more, "doc_id int, text string, lang string"), "doc_id", sample=200, count=12)


def test_kernels_equal_brute_force(model, rows):
    """Shared n-grams over the root of the product of the sizes, worked out with Python sets."""
    table = model.landmarks.table

    def grams(text):
        symbols = []
        for c in f" {text.lower()} ":
            s = int(table[ord(c)])
            if s or not symbols or symbols[-1]:
                symbols.append(s)
        return {tuple(symbols[i : i + n]) for n in (1, 2, 3) for i in range(len(symbols) - n + 1)}

    texts = [t for _, t, _ in rows[:20]] + ["x", "Ünknown %% léttérs!", ""]
    marks = langid.landmarks(texts[:6])
    table = marks.table
    got, lettered = marks.kernels(texts)
    expected = [[len(grams(t) & grams(m)) / np.sqrt(len(grams(t)) * len(grams(m))) for m in texts[:6]] for t in texts]
    assert got == pytest.approx(np.array(expected), abs=1e-5)
    assert lettered.tolist() == [True] * 22 + [False]


def test_held_out_accuracy(model):
    numbers = random.Random(99)
    texts = [(lang, text_of(numbers, lang, 8)) for lang in ROOTS for _ in range(60)]
    found, score = model.predict([t for _, t in texts])
    assert np.mean([a == b for a, (b, _) in zip(found, texts)]) >= 0.97
    assert ((score > 1 / 3) & (score <= 1)).all()


@pytest.fixture(scope="module")
def scripts():
    """Six languages with alphabets of their own, of which the last three have the rarer letters."""
    numbers = random.Random(5)
    alphabets = {"la": "abcdefghijklmnopqrstuvwxyzáéíóúñçüäö", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω"}
    alphabets |= {"zh": "".join(map(chr, range(0x4E00, 0x4E60))), "ja": "".join(map(chr, range(0x3041, 0x3091))), "ko": "".join(map(chr, range(0xAC00, 0xAC60)))}
    return numbers, alphabets, lambda lang, n: " ".join("".join(numbers.choices(alphabets[lang], k=numbers.randrange(2, 7))) for _ in range(n))


def test_every_script_keeps_its_letters(spark, scripts):
    numbers, alphabets, text = scripts
    usual = [*["la", "ru", "el"] * 8, "zh", "ja", "ko"]
    rows = [(i, text(lang, 30 if lang in ("la", "ru", "el") else 6), lang) for i, lang in enumerate(usual * 12)]
    fitted = langid.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"), "doc_id", count=48)
    asked = [(lang, text(lang, 8)) for lang in alphabets for _ in range(30)]
    found, _ = fitted.predict([t for _, t in asked])
    assert {lang: np.mean([f == lang for f, (a, _) in zip(found, asked) if a == lang]) for lang in alphabets} == dict.fromkeys(alphabets, 1.0)


def test_kernels_of_scripts_and_long_texts(scripts, monkeypatch):
    """Equal to sets of the letters themselves, also where a text is cut into pieces and the n-grams into parts."""
    _, alphabets, text = scripts

    def grams(t):
        t = re.sub(r"[\W\d_]+", " ", f" {t.lower()} ")
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    texts = [text(lang, n) for lang in alphabets for n in (1, 40, 400)] * 5
    expected = [[len(grams(t) & grams(m)) / np.sqrt(len(grams(t)) * len(grams(m))) for m in texts[:18]] for t in texts]
    for piece, part in ((1 << 19, 1 << 14), (50, 64)):
        monkeypatch.setattr(langid, "PIECE", piece)
        monkeypatch.setattr(langid, "PART", part)
        assert langid.landmarks(texts[:18]).kernels(texts)[0] == pytest.approx(np.array(expected), abs=1e-5)


def test_table(spark, model, long_text):
    rows = [(1, None, "x"), (2, "", None), (3, "12 -- 34", "x"), (4, "kor tul meb zan kor", "x"), (4, "kor tul meb zan kor", "x"), (None, long_text, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang_pred string")
    found = langid.predict(df, model, ["doc_id"]).collect()
    assert [(r["lang_pred"], r["score"]) for r in found if r["doc_id"] in (1, 2, 3)] == [("und", 0.0)] * 3
    assert len({tuple(r) for r in found if r["doc_id"] == 4}) == 1 and len(found) == 6
    assert {r["lang_pred"] for r in found if r["doc_id"] == 4} == {"aa"}
    assert langid.predict(df.limit(0), model, ["doc_id"]).collect() == []


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a", None)], "doc_id int, text string, lang string")
    for rows in (df, df.limit(0)):
        nothing = langid.fit(rows, "doc_id")
        assert sorted(map(tuple, langid.predict(df, nothing, ["doc_id"]).collect())) == [(1, "und", 0.0), (2, "und", 0.0)]
        assert langid.predict(df.limit(0), nothing, ["doc_id"]).collect() == []


def test_a_hot_key_does_not_make_the_sample_larger(spark, rows):
    from pagework.llm.common import bounded_sample, spread_key

    df = spark.range(9000).selectExpr("if(id < 6000, 1, id) as doc_id", "cast(id as string) as text").withColumn("order", spread_key("doc_id"))
    for count in (1, 100, 4000, 9000, 20_000):
        found = bounded_sample(df, "order", count).collect()
        assert len(found) == min(count, 9000) and {r["text"] for r in found} == {r["text"] for r in bounded_sample(df.repartition(3), "order", count).collect()}
    assert bounded_sample(df.limit(0), "order", 5).collect() == []


def test_batches_do_not_matter(model, rows):
    texts = [t for _, t, _ in rows]
    one = [model.predict([t])[0][0] for t in texts[:80]]
    assert model.predict(texts[:80])[0] == one
