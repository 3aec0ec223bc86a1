import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import textform as T

ALPHABET = "aeAoO éáâñأإآؤئیکگىي٠۵،ـًّٕ́̀̂̈̃ٔ‌‍​­﻿  ‐−–ﬁﬀﻻﷺＡ１％（аеосοѕӏɡıỗ①½가ㄱक़\n\t.-_"


@pytest.mark.parametrize(
    "text, want",
    [("ＡＢ１", "AB1"), ("é", "é"), ("ﬁn", "fin"), ("a​b c", "ab c"), ("сhat", "chat"), ("a‑b", "a-b"), ("كِتـاب", "كتاب"), ("إلى گ", "الي غ"), ("  x \n y ", "x y"), ("", ""), ("   ", ""), (None, None)],
)
def test_forms(text, want):
    assert T.consistent_form(text) == want


def test_both_implementations_agree(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 16))) for _ in range(1500)] + [None, "", "x" * 50_000 + "é", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["form"] for r in T.with_forms(df, {"text": "form"}).collect()}
    assert got == {i: T.consistent_form(t) for i, t in enumerate(texts)}


def test_korean_is_composed_alike(spark):
    """Decomposed, half-width and compatibility letters, and syllables, in any mix."""
    rng = random.Random(7)
    syllables = "".join(chr(rng.randrange(0xAC00, 0xD7A4)) for _ in range(300)) + "한국어가각"
    letters = unicodedata.normalize("NFD", syllables) + "ㄱㅏㄳㅎﾡￂﾾ각ᆨᅡ́a"
    texts = [syllables, unicodedata.normalize("NFD", syllables), *("".join(rng.choice(syllables + letters) for _ in range(12)) for _ in range(800))]
    df = spark.createDataFrame([(i, t, t if i % 2 else None) for i, t in enumerate(texts)], "id int, text string, other string").withColumn("_key", F.lit(0))
    rows = T.with_forms(df.drop("_key"), {"text": "form", "other": "other_form"}).collect()
    assert {r["id"]: (r["form"], r["other_form"]) for r in rows} == {i: (T.consistent_form(t), T.consistent_form(t if i % 2 else None)) for i, t in enumerate(texts)}
    pair = spark.createDataFrame([("a", "한국어"), ("b", unicodedata.normalize("NFD", "한국어"))], "name string, text string")
    assert [tuple(r) for r in T.look_alike_pairs(pair, "name", "text").collect()] == [("a", "b")]


def test_shuffled_dictionary_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(T, "DICTIONARY", -1)
    df = spark.createDataFrame([(1, "ﬁn é"), (2, "ＡＢ")], "id int, text string")
    assert {r["id"]: r["form"] for r in T.with_forms(df, {"text": "form"}).collect()} == {1: "fin é", 2: "AB"}


def test_form_is_idempotent_and_composed():
    rng = random.Random(9)
    for _ in range(500):
        f = T.consistent_form("".join(rng.choice(ALPHABET) for _ in range(10)))
        assert T.consistent_form(f) == f and unicodedata.normalize("NFC", f) == f


def test_pairs_against_brute_force(spark):
    rows = [("a", "ﬁn"), ("b", "fin"), ("c", "fin"), ("d", "Fin"), ("e", "..."), ("f", "．．．"), ("g", None), ("h", ""), ("b", "fin"), ("i", "f​in"), (None, "ﬁn")]
    got = {tuple(r) for r in T.look_alike_pairs(spark.createDataFrame(rows, "name string, text string").withColumn("key", F.lit(1)), "name", "text").collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "i"), ("b", "i"), ("c", "i")}


def test_empty_table(spark):
    assert T.look_alike_pairs(spark.createDataFrame([], "name string, text string"), "name", "text").count() == 0
