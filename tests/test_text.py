import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, want",
    [("ASD screening at 18 months", "en"), ("فحص التوحد", "ar"), ("", "unknown"), (None, "unknown"), ("12345", "unknown"), ("aaaaaaaaaa ببب", "mixed")],
)
def test_detect_language(spark, text, want):
    assert one(spark, text, T.detect_language) == want


@pytest.mark.parametrize(
    "text, want",
    [("أ إ آ", "ا ا ا"), ("ى ی", "ي ي"), ("١٢٣٤٥", "12345"), ("، ؛ ؟", ", ; ?"), ("  a   b\n", "a b"), ("كِتَابـــ", "كتاب"), ("", ""), (None, None)],
)
def test_normalize_arabic(spark, text, want):
    assert one(spark, text, T.normalize_arabic) == want


def test_ta_marbuta_is_an_option(spark):
    assert one(spark, "مدرسة", T.normalize_arabic) == "مدرسة"
    assert one(spark, "مدرسة", lambda c: T.normalize_arabic(c, ta_marbuta=True)) == "مدرسه"


def test_latin_keeps_case_and_drops_controls(spark):
    assert one(spark, " A\x07 \t b\x7f ", T.normalize_latin) == "A b"
    assert one(spark, "café x", T.strip_latin1) == "caf x"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abأإéﬁ１٣ \t​،", max_size=12), min_size=1, max_size=20))
def test_normalizer_is_idempotent_and_composes(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    rows = df.select("x", T.normalize_arabic(F.col("x"), compose=True).alias("a")).select("x", "a", T.normalize_arabic(F.col("a"), compose=True).alias("b"), T.nfkc(F.col("x")).alias("n")).collect()
    for r in rows:
        assert r["a"] == r["b"]
        assert r["n"] == unicodedata.normalize("NFKC", r["x"])


def test_tokens_split_at_marks_and_keep_unicode(spark):
    assert one(spark, "Café-au_lait, 3x!", T.tokens) == ["café", "au_lait", "3x"]
    assert one(spark, "", T.tokens) == []
    assert one(spark, None, T.tokens) is None


def test_sentences_and_key_terms(spark):
    assert one(spark, "One. Two! Three", T.sentences) == ["One.", "Two!", "Three"]
    assert sorted(one(spark, "reunión from This that 4four", T.key_terms)) == ["from", "that", "this"]


def test_token_f1_and_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["b"]), (["a"], ["b"])], "a array<string>, b array<string>")
    got = df.select(T.token_f1(F.col("a"), F.col("b")), T.jaccard(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.5, 1 / 3), (0.0, 0.0), (0.0, 0.0)]


def test_acronyms_in_order(spark):
    assert one(spark, "M-CHAT-R/F by WHO", T.expand_acronyms) == "Modified Checklist for Autism in Toddlers-R/F by World Health Organization"


def test_synonyms(spark):
    assert set(one(spark, "Core symptoms", T.expand_synonyms)) == {"core", "symptoms", "primary", "main", "essential", "signs", "features", "characteristics"}


def test_sanitizers(spark):
    assert one(spark, "a ![x](y.png) <IMG src=1> figure.PNG b", T.sanitize_chunk) == "a    b"
    assert one(spark, "<think>x\ny</think> z", T.strip_thinking) == "z"
    assert one(spark, "ok\nI Cannot read this image here\nend\n\n\n\nx", T.sanitize_answer) == "ok\nend\n\nx"
    assert one(spark, None, T.sanitize_answer) is None


def test_names_and_prefix(spark):
    assert one(spark, "myReport_v2.pdf", T.pretty_name) == "my Report v2"
    assert one(spark, "hi", lambda c: T.query_prefix(c, F.lit("ar"))) == "searchify: hi"


def test_related_names(spark):
    rows = spark.createDataFrame([("Doc A", "doc"), ("x", "DOC x y"), ("", "a"), ("a", "b")], "a string, b string")
    assert [r[0] for r in rows.select(T.related(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]
