import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import text as T


def one(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return row.select(expression.alias("x")).first().x


STEMS = {
    "en": "preaching preach running run gospels gospel salvation salv quickly quick lost lose found find won win seeing se calling cal need ne thing thing cities city glass glass",
    "fr": "perdus perdu gagnant gagn raisons raison chanteuses chanteux église eglise années anne très tre des des",
}


@pytest.mark.parametrize("lang", STEMS)
def test_stems(spark, lang):
    words = STEMS[lang].split()
    cases = dict(zip(words[::2], words[1::2])) | {"a": ""}
    got = spark.createDataFrame([(w,) for w in cases], "w string").select("w", T.stem(F.col("w"), lang).alias("s")).collect()
    assert {r.w: r.s for r in got} == cases


def test_clean_display_words(spark):
    cases = {"word,": "word", "don't": "dont", "«évangile»": "évangile", "l'Église": "léglise", "soul-winning": "soulwinning", "—": ""}
    got = spark.createDataFrame([(w,) for w in cases], "w string").select("w", T.clean(F.col("w")).alias("c"), T.display(F.col("w")).alias("d")).collect()
    assert {r.w: r.c for r in got} == cases and {r.w: r.d for r in got}["«évangile»"] == "évangile"
    both = F.struct(T.words(F.col("w")).alias("words"), T.trim(F.col("w")).alias("trimmed"))
    x = one(spark, both, w=" \u3000 a\tb\u00a0c\x1cd \n")
    assert x.words == ["a", "b", "c", "d"] and x.trimmed == "a\tb\u00a0c\x1cd"
    assert one(spark, T.words(F.col("w")), w="") == []


def test_prepared_keeps_places(spark):
    got = one(spark, T.prepared(F.col("w")), w="  L'Été — est  là. ")
    assert [(x.idx, x.surface, x.bare) for x in got] == [(0, "lété", "lete"), (1, "", ""), (2, "est", "est"), (3, "là", "la")]


def test_stop_words_and_accents(spark):
    words = ["the", "gospel", "les", "évangile", "été", "à", "cœur", "e\u0301", "łø"]
    got = {r.w: (r.en, r.fr, r.bare) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.is_stop(F.col("w"), "en").alias("en"), T.is_stop(F.col("w"), "fr").alias("fr"), T.strip_accents(F.col("w")).alias("bare")).collect()}
    assert got["the"][0] and not got["gospel"][0] and got["les"][1] and got["à"][1] and not got["évangile"][1] and not got["été"][1]
    assert [got[w][2] for w in words[3:]] == ["evangile", "ete", "a", "cœur", "e", "łø"]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=1, max_codepoint=0x24F, exclude_categories=("Cs",)), max_size=12), min_size=20, max_size=60))
def test_functions_agree_with_unicode(spark, texts):
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.words(F.col("t")).alias("w"), T.strip_accents(F.col("t")).alias("s"), T.trim(F.col("t")).alias("r")).collect()
    for r in rows:
        assert r.w == r.t.split()
        assert r.r == r.t.strip()
        assert r.s == "".join(c for c in unicodedata.normalize("NFD", r.t) if unicodedata.category(c) != "Mn") or unicodedata.normalize("NFC", r.t) != r.t


def test_similarity(spark):
    sim = T.bigram_similarity(F.col("a"), F.col("b"))
    assert one(spark, sim, a="night", b="nacht") == pytest.approx(1 / 7)
    assert [one(spark, sim, a=a, b=b) for a, b in (("a", "a"), ("a", "ab"), ("aaaa", "aa"))] == [1.0, 0.0, 1.0]
    assert one(spark, T.length_ratio(F.col("a"), F.col("b")), a="four", b="église") == pytest.approx(4 / 6)


def test_rounding_is_of_the_binary_value(spark):
    values = [0.11875, 2 / 3, 0.03125, 1.0, 0.5]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", T.rounded(F.col("x"), 4).alias("r")).collect()
    assert {r.x: r.r for r in got} == {x: round(x, 4) for x in values}


def test_analysis_for_retrieval(spark):
    got = spark.createDataFrame([("fr", "L'évangile de l’Église"), ("en", "The soul-winning: lost!")], "lang string, t string").select(T.analysed(F.col("t"), F.col("lang")).alias("x")).collect()
    assert [[(w.position, w.word, w.bare) for w in r.x] for r in got] == [[(0, "évangile", "evangile"), (1, "de", "de"), (2, "église", "eglise")], [(0, "the", "the"), (1, "soul", "soul"), (2, "winning", "winning"), (3, "lost", "lost")]]


def test_escape_html(spark):
    assert one(spark, T.escape_html(F.col("w")), w="a<b & c>d") == "a&lt;b &amp; c&gt;d"
