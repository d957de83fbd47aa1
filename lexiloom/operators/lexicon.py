"""The translation lexicon: stems that share sentence pairs, scored by the Dice coefficient, and the hints looked up in it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.lexicons import LANGUAGES
from lexiloom.plans.skew import join_many, join_unique
from lexiloom.plans.staging import cut

#: Least Dice coefficient, before rounding.
LEAST_DICE = 0.1
#: Translations looked up for a word.
LOOKUP_LIMIT = 5


def tokens(docs: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, lang, idx, surface, bare) of both texts' words, idx from 0; surface has letters, digits and underscores, in lower case."""
    sides = F.array(*(F.struct(F.lit(x).alias("lang"), T.prepared(F.col(f"text_{x}")).alias("words")) for x in LANGUAGES))
    return docs.select(key, F.inline(sides)).select(key, "lang", F.inline("words"))


def stems(docs: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, lang, idx, stem, surface) of the words that count: two signs at least, no stop word, a stem of two signs at least."""
    lang = F.col("lang")
    kept = tokens(docs, key).where(F.length("surface") >= 2).where(~T.is_stop_bare(F.col("bare"), lang))
    return kept.withColumn("stem", T.stem_prepared(F.col("surface"), F.col("bare"), lang)).where(F.length("stem") >= 2).select(key, "lang", "idx", "stem", "surface")


def memberships(found: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, lang, stem), each once."""
    return found.select(key, "lang", "stem").distinct()


def frequencies(held: DataFrame) -> DataFrame:
    """(lang, stem, n): in how many pairs a stem occurs."""
    return held.groupBy("lang", "stem").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(held: DataFrame, key: str = "pair_id") -> DataFrame:
    """(en, fr, co): in how many pairs an English stem stands with a French one.

    Pairs are counted where they are formed, before the shuffle, and a pair_id with a large part of all stems is dealt out over
    many tasks."""
    held = cut(held)
    en = held.where("lang = 'en'").select(key, F.col("stem").alias("en"))
    fr = held.where("lang = 'fr'").select(key, F.col("stem").alias("fr"))
    return join_many(en, fr, key, "en").groupBy("en", "fr").agg(F.count(F.lit(1)).alias("co"))


def _dice(a: str, b: str) -> Column:
    return 2.0 * F.col("co") / (F.col(a) + F.col(b))


def lexicon(docs: DataFrame, key: str = "pair_id", least: float = LEAST_DICE) -> DataFrame:
    """(source_stem, source_lang, target_stem, target_lang, score, co_occurrence_count, source_count, target_count), both directions.

    Kept where the unrounded Dice coefficient is at least `least`; the score has four decimals. Texts are stemmed once.
    Each stem carries its frequency into the pairs, so pairs that can't reach `least` even if the rarer stem never stood
    without the other are gone before they are counted."""
    return lexicon_of(cut(memberships(stems(docs, key), key)), key, least)


def lexicon_of(held: DataFrame, key: str = "pair_id", least: float = LEAST_DICE) -> DataFrame:
    """The same from memberships (key, lang, stem), each once; held is read several times."""
    n = cut(frequencies(held))
    size = n.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows")).first()
    sized = cut(join_unique(held, n, ["lang", "stem"], "n", size.total or 0, size.rows))
    side = lambda x: sized.where(F.col("lang") == x).select(key, F.col("stem").alias(x), F.col("n").alias(f"n_{x}"))
    able = 2.0 * F.least("n_en", "n_fr") / (F.col("n_en") + F.col("n_fr")) >= least
    counted = join_many(side("en"), side("fr"), key, "en").where(able).groupBy("en", "fr", "n_en", "n_fr").agg(F.count(F.lit(1)).alias("co"))
    kept = counted.withColumn("dice", _dice("n_en", "n_fr")).where(F.col("dice") >= least).withColumn("score", T.rounded(F.col("dice"), 4))
    entry = lambda a, b: F.struct(F.col(a).alias("source_stem"), F.lit(a).alias("source_lang"), F.col(b).alias("target_stem"), F.lit(b).alias("target_lang"), F.col("score").alias("score"), F.col("co").alias("co_occurrence_count"), F.col(f"n_{a}").alias("source_count"), F.col(f"n_{b}").alias("target_count"))
    return kept.select(F.inline(F.array(entry("en", "fr"), entry("fr", "en"))))


def lexicon_for(words: DataFrame, found: DataFrame, key: str = "pair_id", least: float = LEAST_DICE) -> DataFrame:
    """The lexicon's rows whose source is a stem of words, the result of `query_words`; found is the result of `stems`, read several times.

    Only pairs that hold such a stem are joined, so the work follows what is asked, not the vocabulary."""
    held = cut(memberships(found, key))
    asked = words.select("lang", "stem").distinct()
    source = held.join(asked, ["lang", "stem"], "left_semi").select(key, F.col("lang").alias("source_lang"), F.col("stem").alias("source_stem"))
    target = held.select(key, F.col("lang").alias("target_lang"), F.col("stem").alias("target_stem"))
    counted = cut(join_many(cut(source), target, key, "source_stem").where("source_lang <> target_lang").groupBy("source_lang", "source_stem", "target_lang", "target_stem").agg(F.count(F.lit(1)).alias("co")))
    n = frequencies(held)
    of = lambda x: n.select(F.col("lang").alias(f"{x}_lang"), F.col("stem").alias(f"{x}_stem"), F.col("n").alias(f"{x}_count"))
    scored = counted.join(of("source"), ["source_lang", "source_stem"]).join(of("target"), ["target_lang", "target_stem"]).withColumn("dice", _dice("source_count", "target_count"))
    return scored.where(F.col("dice") >= least).select("source_stem", "source_lang", "target_stem", "target_lang", T.rounded(F.col("dice"), 4).alias("score"), F.col("co").alias("co_occurrence_count"), "source_count", "target_count")


def stem_forms(docs: DataFrame, key: str = "pair_id") -> DataFrame:
    """(stem, surface_form, language), each once."""
    return forms_of(stems(docs, key))


def forms_of(found: DataFrame) -> DataFrame:
    """(stem, surface_form, language) of the result of `stems`, each once."""
    return found.select("stem", F.col("surface").alias("surface_form"), F.col("lang").alias("language")).distinct()


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, lang, word_idx, word, stem) of the words of at least two signs of each query, stop words included."""
    placed = queries.select("query_id", "lang", F.inline(T.prepared(F.col("q")))).where(F.length("surface") >= 2)
    return placed.select("query_id", "lang", F.col("idx").alias("word_idx"), F.col("surface").alias("word"), T.stem_prepared(F.col("surface"), F.col("bare"), F.col("lang")).alias("stem"))


def lookup(queries: DataFrame, entries: DataFrame, limit: int = LOOKUP_LIMIT, words: DataFrame | None = None) -> DataFrame:
    """(query_id, lang, word_idx, rank, target_stem, score): the best translations of each query word, ties by stem.

    Entries with a null score are left out; repeated entries count once, by their best score. words: the result of `query_words`,
    if it is worked out already."""
    once = entries.where("score is not null").groupBy("source_stem", "source_lang", "target_stem").agg(F.max("score").alias("score"))
    asked = (query_words(queries) if words is None else words).select("query_id", "lang", "word_idx", F.col("stem").alias("source_stem"))
    best = Window.partitionBy("query_id", "word_idx").orderBy(F.desc("score"), "target_stem")
    return asked.join(once.withColumnRenamed("source_lang", "lang"), ["source_stem", "lang"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query_id", "lang", "word_idx", "rank", "target_stem", "score")


def other(lang: Column) -> Column:
    return F.when(lang == "en", "fr").otherwise("en")


def hints(queries: DataFrame, entries: DataFrame, forms: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(query_id, word_idx, rank, surface): words known to translate each query word, stop words among the stems left out
    after the limit, in the order of query word, score, stem and surface."""
    found = lookup(queries, entries, words=words).withColumn("target_lang", other(F.col("lang")))
    found = found.where(~T.is_stop_bare(T.strip_accents(F.col("target_stem")), F.col("target_lang")))
    known = forms.select(F.col("stem").alias("target_stem"), F.col("language").alias("target_lang"), F.col("surface_form").alias("surface")).distinct()
    return found.join(known, ["target_stem", "target_lang"]).select("query_id", "word_idx", "rank", "surface")


def corpus_hints(queries: DataFrame, found: DataFrame, key: str = "pair_id") -> DataFrame:
    """The same with the lexicon and the stem forms of the pairs themselves; found is the result of `stems`, read several times."""
    words = cut(query_words(queries))
    return hints(queries, lexicon_for(words, found, key), forms_of(found), words)


def hint_lists(found: DataFrame) -> DataFrame:
    """(query_id, hints): the surfaces in order, repeats kept. At most LOOKUP_LIMIT stems of a query word, so lists are short."""
    return found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "rank", "surface"))), lambda x: x["surface"]).alias("hints"))
