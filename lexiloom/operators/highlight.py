"""Which words of the aligned text translate a query: known translations, then place and likeness. Array expressions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T

#: Weights of likeness, place and length where a cognate was found, where none was, and in the relaxed pass.
COGNATE, FOREIGN, RELAXED = (0.5, 0.45, 0.05), (0.15, 0.70, 0.15), (0.15, 0.40, 0.45)
#: Likeness that makes a cognate; confidence in score and place below which the relaxed pass runs; its
#: thresholds for adjectives and other words; shortest hint; least score, window margin and least window of a phrase.
COGNATE_FROM, SURE_SCORE, SURE_PLACE, RELAX_ADJECTIVE, RELAX_OTHER = 0.3, 0.65, 0.75, 0.90, 0.95
SHORTEST_HINT, PHRASE_LEAST, MARGIN, LEAST_WINDOW = 4, 0.15, 2, 4


def _first(a: Column, hit) -> Column:
    """Index from 0 of the first element that fulfils the condition, or null."""
    return F.nullif(F.array_position(F.transform(a, lambda x: F.coalesce(hit(x), F.lit(False))), True), F.lit(0)) - 1


def word_position(source: Column, bare: Column, stem: Column) -> Column:
    """Index of a word in the source's analysed words, -1 if it isn't there: the same word, else the same stem, else a longer
    word that contains it; each way is tried over the whole text before the next."""
    same = _first(source, lambda x: x["bare"] == bare)
    akin = _first(source, lambda x: (x["clean"] != "") & (x["stem"] == stem))
    within = _first(source, lambda x: (F.length(x["bare"]) > F.length(bare)) & F.contains(x["bare"], bare))
    return F.coalesce(same, akin, within, F.lit(-1).cast("bigint")).cast("int")


def analysed(hits: DataFrame) -> DataFrame:
    """hits with asked (the query's words: clean, bare, stem), source (the text's words, likewise) and target (the
    aligned text's words: j, clean, bare, shown). Null texts have no words."""
    lang = F.col("lang")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))

    def analyse(c: str) -> Column:
        forms = F.transform(F.transform(T.words(empty(c)), lambda x: F.struct(x.alias("raw"), T.clean(x).alias("clean"))), lambda x: F.struct(x["raw"].alias("raw"), x["clean"].alias("clean"), T.strip_accents(x["clean"]).alias("bare")))
        return F.transform(forms, lambda x, j: F.struct(j.alias("j"), x["clean"].alias("clean"), x["bare"].alias("bare"), T.display(x["raw"]).alias("shown"), F.when(F.length(x["clean"]) < 2, "").otherwise(T.stem_prepared(x["clean"], x["bare"], lang)).alias("stem")))

    return hits.withColumns({"asked": F.filter(analyse("q"), lambda x: F.length(x["clean"]) >= 2), "source": analyse("text"), "target": analyse("alignment_text")})


def with_positions(found: DataFrame) -> DataFrame:
    """first_pos and last_pos: where the first and the last query word stand in the source; -1 if nowhere, null without words."""
    first, last = F.get(F.col("asked"), F.lit(0)), F.get(F.col("asked"), F.size("asked") - 1)
    return found.withColumns({"first_pos": F.when(F.size("asked") > 0, word_position(F.col("source"), first["bare"], first["stem"])), "last_pos": F.when(F.size("asked") > 0, word_position(F.col("source"), last["bare"], last["stem"]))})


def hint_match(hints: Column, target: Column, lang: Column) -> Column:
    """The first word, by hint and then by place, that is a hint or a compound that begins with one; null if none.

    Hints that are stop words of the aligned language or shorter than four signs don't count."""
    bare = F.transform(F.coalesce(hints, F.array().cast("array<string>")), lambda h: T.strip_accents(F.lower(h)))
    usable = F.filter(bare, lambda h: (F.length(h) >= SHORTEST_HINT) & ~F.when(lang == "en", T.is_stop(h, "fr")).otherwise(T.is_stop(h, "en")))
    shown = F.transform(target, lambda t: F.struct(t["shown"].alias("shown"), T.strip_accents(F.lower(t["shown"])).alias("bare")))
    hits = F.transform(usable, lambda h: F.get(F.filter(shown, lambda t: (t["bare"] == h) | F.contains(t["shown"], F.lit("-")) & F.startswith(t["bare"], F.concat(h, F.lit("-")))), F.lit(0))["shown"])
    return F.get(F.filter(hits, F.isnotnull), F.lit(0))


def candidates(found: DataFrame) -> DataFrame:
    """scored: the target's words of two signs at least, with likeness, place and length against a one-word query."""
    q = F.get(F.col("asked"), F.lit(0))
    kept = F.filter("target", lambda t: (F.length(t["clean"]) >= 2) & (t["shown"] != ""))
    scored = F.transform(kept, lambda t: F.struct(t["shown"].alias("shown"), T.bigram_similarity(q["bare"], t["bare"]).alias("like"), T.position_similarity(F.col("first_pos"), F.size("source"), t["j"], F.size("target")).alias("place"), T.length_ratio(q["clean"], t["clean"]).alias("size")))
    return found.withColumn("scored", F.when((F.size("asked") == 1) & (F.col("first_pos") >= 0), scored))


def _weigh(x: Column, weights) -> Column:
    like, place, size = weights
    return like * x["like"] + place * x["place"] + size * x["size"]


def single(found: DataFrame) -> DataFrame:
    """one: the best candidate of a one-word query; null without any.

    The first of the best scores wins. Where no cognate was found and the word is an adjective, or neither score nor place
    is sure, a second pass in order lets each word replace the one before if its relaxed score comes near enough; the score
    to reach may fall on the way, so the order counts."""
    q = F.get(F.col("asked"), F.lit(0))
    state = "struct<best:double,shown:string,place:double>"
    start = F.struct(F.lit(-1.0).alias("best"), F.lit(None).cast("string").alias("shown"), F.lit(0.0).alias("place")).cast(state)
    most = F.col("most_like")
    step1 = found.withColumn("most_like", F.array_max(F.transform("scored", lambda x: x["like"])))

    def better(acc: Column, x: Column) -> Column:
        score = F.when(most < COGNATE_FROM, _weigh(x, FOREIGN)).otherwise(_weigh(x, COGNATE))
        return F.when(score > acc["best"], F.struct(score.alias("best"), x["shown"].alias("shown"), x["place"].alias("place")).cast(state)).otherwise(acc)

    step2 = step1.withColumn("sure", F.aggregate("scored", start, better)).withColumn("adjective", T.by_language(F.col("lang"), lambda x: T.is_adjective(q["clean"], x)))

    def relax(acc: Column, x: Column) -> Column:
        score = _weigh(x, RELAXED)
        near = score > acc["best"] * F.when(F.col("adjective"), RELAX_ADJECTIVE).otherwise(RELAX_OTHER)
        return F.when(near, F.struct(score.alias("best"), x["shown"].alias("shown"), acc["place"].alias("place")).cast(state)).otherwise(acc)

    unsure = (F.col("adjective") | ((F.col("sure.best") < SURE_SCORE) & (F.col("sure.place") < SURE_PLACE))) & (most < COGNATE_FROM)
    return step2.withColumn("one", F.when(unsure, F.aggregate("scored", F.col("sure"), relax)).otherwise(F.col("sure"))["shown"]).drop("most_like", "sure", "adjective", "scored")


def phrase(found: DataFrame) -> DataFrame:
    """many: words of the stretch that the phrase's place maps to, by score, without repeats, at most 2n + 2 and at most 8."""
    n_source, n_target = F.size("source"), F.size("target")
    there = (F.size("asked") > 1) & (F.col("first_pos") >= 0) & (F.col("last_pos") >= 0)
    a, b = F.least("first_pos", "last_pos"), F.greatest("first_pos", "last_pos")
    low = F.greatest(F.lit(0), F.floor(a / n_source * n_target).cast("int") - MARGIN)
    high = F.least(n_target, F.floor((b + 1) / n_source * n_target).cast("int") + MARGIN)
    staged = found.withColumns({"low_": F.when(there, low), "high_": F.when(there, high)})
    wider = F.floor((LEAST_WINDOW - (F.col("high_") - F.col("low_"))) / 2).cast("int")
    narrow = F.col("high_") - F.col("low_") < LEAST_WINDOW
    staged = staged.withColumns({"from_": F.when(narrow, F.greatest(F.lit(0), F.col("low_") - wider)).otherwise(F.col("low_")), "to_": F.when(narrow, F.least(n_target, F.col("high_") + wider)).otherwise(F.col("high_"))})
    kept = F.filter("target", lambda t: (t["j"] >= F.col("from_")) & (t["j"] < F.col("to_")) & (F.length(t["clean"]) >= 2) & (t["shown"] != ""))
    center, half = (F.col("from_") + F.col("to_")) / 2, F.greatest(F.lit(1.0), (F.col("to_") - F.col("from_")) / 2)

    def scored(t: Column) -> Column:
        like = F.greatest(F.lit(0.0), F.array_max(F.transform("asked", lambda q: T.bigram_similarity(q["bare"], t["bare"]))))
        bonus = 1.0 - F.abs(t["j"] - center) / half * 0.3
        return F.struct(t["shown"].alias("shown"), t["j"].alias("j"), (like * bonus + F.least(F.lit(1.0), F.length(t["clean"]) / 8.0) * 0.2).alias("score"))

    order = lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise(F.when(x["j"] < y["j"], -1).when(x["j"] > y["j"], 1).otherwise(0))
    staged = staged.withColumn("ranked_", F.when(there, F.array_sort(F.transform(kept, scored), order)))
    shown = F.array_distinct(F.transform(F.filter("ranked_", lambda x: x["score"] >= PHRASE_LEAST), lambda x: x["shown"]))
    return staged.withColumn("many", F.slice(shown, 1, F.least(2 * F.size("asked") + 2, F.lit(8)))).drop("low_", "high_", "from_", "to_", "ranked_")


def highlights(hits: DataFrame) -> DataFrame:
    """hits (q, lang, text, alignment_text, hints) with alignment_highlights, an array that is empty where nothing was found.

    One query word: the first matching hint, else the best word by place and likeness. More: the phrase's words. None, or a
    text that is null or empty: nothing."""
    none = F.array().cast("array<string>")
    found = phrase(single(candidates(with_positions(analysed(hits)))))
    hint = hint_match(F.col("hints"), F.col("target"), F.col("lang"))
    one = F.coalesce(hint, F.col("one"))
    usable = (F.size("asked") > 0) & (F.size("source") > 0) & (F.size("target") > 0)
    chosen = F.when(~usable, none).when(F.size("asked") == 1, F.when(one.isNull(), none).otherwise(F.array(one))).otherwise(F.coalesce("many", none))
    return found.withColumn("alignment_highlights", chosen).drop("asked", "source", "target", "first_pos", "last_pos", "one", "many")
