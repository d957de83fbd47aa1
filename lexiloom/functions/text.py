"""Text functions as Spark expressions; all stay in the JVM and can be used inside generated code.

A language other than `en` is treated as French throughout.
"""
from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.lexicons import ADJECTIVES, EDGE_SIGNS, ELISIONS, IRREGULAR_EN, STOP, SUFFIXES_EN, SUFFIXES_FR

#: White space as in Python's str.split and str.strip, as a character class.
WHITE = r"[\t-\r\x1c-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same signs one by one, for trimming without a regular expression.
WHITE_SIGNS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NOT_WORD = r"[^\p{L}\p{N}_]"


@lru_cache(1)
def _accent_table() -> tuple[str, str]:
    """Accented letters of the Latin blocks against their bases, by Unicode's own decompositions."""
    pairs = []
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(i):
            pairs.append((chr(i), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def trim(c: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.btrim(c, F.lit(WHITE_SIGNS))


def words(c: Column) -> Column:
    """The stretches between white space, in order, none empty."""
    return F.filter(F.split(c, f"{WHITE}+"), lambda x: x != "")


def strip_accents(c: Column) -> Column:
    """Without accents: Latin letters by table, combining marks by category. Ligatures and strokes stay."""
    return F.regexp_replace(F.translate(c, *_accent_table()), r"\p{Mn}", "")


def clean(c: Column) -> Column:
    """Letters, digits and underscores only, in lower case."""
    return F.lower(F.regexp_replace(c, NOT_WORD, ""))


def fold(c: Column) -> Column:
    """Lower case, without accents, ligatures spelt out."""
    return unligated(strip_accents(F.lower(c)))


def unligated(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))


def display(c: Column) -> Column:
    """A word without the signs around it."""
    return F.btrim(c, F.lit(EDGE_SIGNS))


def is_stop(c: Column, lang: str) -> Column:
    return strip_accents(c).isin(*STOP.get(lang, STOP["fr"]))


def is_adjective(c: Column, lang: str) -> Column:
    return strip_accents(F.lower(c)).isin(*ADJECTIVES.get(lang, ADJECTIVES["fr"]))


def _drop(w: Column, n) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def stem_en(w: Column) -> Column:
    """Stem of a cleaned, lower-case word: the irregular forms first, then the first rule that fires."""
    chain = None
    for suffix, longer, drop, add, single in SUFFIXES_EN:
        base = _drop(w, drop)
        if single:
            base = F.when((F.length(w) - drop >= 2) & (F.substring(w, F.length(w) - drop, F.lit(1)) == F.substring(w, F.length(w) - drop - 1, F.lit(1))), _drop(w, drop + 1)).otherwise(base)
        hit, value = w.endswith(suffix) & (F.length(w) > longer), F.concat(base, F.lit(add)) if add else base
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    rules = chain.when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), _drop(w, 1)).otherwise(w)
    return F.coalesce(F.try_element_at(_irregular(), w), rules)


def _irregular() -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, IRREGULAR_EN)), F.array(*map(F.lit, IRREGULAR_EN.values())))


def stem_fr(bare: Column) -> Column:
    """Stem of a cleaned, lower-case word without accents: the first suffix that leaves at least three letters."""
    chain = None
    for suffix, add in SUFFIXES_FR:
        hit = bare.endswith(suffix) & (F.length(bare) - len(suffix) >= 3)
        value = F.concat(_drop(bare, len(suffix)), F.lit(add)) if add else _drop(bare, len(suffix))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.when(bare.endswith("s") & ~bare.endswith("ss") & (F.length(bare) > 3), _drop(bare, 1)).otherwise(bare)


def stem_prepared(word: Column, bare: Column, lang: Column) -> Column:
    """Stem of a cleaned word, its accent-free form given, in the language of a column.

    Both forms are columns or fields worked out before, so that long rules hold no expression but their own."""
    return F.when(lang == "en", stem_en(word)).otherwise(stem_fr(bare))


def stem(c: Column, lang: str) -> Column:
    """Stem of a word; the empty string where fewer than two signs are left of it."""
    w = clean(c)
    return F.when(F.length(w) < 2, "").otherwise(stem_en(w) if lang == "en" else stem_fr(strip_accents(w)))


def is_stop_bare(bare: Column, lang: Column) -> Column:
    """Whether an accent-free word is a stop word of the language of a column."""
    return F.when(lang == "en", bare.isin(*STOP["en"])).otherwise(bare.isin(*STOP["fr"]))


def by_language(lang: Column, make) -> Column:
    """make(language) chosen by a column."""
    return F.when(lang == "en", make("en")).otherwise(make("fr"))


def bigrams(c: Column) -> Column:
    """The distinct pairs of neighbouring signs."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two words' bigrams; words of fewer than two signs are 1 if equal, else 0."""
    both, any_ = F.array_intersect(bigrams(a), bigrams(b)), F.array_union(bigrams(a), bigrams(b))
    return F.when((F.length(a) < 2) | (F.length(b) < 2), F.when(a == b, 1.0).otherwise(0.0)).otherwise(F.size(both) / F.size(any_))


def position_similarity(i: Column, n: Column, j: Column, m: Column) -> Column:
    """Likeness of place i among n words and place j among m words, both from 0."""
    return 1.0 - F.abs(i / n - j / m)


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))


def rounded(c: Column, places: int) -> Column:
    """Decimal rounding as Python's round and printf do it, for values from 0.1 on, where it was compared; round() itself differs on ties."""
    return F.call_function("format_number", c, F.lit("0." + "0" * places)).cast("double")


def prepared(c: Column) -> Column:
    """Array of (idx, surface, bare) of a text's words: cleaned, and cleaned without accents; a word of signs alone is empty.

    Cleaning runs once over the whole text, not word by word. The result is meant to become rows before any rule is applied,
    so that rules see plain columns: a filter that Catalyst pushes down would otherwise repeat the cleaning in every branch."""
    surface = lower_words(c)
    both = F.arrays_zip(F.split(surface, " ").alias("surface"), F.split(strip_accents(surface), " ").alias("bare"))
    return F.transform(both, lambda x, i: F.struct(i.alias("idx"), x["surface"].alias("surface"), x["bare"].alias("bare")))


def lower_words(c: Column) -> Column:
    """The text's cleaned words with one blank between them."""
    return F.lower(F.regexp_replace(F.regexp_replace(trim(c), f"{WHITE}+", " "), r"[^\p{L}\p{N}_ ]", ""))


def plain(c: Column, lang: Column) -> Column:
    """A text as retrieval sees it, in the language of a column: runs of letters and digits in lower case with one blank between
    them; in French the elided word before an apostrophe goes. It differs from `words`, which keeps hyphens and apostrophes
    together."""
    low = F.lower(c)
    text = F.when(lang == "en", low).otherwise(F.regexp_replace(low, rf"(^|[^\p{{L}}\p{{N}}])(?:{'|'.join(ELISIONS)})['’]", "$1"))
    return F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def analysed(c: Column, lang: Column) -> Column:
    """Array of (position, word, bare) of a text as retrieval sees it, in the language of a column; `with_words` has the same as rows."""
    text = plain(c, lang)
    both = F.arrays_zip(F.split(text, " ").alias("word"), F.split(strip_accents(text), " ").alias("bare"))
    placed = F.transform(both, lambda x, i: F.struct(i.alias("position"), x["word"].alias("word"), x["bare"].alias("bare")))
    return F.filter(placed, lambda x: x["word"] != "")


def bare(c: Column) -> Column:
    """strip_accents of a plain column; a text of single-byte signs is left as it is, unread."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(strip_accents(c))


def with_words(df: DataFrame, text: str) -> DataFrame:
    """df with a row for each word of a text as retrieval sees it, in the language of column lang: position, word, bare.

    Texts are worked out as columns before they become rows: within a generator or a lambda they would be worked out once for
    each place that they are named, without generated code."""
    staged = df.withColumn("plain_", plain(F.col(text), F.col("lang"))).withColumn("bare_", bare(F.col("plain_")))
    both = F.arrays_zip(F.split("plain_", " ").alias("word"), F.split("bare_", " ").alias("bare"))
    rows = staged.select(*df.columns, F.posexplode(both).alias("position", "both_"))
    return rows.select(*df.columns, "position", F.col("both_.word").alias("word"), F.col("both_.bare").alias("bare")).where("word <> ''")


def escape_html(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), c)
