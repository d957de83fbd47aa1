"""Queries of the training-data operators, with their SQL where there is one."""
from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.llm import alignment, cooccurrence, encoding, formatting, lookalike, markup, mixing, splitting
from lexiloom.sources.tables import spread, table


def p1_found(spark, folder):
    """Segments of the two versions of a work that render one another."""
    pairs = p1_aligned(spark, folder)
    return pairs.select(F.least("segment_en", "segment_fr").alias("segment_a"), F.greatest("segment_en", "segment_fr").alias("segment_b"))


def p1_aligned(spark, folder):
    """The same pairs by language, with a score."""
    return alignment.align(table(spark, folder, "books"), spread(table(spark, folder, "segments")), spread(table(spark, folder, "aligned_book")), stored=table(spark, folder, "alignments"))


def p2_found(spark, folder):
    """English and French stems that occur together in at least 5 records and 6 times as often as by chance: the operator's pairs with
    their surprise under false-discovery control, of which the exact definition then keeps its own; surprise drops none of those."""
    pairs = cooccurrence.cooccurring(spread(table(spark, folder, "pair_stems")), min_count=5, min_lift=6)
    exact = (F.col("n_ab") >= 5) & (F.col("n_ab") * F.col("n_records") >= 6 * F.col("n_a") * F.col("n_b"))
    return pairs.where(exact).select(F.concat(F.lit("en:"), "left").alias("item_a"), F.concat(F.lit("fr:"), "right").alias("item_b"))


def p2_pairs(spark, folder):
    """All pairs of an English and a French stem that occur together, with counts, lift, expectation, tail and q value."""
    return cooccurrence.cooccurring(spread(table(spark, folder, "pair_stems")))


def p2_counts(spark, folder):
    """Exact counts and lift of all pairs of an English and a French stem that occur together."""
    return p2_pairs(spark, folder).select("left", "right", "n_ab", "n_a", "n_b", "n_records", "lift")


def p2_lexicon(spark, folder):
    """Right values for the stored lexicon: counts and Dice score of every pair from 0.1 on, in both directions."""
    return cooccurrence.translations(spread(table(spark, folder, "pair_stems")))


def p4_found(spark, folder):
    """Headings, list items, code blocks and formulas of the book files."""
    return markup.markup_elements(spread(table(spark, folder, "book_interior")))


def p4_clean(spark, folder):
    """Clean text of the book files."""
    return markup.markup_clean(spread(table(spark, folder, "book_interior")))


def p3_found(spark, folder):
    """Copies of aligned pairs that differ only in formatting or in which column holds which text."""
    return formatting.formatting_copies(spread(table(spark, folder, "aligned_book")))


def p3_records(spark, folder):
    """One row for each record of aligned_book, with its number of copies."""
    return formatting.collapse_formatting(spread(table(spark, folder, "aligned_book")))


def p5_found(spark, folder):
    """Pairs of segments that look the same but are stored differently."""
    return lookalike.lookalike_pairs(spread(table(spark, folder, "segments")))


def p5_classes(spark, folder):
    """Segments that look like others stored differently: their class and number of links."""
    return lookalike.lookalike_classes(spread(table(spark, folder, "segments")))


def p5_unified(spark, folder):
    """Every segment's text in one consistent form."""
    return lookalike.unify_lookalikes(spread(table(spark, folder, "segments")))


def p6_ids(spark, folder):
    """Token ids of every document by byte_bpe_50k."""
    return encoding.encode_ids(spread(table(spark, folder, "documents")))


def p6_round_trip(spark, folder):
    """Texts decoded from the ids; equal to the texts, null read as empty."""
    return encoding.decode_ids(p6_ids(spark, folder))


def p7_mix(spark, folder):
    """Documents of each mix, with the number of copies."""
    return mixing.mix_sources(spread(table(spark, folder, "documents")), table(spark, folder, "mix_targets"))[0]


def p7_report(spark, folder):
    """Target and actual share of each source of each mix."""
    return mixing.mix_sources(spread(table(spark, folder, "documents")), table(spark, folder, "mix_targets"))[1]


def p8_pieces(spark, folder):
    """Pieces of the documents above each limit."""
    return splitting.split_texts(spread(table(spark, folder, "documents")), table(spark, folder, "split_limits"))


QUERIES = {f.__name__: f for f in (p1_found, p1_aligned, p2_found, p2_pairs, p2_counts, p2_lexicon, p3_found, p3_records, p4_found, p4_clean, p5_found, p5_classes, p5_unified, p6_ids, p6_round_trip, p7_mix, p7_report, p8_pieces)}

_FOLD = r"regexp_replace(lower({0}), '[\s\p{{Z}}\p{{P}}]', '', 'g')"
_RECORD = f"""(with folded as (select distinct row_id, coalesce('t' || {_FOLD.format('en')}, '') as a, coalesce('t' || {_FOLD.format('fr')}, '') as b from aligned_book where row_id is not null)
  select row_id, min(row_id) over (partition by least(a, b), greatest(a, b)) as first_id from folded)"""

_STEMS = """(with t as (select distinct pair_id, 'en' as lang, unnest(stems_en) as stem from pair_stems where pair_id is not null
    union select distinct pair_id, 'fr', unnest(stems_fr) from pair_stems where pair_id is not null), s as (select * from t where stem is not null),
  f as (select lang, stem, count(*) as n from s group by all),
  c as (select e.stem as en, r.stem as fr, count(*) as co from s e join s r on e.pair_id = r.pair_id and e.lang = 'en' and r.lang = 'fr' group by all)
  select en, fr, co, x.n as n_en, y.n as n_fr, 2.0 * co / (x.n + y.n) as dice, (select count(distinct pair_id) from pair_stems) as total
  from c join f x on x.lang = 'en' and x.stem = en join f y on y.lang = 'fr' and y.stem = fr)"""
_ROW = "select {a} as source_stem, '{a}' as source_lang, {b} as target_stem, '{b}' as target_lang, cast(printf('%.4f', dice) as double) as score, co as co_occurrence_count, n_{a} as source_count, n_{b} as target_count from c2"


#: Look-alikes as the SQL sees them, written down apart from the operator: signs with what they print as.
_SEEN = {
    "АВЕЅІЈКМНОРСТУХѴҮԌԚԜ": "ABESIJKMHOPCTУXVYGQW", "аеорсухѕіјһԁԛԝүӏ": "aeopcyxsijhdqwyl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX", "οϲϳνραιυγσ": "ocjvpaiuyo",
    "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000": " " * 15, "\u2010\u2011\ufe63": "---",
    "".join(map(chr, range(0xFF01, 0xFF5F))): "".join(map(chr, range(0x21, 0x7F))),
}


def _looks() -> str:
    """What a segment's text looks like, as SQL: single signs by translate, ligatures by replace, composition by NFC."""
    inner = "text"
    for joined, letters in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬆ", "st"), ("ﬅ", "st"), ("ĳ", "ij"), ("Ĳ", "IJ"), ("ǆ", "dž"), ("ǉ", "lj"), ("ǌ", "nj"), ("ǳ", "dz")):
        inner = f"replace({inner}, '{joined}', '{letters}')"
    gone = rf"regexp_replace({inner}, '[\p{{Cf}}\x{{FE00}}-\x{{FE0F}}\x{{34F}}]', '', 'g')"
    signs, letters = "".join(_SEEN), "".join(_SEEN.values())
    keep = [(a, b) for a, b in zip(signs, letters) if a != b]
    return "nfc_normalize(translate({}, '{}', '{}'))".format(gone, "".join(a for a, _ in keep), "".join(b for _, b in keep).replace("'", "''"))


def _oracles() -> dict[str, str]:
    return {
        "p5_found": f"with s as (select distinct id, text, {_looks()} as look from segments where id is not null and text is not null) select distinct a.id as segment_a, b.id as segment_b from s a join s b on a.look = b.look and a.id < b.id and a.text <> b.text",
        "p5_classes": f"with s as (select distinct id, text, {_looks()} as look from segments where id is not null and text is not null), c as (select look, min(id) as class_id, count(*) as n from s group by look having count(distinct text) > 1), f as (select look, text, count(*) as n from s group by all) select s.id, c.class_id, max(c.n - f.n) as n_links from s join c using (look) join f on f.look = s.look and f.text = s.text group by all",
        "p2_found": f"select 'en:' || en as item_a, 'fr:' || fr as item_b from {_STEMS} where co >= 5 and co * total >= 6 * n_en * n_fr",
        "p2_counts": f"select en as \"left\", fr as \"right\", co as n_ab, n_en as n_a, n_fr as n_b, total as n_records, co::double * total / n_en / n_fr as lift from {_STEMS}",
        "p2_lexicon": f"with c2 as (select * from {_STEMS} where dice >= 0.1) {_ROW.format(a='en', b='fr')} union all {_ROW.format(a='fr', b='en')}",
        "p3_found": f"select first_id, row_id as copy_id from {_RECORD} where row_id <> first_id",
        "p3_records": f"select r.first_id, b.en, b.fr, count(*) as n_copies from {_RECORD} r join (select distinct row_id, en, fr from aligned_book) b on b.row_id = r.first_id group by all",
        "p6_round_trip": "select doc_id, coalesce(text, '') as text from documents",
    }


ORACLES = _oracles()
