"""The catalogue's queries as DuckDB SQL over the same tables, built from common table expressions."""
from __future__ import annotations

from lexiloom.functions import sql as S
from lexiloom.functions.lexicons import STOP
from lexiloom.operators.ingest import BOOK_ID, BOOK_TITLE
from lexiloom.plans.samples import row_sql, sample_sql

_A, _B = S.trim("coalesce(en, '')"), S.trim("coalesce(fr, '')")

#: Common table expressions by name; each may use those before it.
CTE = {
    "kept": f"select * from (select row_id, {_A} as text_en, {_B} as text_fr from aligned_book) where text_en <> '' and text_fr <> ''",
    "docs": f"select row_number() over (order by row_id nulls first, text_en, text_fr) as pair_id, text_en, text_fr from kept",
    "langs": "select 'en' as lang, pair_id, pair_id as position, 2 * pair_id - 1 as segment_id, 2 * pair_id as alignment_id, text_en as text, text_fr as alignment_text, 'fr' as alignment_lang from docs union all select 'fr', pair_id, pair_id, 2 * pair_id, 2 * pair_id - 1, text_fr, text_en, 'en' from docs",
    "surfaces": f"select distinct lang, unnest(words) as word from (select 'en' as lang, {S.words('text_en')} as words from kept union all select 'fr', {S.words('text_fr')} from kept)",
    "cleaned": f"select distinct lang, {S.clean('word')} as clean from surfaces",
    "tokens": f"select row_id, lang, unnest(range(len(words))) as idx, {S.clean('unnest(words)')} as surface from (select row_id, 'en' as lang, {S.words('text_en')} as words from kept union all select row_id, 'fr', {S.words('text_fr')} from kept)",
    "lex_words": f"select lang, surface, case when lang = 'en' then {S.is_stop('surface', 'en')} else {S.is_stop('surface', 'fr')} end as stop, case when lang = 'en' then {S.stem_en('surface')} else {S.stem_fr('surface')} end as stem from (select distinct lang, surface from tokens where length(surface) >= 2)",
    "stems": "select t.row_id, t.lang, t.idx, w.stem, t.surface from tokens t join lex_words w using (lang, surface) where not w.stop and length(w.stem) >= 2",
    "held": "select distinct row_id, lang, stem from stems",
    "freq": "select lang, stem, count(*) as n from held group by all",
    "co": "select e.stem as en, f.stem as fr, count(*) as co from held e join held f on e.row_id = f.row_id and e.lang = 'en' and f.lang = 'fr' group by all",
    "dice": "select en, fr, co, x.n as n_en, y.n as n_fr, 2.0 * co / (x.n + y.n) as dice from co join freq x on x.lang = 'en' and x.stem = en join freq y on y.lang = 'fr' and y.stem = fr where 2.0 * co / (x.n + y.n) >= 0.1",
    "lexicon": "select en as source_stem, 'en' as source_lang, fr as target_stem, 'fr' as target_lang, {r} as score, co as co_occurrence_count, n_en as source_count, n_fr as target_count from dice union all select fr, 'fr', en, 'en', {r}, co, n_fr, n_en from dice".format(r=S.rounded("dice", 4)),
    "forms": "select distinct stem, surface as surface_form, lang as language from stems",
    "queries": f"select * from {sample_sql()}",
    "qwords": f"select query_id, lang, word_idx, word, case when lang = 'en' then {S.stem_en('word')} else {S.stem_fr('word')} end as stem from (select query_id, lang, unnest(range(len(w))) as word_idx, {S.clean('unnest(w)')} as word from (select query_id, lang, {S.words('q')} as w from queries)) where length(word) >= 2",
    "best": "select source_stem, source_lang, target_stem, max(score) as score from lexicon group by all",
    "looked": "select * from (select q.query_id, q.lang, q.word_idx, row_number() over (partition by q.query_id, q.word_idx order by b.score desc, b.target_stem) as rank, b.target_stem, b.score from qwords q join best b on b.source_stem = q.stem and b.source_lang = q.lang) where rank <= 5",
    "hints": f"select distinct l.query_id, l.word_idx, l.rank, f.surface_form as surface from looked l join forms f on f.stem = l.target_stem and f.language = case when l.lang = 'en' then 'fr' else 'en' end where not case when l.lang = 'en' then {S.is_stop('l.target_stem', 'fr')} else {S.is_stop('l.target_stem', 'en')} end",
    "stored_best": "select source_stem, source_lang, target_stem, max(score) as score from word_translations where score is not null group by all",
    "stored_looked": "select * from (select q.query_id, q.lang, q.word_idx, row_number() over (partition by q.query_id, q.word_idx order by b.score desc, b.target_stem) as rank, b.target_stem, b.score from qwords q join stored_best b on b.source_stem = q.stem and b.source_lang = q.lang) where rank <= 5",
    "raw": f"select lang, pair_id, unnest(range(len(w))) as position, unnest(w) as word from (select lang, pair_id, case when lang = 'en' then {S.raw_terms('text', 'en')} else {S.raw_terms('text', 'fr')} end as w from langs)",
    "raw_words": f"select lang, word, case when lang = 'en' then {S.is_stop('word', 'en')} else {S.is_stop('word', 'fr')} end as stop, case when lang = 'en' then {S.stem_en('word')} else {S.stem_fr('word')} end as term from (select distinct lang, word from raw union select lang, word from qraw)",
    "qraw": f"select query_id, lang, unnest(range(len(w))) as position, unnest(w) as word from (select query_id, lang, case when lang = 'en' then {S.raw_terms('q', 'en')} else {S.raw_terms('q', 'fr')} end as w from queries)",
    "posted": "select r.lang, r.pair_id, w.term, r.position from raw r join raw_words w using (lang, word) where not w.stop",
    "tf": "select lang, term, pair_id, count(*) as tf from posted group by all",
    "dl": "select lang, pair_id, count(*) as dl from posted group by all",
    "whole": "select lang, n_docs, total::double / n_docs as avg_dl from (select lang, count(*) as n_docs from langs group by all) join (select lang, count(*) as total from posted group by all) using (lang)",
    "stats": "select lang, term, count(*) as df from tf group by all",
    "asked": "select query_id, lang, term, position, n_terms from (select q.query_id, q.lang, w.term, q.position from qraw q join raw_words w using (lang, word) where not w.stop) join (select q.query_id, count(distinct w.term) as n_terms from qraw q join raw_words w using (lang, word) where not w.stop group by all) using (query_id)",
    "expanded": "select a.query_id, a.lang, a.qterm, s.term, levenshtein(a.qterm, s.term)::int as edits, s.df from (select distinct query_id, lang, term as qterm from asked) a join stats s on s.lang = a.lang and levenshtein(a.qterm, s.term) <= case when length(a.qterm) < 3 then 0 when length(a.qterm) <= 5 then 1 else 2 end",
    "scored": "select query_id, lang, pair_id, qterm, max(ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avg_dl))) * (1 - edits / least(length(qterm), length(term))::double)) as score from expanded join tf using (lang, term) join dl using (lang, pair_id) join whole using (lang) group by all",
    "matched": "select query_id, s.lang, pair_id, count(*) as matched, sum(score) as score from scored s group by all",
    "enough": "select m.* from matched m join (select distinct query_id, n_terms from asked) n using (query_id) where m.matched >= greatest(1, floor(0.6 * n_terms))",
    "shifts": "select distinct a.query_id, p.lang, p.pair_id, a.position as slot, p.position - a.position as shift from (select distinct query_id, lang, term, position from asked) a join posted p using (lang, term)",
    "starts": "select query_id, lang, pair_id, slot, start, max(exact) as exact from (select query_id, lang, pair_id, slot, shift as start, 1 as exact from shifts union all select query_id, lang, pair_id, slot, shift - 1, 0 from shifts) group by all",
    "phrased": "select query_id, lang, pair_id, sum(case when exact = m then 1.0 else 0.5 end)::double as freq from (select query_id, lang, pair_id, start, count(*) as n, sum(exact) as exact from starts group by all) join (select query_id, count(*) as m from (select distinct query_id, term, position from asked) group by all) using (query_id) where n = m and exact > 0 group by all",
    "phrase_idf": "select query_id, sum(ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double))) as idf from (select distinct query_id, lang, term, position from asked) join stats using (lang, term) join whole using (lang) group by all",
    "phrase_score": "select query_id, lang, pair_id, 4.0::double * idf * (freq * 2.2::double / (freq + 1.2::double * (0.25::double + 0.75::double * dl / avg_dl))) as score from phrased join phrase_idf using (query_id) join dl using (lang, pair_id) join whole using (lang)",
    "near": f"select query_id, q.lang, pair_id, field, qfield, levenshtein(qfield, field) as edits from (select query_id, lang, {S.fold(S.trim('q'))} as qfield from queries) q join (select lang, pair_id, {S.fold('text')} as field from langs) f on f.lang = q.lang and abs(length(field) - length(qfield)) <= 2 and levenshtein(qfield, field) <= case when length(qfield) < 3 then 0 when length(qfield) <= 5 then 1 else 2 end",
    "field_score": "select query_id, lang, pair_id, ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)) * (1 - edits / least(length(qfield), length(field))::double) as score from near join (select lang, field, count(distinct pair_id) as df from near group by all) using (lang, field) join whole using (lang)",
    "ranked": "select query_id, lang, pair_id, position, score, rank from (select *, row_number() over (partition by query_id order by score desc, position) as rank from (select query_id, t.lang, t.pair_id, l.position, cast(printf('%.6f', sum(score)) as double) as score from (select query_id, lang, pair_id, max(score) as score from (select query_id, lang, pair_id, 3.0::double * score as score from enough union all select query_id, lang, pair_id, score from field_score) group by all union all select query_id, lang, pair_id, score from phrase_score) t join langs l on l.lang = t.lang and l.pair_id = t.pair_id group by all)) join (select query_id, \"limit\" from queries) using (query_id) where rank <= \"limit\"",
    "hits": "select r.query_id, r.rank, r.lang, r.pair_id, q.q, l.text, l.alignment_text from ranked r join langs l using (lang, pair_id) join queries q using (query_id)",
}
# raw_words needs qraw before it
_order = [k for k in CTE if k != "qraw"]
_order.insert(_order.index("raw"), "qraw")


def _with(select: str) -> str:
    """The select with the expressions that it needs, in order."""
    needed: set[str] = set()

    def need(text: str) -> None:
        import re

        for name in _order:
            if name not in needed and re.search(rf"\b(?:from|join)\s+\(*\s*{name}\b", text):
                needed.add(name)
                need(CTE[name])

    need(select)
    inner = ", ".join(f"{k} as materialized ({CTE[k]})" for k in _order if k in needed)
    return f"with {inner} {select}" if inner else select


def _position(words: str, bare: str, stem: str) -> str:
    """Index of a word among structs (clean, bare, stem): equal, else of the same stem, else within a longer one."""
    first = lambda cond: f"list_position(list_transform({words}, lambda w: {cond}), true) - 1"
    tiers = (f"w.bare = {bare}", f"w.clean <> '' and w.stem = {stem}", f"length(w.bare) > length({bare}) and contains(w.bare, {bare})")
    return "coalesce(" + ", ".join(f"nullif({first(c)}, -1)" for c in tiers) + ", -1)::int"


def _stem_of(x: str) -> str:
    return f"case when length({x}) < 2 then '' when lang = 'en' then {S.stem_en(x)} else {S.stem_fr(x)} end"


_HIT_WORDS = f"""hit_words as materialized (select lang, word, clean, {S.strip_accents('clean')} as bare, {_stem_of('clean')} as stem
  from (select lang, word, {S.clean('word')} as clean from (select distinct lang, unnest({S.words('text')}) as word from hits union select distinct lang, unnest({S.words('q')}) from hits))),
hit_source as materialized (select query_id, rank, list(struct_pack(clean := w.clean, bare := w.bare, stem := w.stem) order by i) as source from (select query_id, rank, lang, unnest({S.words('text')}) as word, unnest(range(len({S.words('text')}))) as i from hits) join hit_words w using (lang, word) group by all),
hit_asked as materialized (select query_id, rank, list(struct_pack(clean := w.clean, bare := w.bare, stem := w.stem) order by i) as asked from (select query_id, rank, lang, unnest({S.words('q')}) as word, unnest(range(len({S.words('q')}))) as i from hits) join hit_words w using (lang, word) where length(w.clean) >= 2 group by all)"""

_TARGETS = f"select h.query_id, h.rank, unnest(range(len(w))) as j, {S.display('unnest(w)')} as shown from (select query_id, rank, {S.words('alignment_text')} as w from hits) h"

ORACLES = {
    "pairs_view": _with("select row_id, text_en, text_fr from kept"),
    "pair_ids": _with(f"select pair_id, {BOOK_ID}::bigint as book_id, {S.quoted(BOOK_TITLE)} as book_title, pair_id as position, 2 * pair_id - 1 as segment_id_en, 2 * pair_id as segment_id_fr, text_en, text_fr, 'pair-' || pair_id as doc_id from docs"),
    "unpivot_by_lang": _with(f"select lang, pair_id, position, {BOOK_ID}::bigint as book_id, {S.quoted(BOOK_TITLE)} as book_title, segment_id, alignment_id, text, alignment_text, alignment_lang from langs"),
    "nonempty_filter": _with(r"select 'relational' as mode, count(*) as n from kept union all select 'search', count(*) from aligned_book union all select 'pipeline', count(*) from aligned_book where not regexp_full_match(coalesce(en, ''), '\s*')"),
    "book_segment_expand": _with("select 2 * pair_id - 1 as id, 1::bigint as book_id, pair_id::int as position, 'en' as language, text_en as text from docs union all select 2 * pair_id, 2::bigint, pair_id::int, 'fr', text_fr from docs"),
    "alignment_expand": _with("select pair_id as id, 2 * pair_id as segment_fr_id, 2 * pair_id - 1 as segment_en_id, 1.0::double as confidence from docs"),
    "alignment_pairs": "with once as (select id, arg_max(text, struct_pack(l := loaded_at, t := text)) as text from segments where id is not null and text is not null group by id) select a.id as pair_id, e.text as text_en, f.text as text_fr from alignments a join once e on e.id = a.segment_en_id join once f on f.id = a.segment_fr_id",
    "clean_tokens": _with(f"select distinct word, {S.clean('word')} as clean, {S.display('word')} as shown from surfaces"),
    "strip_accents": _with(f"select distinct clean, {S.strip_accents('clean')} as bare from cleaned"),
    "stop_filter": _with(f"select lang, clean from cleaned where length(clean) >= 2 and not case when lang = 'en' then {S.is_stop('clean', 'en')} else {S.is_stop('clean', 'fr')} end"),
    "stem_en": _with(f"select clean, case when length(clean) < 2 then '' else {S.stem_en('clean')} end as stem from (select distinct clean from cleaned)"),
    "stem_fr": _with(f"select clean, case when length(clean) < 2 then '' else {S.stem_fr('clean')} end as stem from (select distinct clean from cleaned)"),
    "tokenize_stem": _with("select row_id, lang, idx::int as idx, stem, surface from stems"),
    "sentence_stem_freq_en": _with("select stem, n from freq where lang = 'en'"),
    "sentence_stem_freq_fr": _with("select stem, n from freq where lang = 'fr'"),
    "cooccurrence": _with("select en, fr, co from co"),
    "dice_lexicon": _with("select * from lexicon"),
    "stem_forms": _with("select * from forms"),
    "lexicon_entry_count": _with("select count(*) as n_entries from lexicon"),
    "hints_top5": _with("select query_id, lang, word_idx::int as word_idx, rank::int as rank, target_stem, score from looked"),
    "hints_surface_forms": _with("select query_id, word_idx::int as word_idx, rank::int as rank, surface from hints"),
    "stored_hints": _with(f"select distinct l.query_id, l.word_idx::int as word_idx, l.rank::int as rank, f.surface_form as surface from stored_looked l join (select * from stem_forms) f on f.stem = l.target_stem and f.language = case when l.lang = 'en' then 'fr' else 'en' end where not case when l.lang = 'en' then {S.is_stop('l.target_stem', 'fr')} else {S.is_stop('l.target_stem', 'en')} end"),
    "bigram_jaccard": _with(f"select en as a, fr as b, {S.bigram_similarity('en', 'fr')} as similarity from dice"),
    "length_ratio": _with("select en as a, fr as b, least(length(en), length(fr))::double / greatest(length(en), length(fr)) as ratio from dice"),
    "position_similarity": _with(f"select row_id, i::int as i, floor(i * (b::double / a))::int as j, 1.0::double - abs(i::double / a - floor(i * (b::double / a)) / b) as similarity from (select row_id, a, b, unnest(range(a)) as i from (select row_id, len({S.words('text_en')}) as a, len({S.words('text_fr')}) as b from kept))"),
    "adjective_flag": _with(f"select lang, clean, case when lang = 'en' then {S.is_adjective('clean', 'en')} else {S.is_adjective('clean', 'fr')} end as adjective from cleaned"),
    "postings": _with("select lang, pair_id, term, position::int as position from posted"),
    "term_stats": _with(f"select lang, term, df, n_docs, {S.rounded('avg_dl', 6)} as avg_dl from stats join whole using (lang)"),
    "bm25_terms": _with(f"select query_id, lang, pair_id, qterm, {S.rounded('score', 6)} as score from scored"),
    "min_should_match": _with(f"select query_id, lang, pair_id, matched, {S.rounded('score', 6)} as score from enough"),
    "phrase_slop1": _with("select query_id, lang, pair_id, freq from phrased"),
    "fuzzy_terms": _with("select query_id, lang, qterm, term, edits, df from expanded"),
    "hybrid_topk": _with("select query_id, lang, pair_id, position, score, rank::int as rank from ranked"),
    "csv_import": _with("select text_en, text_fr from kept"),
    "stored_books": f"select * from (values (1::bigint, {S.quoted(BOOK_TITLE + ' (EN)')}, 'en', 'CSV import'), (2::bigint, {S.quoted(BOOK_TITLE + ' (FR)')}, 'fr', 'CSV import')) v(id, title, language, source)",
    "stored_documents": _with("select 'pair-' || pair_id as doc_id, pair_id, text_en, text_fr from docs"),
    "stored_lexicon": _with("select * from lexicon"),
}
_hits_sql = _with("select * from hits")
ORACLES["word_position"] = (
    _hits_sql.removesuffix(" select * from hits")
    + f", {_HIT_WORDS} select h.query_id, h.rank::int as rank, {_position('s.source', 'a.asked[1].bare', 'a.asked[1].stem')} as first_pos, {_position('s.source', 'a.asked[len(a.asked)].bare', 'a.asked[len(a.asked)].stem')} as last_pos from hits h join hit_source s using (query_id, rank) join hit_asked a using (query_id, rank)"
)
_with_hints = _with("select * from hits join hints using (query_id)").removesuffix(" select * from hits join hints using (query_id)")
ORACLES["highlight_hint"] = (
    _with_hints
    + f""", targets as materialized ({_TARGETS}), bare_hints as (select query_id, word_idx, rank as hint_rank, surface, {S.strip_accents('lower(surface)')} as bare from hints),
  usable as (select b.* from bare_hints b join queries q using (query_id) where length(bare) >= 4 and not case when q.lang = 'en' then bare in {S.listed(STOP['fr'])} else bare in {S.listed(STOP['en'])} end),
  found as (select t.query_id, t.rank, arg_min(t.shown, struct_pack(w := u.word_idx, r := u.hint_rank, s := u.surface, j := t.j)) as hint from targets t join usable u on u.query_id = t.query_id and ({S.strip_accents('lower(t.shown)')} = u.bare or contains(t.shown, '-') and starts_with({S.strip_accents('lower(t.shown)')}, u.bare || '-')) group by all)
  select h.query_id, h.rank::int as rank, f.hint from hits h left join found f using (query_id, rank)"""
)

_highlight = (
    _hits_sql.removesuffix(" select * from hits")
    + f""", {_HIT_WORDS},
  hit_target as materialized (select query_id, rank, lang, j, {S.clean('word')} as clean, {S.strip_accents(S.clean('word'))} as bare, {S.display('word')} as shown, n_target from (select query_id, rank, lang, unnest({S.words('alignment_text')}) as word, unnest(range(len({S.words('alignment_text')}))) as j, len({S.words('alignment_text')}) as n_target from hits)),
  placed as materialized (select h.query_id, h.rank, h.lang, a.asked, len(a.asked) as n_asked, len(s.source) as n_source, {_position('s.source', 'a.asked[1].bare', 'a.asked[1].stem')} as first_pos, {_position('s.source', 'a.asked[len(a.asked)].bare', 'a.asked[len(a.asked)].stem')} as last_pos from hits h join hit_source s using (query_id, rank) join hit_asked a using (query_id, rank))"""
)
ORACLES["highlight_single"] = (
    _highlight
    + f""", one as materialized (select p.query_id, p.rank, p.lang, t.j, t.shown, p.asked[1].clean as q, {S.bigram_similarity('p.asked[1].bare', 't.bare')} as likeness,
    1.0::double - abs(p.first_pos::double / p.n_source - t.j::double / t.n_target) as place, least(length(p.asked[1].clean), length(t.clean))::double / greatest(length(p.asked[1].clean), length(t.clean)) as size
    from placed p join hit_target t using (query_id, rank) where p.n_asked = 1 and p.first_pos >= 0 and length(t.clean) >= 2 and t.shown <> ''),
  weighed as (select *, case when most < 0.3::double then 0.15::double * likeness + 0.7::double * place + 0.15::double * size else 0.5::double * likeness + 0.45::double * place + 0.05::double * size end as score,
    0.15::double * likeness + 0.4::double * place + 0.45::double * size as relaxed from (select *, max(likeness) over (partition by query_id, rank) as most from one)),
  sure as (select query_id, rank, any_value(most) as most, any_value(case when lang = 'en' then {S.is_adjective('q', 'en')} else {S.is_adjective('q', 'fr')} end) as adjective,
    arg_max(struct_pack(score := score, shown := shown, place := place), struct_pack(s := score, j := -j)) as best, list(struct_pack(best := 0::double, shown := shown, r := relaxed) order by j) as steps from weighed group by query_id, rank),
  folded as (select query_id, rank, best, (adjective or (best.score < 0.65::double and best.place < 0.75::double)) and most < 0.3::double as unsure,
    list_reduce(list_prepend(struct_pack(best := best.score, shown := best.shown, r := 0::double), steps), lambda a, x: case when x.r > a.best * (case when adjective then 0.9::double else 0.95::double end) then struct_pack(best := x.r, shown := x.shown, r := x.r) else a end) as relaxed from sure)
  select p.query_id, p.rank::int as rank, case when f.unsure then f.relaxed.shown else f.best.shown end as word from placed p left join folded f using (query_id, rank) where p.n_asked = 1"""
)
ORACLES["highlight_phrase"] = (
    _highlight
    + f""", spans as (select *, greatest(0, floor(least(first_pos, last_pos)::double / n_source * n_target)::int - 2) as low, least(n_target, floor((greatest(first_pos, last_pos) + 1)::double / n_source * n_target)::int + 2) as high
    from (select distinct p.*, t.n_target from placed p join hit_target t using (query_id, rank) where p.n_asked > 1 and p.first_pos >= 0 and p.last_pos >= 0)),
  wide as (select *, case when high - low < 4 then greatest(0, low - (4 - (high - low)) // 2) else low end as a, case when high - low < 4 then least(n_target, high + (4 - (high - low)) // 2) else high end as b from spans),
  cand as (select w.query_id, w.rank, t.j, t.shown, t.clean, w.a, w.b, w.n_asked, max({S.bigram_similarity('q.bare', 't.bare')}) as likeness
    from wide w join hit_target t using (query_id, rank) join (select query_id, rank, unnest(asked).bare as bare from placed) q using (query_id, rank) where t.j >= w.a and t.j < w.b and length(t.clean) >= 2 and t.shown <> '' group by all),
  rated as (select *, greatest(0, likeness) * (1.0::double - abs(j - (a + b)::double / 2) / greatest(1.0::double, (b - a)::double / 2) * 0.3::double) + least(1.0::double, length(clean) / 8.0::double) * 0.2::double as score from cand),
  firsts as (select query_id, rank, shown, n_asked, score, j from (select *, row_number() over (partition by query_id, rank, shown order by score desc, j) as k from rated where score >= 0.15::double) where k = 1),
  listed as (select query_id, rank, list_slice(list(shown order by score desc, j), 1, least(2 * any_value(n_asked) + 2, 8)) as words from firsts group by query_id, rank)
  select p.query_id, p.rank::int as rank, coalesce(array_to_string(l.words, '|'), '') as words from placed p left join listed l using (query_id, rank) where p.n_asked > 1"""
)

_stored = ORACLES["alignment_pairs"]
ORACLES["store_lexicon"] = ORACLES["dice_lexicon"].replace(CTE["kept"], f"select row_number() over () as row_id, text_en, text_fr from (select distinct pair_id, text_en, text_fr from ({_stored}))")
ORACLES["stored_segments"] = ORACLES["book_segment_expand"]
ORACLES["search_by_rows"] = ORACLES["hybrid_topk"].replace(CTE["queries"], "select * from " + row_sql("kept"))

_marks = _with("select * from hits join expanded using (query_id)").removesuffix(" select * from hits join expanded using (query_id)")
_MARKED = rf"""pieces as materialized (select query_id, rank, lang, unnest(range(len(p))) as i, unnest(p) as piece from (select query_id, rank, lang, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') as p from hits)),
piece_words as materialized (select lang, piece, case when lang = 'en' then {S.is_stop('lower(piece)', 'en')} else {S.is_stop('lower(piece)', 'fr')} end as stop, case when lang = 'en' then {S.stem_en('lower(piece)')} else {S.stem_fr('lower(piece)')} end as term from (select distinct lang, piece from pieces) where regexp_matches(piece, '^[\p{{L}}\p{{N}}]')),
wanted as materialized (select distinct query_id, term from expanded),
marked_text as materialized (select p.query_id, p.rank, string_agg(case when w.term is not null then '<mark>' || p.piece || '</mark>' else p.piece end, '' order by p.i) as text_highlighted
  from pieces p left join piece_words k on k.lang = p.lang and k.piece = p.piece and not k.stop left join wanted w on w.query_id = p.query_id and w.term = k.term group by all)"""
ORACLES["source_mark"] = _marks + f", {_MARKED} select query_id, rank::int as rank, text, text_highlighted from hits join marked_text using (query_id, rank)"
_RESULTS = f"""select h.query_id, q.q as query, h.lang, h.rank::int as rank, l.segment_id, {BOOK_ID}::bigint as book_id, {S.quoted(BOOK_TITLE)} as book_title, h.lang as language, h.text, m.text_highlighted, l.alignment_text, l.alignment_lang as alignment_language, l.alignment_id,
  case when s.query_id is not null then case when coalesce(n.hint, s.word) is null then []::varchar[] else [coalesce(n.hint, s.word)] end when p.words is null or p.words = '' then []::varchar[] else string_split(p.words, '|') end as alignment_highlights
  from hits h join (select query_id, {S.trim('q')} as q from queries) q using (query_id) join langs l on l.lang = h.lang and l.pair_id = h.pair_id join marked_text m on m.query_id = h.query_id and m.rank = h.rank
  left join ({ORACLES['highlight_hint']}) n on n.query_id = h.query_id and n.rank = h.rank left join ({ORACLES['highlight_single']}) s on s.query_id = h.query_id and s.rank = h.rank left join ({ORACLES['highlight_phrase']}) p on p.query_id = h.query_id and p.rank = h.rank"""
ORACLES["search_results"] = _marks + f", {_MARKED}, results as materialized ({_RESULTS}) select * replace (array_to_string(alignment_highlights, '|') as alignment_highlights) from results"
ORACLES["search_response"] = (
    _marks
    + f""", {_MARKED}, results as materialized ({_RESULTS}), listed as (select query_id, list(struct_pack(segment_id := segment_id, book_id := book_id, book_title := book_title, "language" := "language", text := text, text_highlighted := text_highlighted, alignment_text := alignment_text, alignment_language := alignment_language, alignment_id := alignment_id, alignment_highlights := alignment_highlights) order by rank) as results from results group by query_id)
  select q.query_id, to_json(struct_pack(query := {S.trim('q.q')}, lang := q.lang, count := len(coalesce(l.results, [])), results := coalesce(l.results, [])))::varchar as response from queries q left join listed l using (query_id)"""
)
