"""The same text functions as DuckDB SQL, for comparing results."""
from __future__ import annotations

from lexiloom.functions.lexicons import ADJECTIVES, EDGE_SIGNS, ELISIONS, IRREGULAR_EN, STOP, SUFFIXES_EN, SUFFIXES_FR

WHITE = r"[\t-\r\x1c-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WHITE}+'), lambda z: z <> '')"


def strip_accents(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '\p{{Mn}}', '', 'g')"


def clean(x: str) -> str:
    return rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}_]', '', 'g'))"


def fold(x: str) -> str:
    return f"replace(replace({strip_accents(f'lower({x})')}, 'œ', 'oe'), 'æ', 'ae')"


def display(x: str) -> str:
    return f"trim({x}, {quoted(EDGE_SIGNS)})"


def is_stop(x: str, lang: str) -> str:
    return f"({strip_accents(x)} in {listed(STOP[lang])})"


def is_adjective(x: str, lang: str) -> str:
    return f"({strip_accents(f'lower({x})')} in {listed(ADJECTIVES[lang])})"


def _ends(w: str, suffix: str) -> str:
    return f"right({w}, {len(suffix)}) = '{suffix}'"


def stem_en(x: str) -> str:
    w = f"lower({x})"
    out = "case " + " ".join(f"when {w} = '{form}' then '{stem}'" for form, stem in IRREGULAR_EN.items())
    for suffix, longer, drop, add, single in SUFFIXES_EN:
        base = f"left({w}, length({w}) - {drop})"
        if single:
            base = f"(case when length({base}) >= 2 and right({base}, 1) = substr({base}, length({base}) - 1, 1) then left({w}, length({w}) - {drop + 1}) else {base} end)"
        out += f" when {_ends(w, suffix)} and length({w}) > {longer} then {base} || '{add}'"
    return out + f" when {_ends(w, 's')} and not {_ends(w, 'ss')} and length({w}) > 3 then left({w}, length({w}) - 1) else {w} end"


def stem_fr(x: str) -> str:
    w = strip_accents(f"lower({x})")
    out = "case"
    for suffix, add in SUFFIXES_FR:
        out += f" when {_ends(w, suffix)} and length({w}) - {len(suffix)} >= 3 then left({w}, length({w}) - {len(suffix)}) || '{add}'"
    return out + f" when {_ends(w, 's')} and not {_ends(w, 'ss')} and length({w}) > 3 then left({w}, length({w}) - 1) else {w} end"


def bigrams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}), 2)), lambda i: substr({x}, i, 2)))"


def bigram_similarity(a: str, b: str) -> str:
    both = f"len(list_intersect({bigrams(a)}, {bigrams(b)}))"
    return f"(case when length({a}) < 2 or length({b}) < 2 then (case when {a} = {b} then 1.0 else 0.0 end) else {both}::double / (len({bigrams(a)}) + len({bigrams(b)}) - {both}) end)"


def rounded(x: str, places: int) -> str:
    return f"cast(printf('%.{places}f', {x}) as double)"


def raw_terms(x: str, lang: str) -> str:
    """List of the words that analysis for retrieval sees, stop words included."""
    text = f"lower({x})"
    if lang != "en":
        text = rf"regexp_replace({text}, '(^|[^\p{{L}}\p{{N}}])(?:{'|'.join(ELISIONS)})[''’]', '\1', 'g')"
    return rf"list_filter(regexp_split_to_array({text}, '[^\p{{L}}\p{{N}}]+'), lambda z: z <> '')"
