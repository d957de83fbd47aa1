"""Texts that look the same in print but are stored as different characters.

Forms that look alike (single code points and short strings) are linked by rules; union-find makes the links transitive
classes; the member the corpus uses most represents its class. One multi-pattern automaton over all members rewrites
texts greedily, longest match first, until nothing changes. The inventory of forms is bounded by Unicode, not by the data:
code points that a rule names, and pairs of a base and a mark that compose to one code point.
"""
from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.encoding import as_texts, slices
from lexiloom.plans.skew import ROWS_PER_REPLICA, SMALL_ROWS, join_unique
from lexiloom.plans.staging import cut

#: Letters of Greek, Cyrillic, Armenian, Cherokee and of phonetic alphabets, and some signs, that print as a Latin letter or a
#: common sign; each string of look-alikes against its letter.
SCRIPTS = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈͿᎫ", "K": "ΚКᏦ", "L": "Ꮮ", "M": "ΜМϺᎷ", "N": "Ν", "O": "ΟОՕ",
    "P": "ΡРᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ΤТᎢ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "аαɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "οоօσ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уүγ",
    "-": "‐‑﹣", ";": ";", "·": "·",
}
#: The same, letter by letter.
LETTERS = {c: letter for letter, others in SCRIPTS.items() for c in others}
#: Compatibility forms that print as the letters they stand for.
KINDS = ("<wide>", "<narrow>", "<noBreak>")
LIGATURES = [*range(0xFB00, 0xFB07), 0xFB13, 0xFB14, 0xFB15, 0xFB16, 0xFB17, 0x132, 0x133, 0x1C4, 0x1C5, 0x1C6, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x1F1, 0x1F2, 0x1F3, *range(0x2160, 0x2180)]
#: Marks and fillers that print nothing beside the format characters (category Cf).
NOTHING = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
#: Control characters that print as white space and therefore aren't nothing.
LAYOUT = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85"


@lru_cache(1)
def links() -> dict[str, str]:
    """Every code point that looks like something else, with what it looks like."""
    found = {}
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        kind = unicodedata.category(c)
        how = unicodedata.decomposition(c)
        if kind == "Cf" or kind == "Cc" and c not in LAYOUT:
            found[c] = ""
        elif kind == "Zs":
            if c != " ":
                found[c] = " "
        elif how and (how[0] != "<" or how.split()[0] in KINDS):
            found[c] = unicodedata.normalize("NFC", c) if how[0] != "<" and unicodedata.normalize("NFC", c) != c else unicodedata.normalize("NFKC" if how[0] == "<" else "NFD", c)
    found |= {chr(i): unicodedata.normalize("NFKC", chr(i)) for i in LIGATURES} | {chr(i): "" for i in NOTHING}
    found |= {c: letter for letter, others in SCRIPTS.items() for c in others}
    found.pop(" ", None)
    return {k: v for k, v in found.items() if k != v}


@lru_cache(1)
def _relevant() -> np.ndarray:
    """Code points that are counted: those with a link, those a link leads to, and marks."""
    flag = np.zeros(sys.maxunicode + 1, bool)
    for k, v in links().items():
        flag[[ord(x) for x in k + v]] = True
    return flag


@lru_cache(1)
def _joined() -> list[str]:
    """Strings that one code point can stand for, but for bases with a mark."""
    return sorted({v for v in links().values() if len(v) > 1 and not unicodedata.combining(v[1])})


def _count(batches):
    n = Counter()
    for batch in batches:
        for i, j in slices(batch.column(0)):
            column = batch.column(0).slice(i, j - i)
            t = as_texts(column, False)
            cps, counts = np.unique(t.cp[_relevant()[t.cp]], return_counts=True)
            n.update(dict(zip((chr(c) for c in cps), counts.tolist())))
            for form in _joined():
                if many := pc.sum(pc.count_substring(column, form)).as_py():
                    n[form] += many
            marked = ((t.cp >= 0x300) & (t.cp < 0x370)).nonzero()[0]
            for k in marked[marked > 0]:
                pair = chr(t.cp[k - 1]) + chr(t.cp[k])
                if len(unicodedata.normalize("NFC", _base(pair))) == 1:
                    n[pair] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["form", "n"])


def _base(pair: str) -> str:
    """A base and a mark with the base read as the letter it looks like."""
    return links().get(pair[0], pair[0])[-1:] + pair[1:]


class Classes:
    """Union-find over forms."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def root(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: str, y: str) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def rewriting(counts: dict[str, int]) -> dict[str, str]:
    """Each form met in the corpus, or named by a rule for one that was, with the representative of its class.

    Classes are transitive. The representative is the member with the largest count; among equals the shortest, then the
    smallest. The class of what prints nothing is represented by the empty string."""
    classes = Classes()
    for form in counts:
        if len(form) > 1:
            if not unicodedata.combining(form[1]):
                continue
            flat = _base(form)
            one = unicodedata.normalize("NFC", flat)
            classes.join(form, flat)
            classes.join(flat, one)
        elif form in links():
            to = links()[form]
            classes.join(form, to)
            if len(to) == 2 and unicodedata.normalize("NFC", to) == form and to[0] in links():
                classes.join(to, _base(to))
    members: dict[str, list[str]] = {}
    for form in classes.up:
        members.setdefault(classes.root(form), []).append(form)
    out = {}
    for group in members.values():
        best = "" if "" in group else min(group, key=lambda x: (-counts.get(x, 0), len(x), x))
        out |= {form: best for form in group if form}
    return out


class Rewriter:
    """Rewrites texts by the automaton of all forms, leftmost longest, to a fixed point."""

    def __init__(self, table: dict[str, str]):
        import ahocorasick

        self.table = table
        self.automaton = ahocorasick.Automaton()
        for form in table:
            self.automaton.add_word(form, form)
        if table:
            self.automaton.make_automaton()
        single = {best for best in table.values() if len(best) == 1}
        signs = {c for form, best in table.items() if form != best for c in form if c not in single or (len(form) == 1)}
        self.trigger = re.compile("[" + "".join(re.escape(c) for c in sorted(signs)) + "]") if signs else re.compile(r"(?!)")

    def __call__(self, text: str | None) -> str | None:
        if text is None or not self.trigger.search(text):
            return text
        text = re.sub(r"[̀-ͯ]{2,}", lambda m: unicodedata.normalize("NFD", m[0]), text)
        for _ in range(len(self.table) + 2):
            parts, at = [], 0
            for end, form in self.automaton.iter_long(text):
                start = end + 1 - len(form)
                parts.append(text[at:start])
                parts.append(self.table[form])
                at = end + 1
            parts.append(text[at:])
            new = "".join(parts)
            if new == text:
                return new
            text = new
        return text


def form_counts(df: DataFrame, text_col: str = "text") -> dict[str, int]:
    """How often the corpus uses each form that a rule concerns, over all rows. The number of forms is bounded by Unicode."""
    counted = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count, "form string, n bigint").groupBy("form").agg(F.sum("n").alias("n"))
    return {r.form: r.n for r in counted.collect()}


def unify_lookalikes(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_col, text, unified): every row's text in the one form in which texts that look the same are equal.

    Width, script and composition of letters, joined letters, kinds of space and hyphen, and characters that print nothing
    are unified, by classes counted over the whole column; letters, accents, digits, case and punctuation otherwise stay.
    A null text stays null, an empty one empty; a text of nothing but characters that print nothing becomes empty. Repeated
    rows stay repeated; other columns are not read."""
    kind = dict(df.dtypes)[id_col]
    table = df.sparkSession.sparkContext.broadcast(rewriting(form_counts(df, text_col)))
    made = []

    def work(batches):
        if not made:
            made.append(Rewriter(table.value))
        for batch in batches:
            unified = pa.array([made[0](x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), unified], names=[id_col, "text", "unified"])

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(work, f"`{id_col}` {kind}, text string, unified string")


@dataclass
class Members:
    """held: (key, form, id, n_form, n_class), an id's texts in classes of more than one stored form; forms: (key, form, n_form)."""

    held: DataFrame
    forms: DataFrame


def _members(df: DataFrame, id_col: str, text_col: str) -> Members:
    seen = unify_lookalikes(df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col)
    rows = cut(seen.select(F.col(id_col).alias("id"), F.unhex(F.sha2("unified", 256)).alias("key"), F.xxhash64("text").alias("form")).distinct())
    twins = rows.groupBy("key").agg(F.min("form").alias("low"), F.max("form").alias("high"), F.count(F.lit(1)).alias("n_class")).where("low <> high").select("key", "n_class")
    within = cut(join_unique(rows, twins, ["key"], "n_class", rows.count()))
    forms = cut(within.groupBy("key", "form").agg(F.count(F.lit(1)).alias("n_form")))
    size = forms.agg(F.sum("n_form").alias("total"), F.count(F.lit(1)).alias("rows")).first()
    return Members(cut(join_unique(within, forms, ["key", "form"], "n_form", size.total or 0, size.rows)), forms)


def lookalike_classes(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links): every id whose text has a differently stored twin, with the smallest id of its class of texts that look
    the same and the number of ids it makes a pair with. Sums only: a class of any size costs its rows.

    Rows with null id or text are in no class. An id with several texts has a row for each class; within a class it counts once for
    each stored form."""
    held = _members(df, id_col, text_col).held
    first = held.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    size = first.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows")).first()
    return join_unique(held, first, ["key"], "n", size.total or 0, size.rows).groupBy("id", "class_id").agg(F.max(F.col("n_class") - F.col("n_form")).alias("n_links"))


def lookalike_pairs(df: DataFrame, id_col: str = "id", text_col: str = "text", replica_rows: int = ROWS_PER_REPLICA) -> DataFrame:
    """(segment_a, segment_b), segment_a < segment_b: ids whose texts look the same but are stored differently, each pair once.

    Rows with null id or text make no pair; the empty text pairs with texts that print nothing. Ids delivered again count
    once; an id with several texts pairs by each of them. Only texts that have a differently stored twin are paired, and
    by their distinct stored forms, so a text that recurs a million times in one form costs nothing. The ids of a form are dealt out in
    parts of about replica_rows; a pair of forms is worked out part by part, so no task holds all ids of a form. The rows
    out are exactly the result; `lookalike_classes` has the same links without expanding them."""
    members = _members(df, id_col, text_col)
    parts = F.ceil(F.col("n_form") / replica_rows).cast("int")
    held = members.held.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    sized = members.forms.select("key", "form", parts.alias("parts"))
    x, y = (sized.select("key", F.col("form").alias(f"form_{k}"), F.col("parts").alias(f"parts_{k}")) for k in "ab")
    met = x.join(y, "key").where("form_a < form_b").withColumn("part_a", F.explode(F.expr("sequence(0, parts_a - 1)"))).withColumn("part_b", F.explode(F.expr("sequence(0, parts_b - 1)"))).drop("parts_a", "parts_b")
    side = lambda k: held.select("key", F.col("form").alias(f"form_{k}"), F.col("part").alias(f"part_{k}"), F.col("id").alias(f"id_{k}"))
    pairs = met.join(side("a"), ["key", "form_a", "part_a"]).join(side("b"), ["key", "form_b", "part_b"]).where("id_a <> id_b").select("id_a", "id_b")
    # a pair can only come twice through an id that has several texts
    several = F.broadcast(some) if (some := cut(members.held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))).count() <= SMALL_ROWS else some
    ordered = pairs.select(F.least("id_a", "id_b").alias("segment_a"), F.greatest("id_a", "id_b").alias("segment_b"))
    for c in ("segment_a", "segment_b"):
        ordered = ordered.join(several.select(F.col("id").alias(c), F.lit(True).alias(f"again_{c}")), c, "left")
    again = F.coalesce("again_segment_a", "again_segment_b", F.lit(False))
    return ordered.where(~again).select("segment_a", "segment_b").unionByName(ordered.where(again).select("segment_a", "segment_b").distinct())
