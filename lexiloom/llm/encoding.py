"""Encoding of whole texts by a public tokenizer, vectorised over Arrow batches.

A batch's UTF-8 bytes are read as one array of code points. A table gives every code point its class, sharpened where the next one or
two signs matter (the blank that joins the next word, contractions). Each class is a transition function of a small
automaton, and an associative scan over these functions gives the state at every sign, hence the boundaries of pre-tokens: no
regular expression runs. The slices between boundaries are dictionary-encoded by Arrow, each distinct slice is merged
once per worker, and ids are laid out by index arithmetic. Byte offsets of all
tokens are kept, so decoding and splitting are exact.
"""
from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.vocab import TOKENIZER_DIR, Shipped, Vocabulary

OTHER, LETTER, NUMBER, SPACE = range(4)
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Bytes of text worked on at a time within a batch; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    return table


@dataclass
class Texts:
    """Texts end to end: bytes, where each begins (n + 1 offsets), code points and the byte at which each begins."""

    raw: np.ndarray
    at: np.ndarray
    cp: np.ndarray
    lead: np.ndarray
    first: np.ndarray  # index of each text's first code point, n + 1 entries


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about `size` bytes each."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def as_texts(column: pa.Array, prefix: bool) -> Texts:
    """Read an Arrow string column; null counts as empty. prefix: a blank is put before each text that isn't empty."""
    column = pc.fill_null(column, "")
    if prefix:
        column = pc.if_else(pc.greater(pc.binary_length(column), 0), pc.binary_join_element_wise(" ", column, ""), column)
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    if len(lead) != len(cp):
        raise ValueError("text is not valid UTF-8")
    return Texts(raw, at, cp, lead, np.searchsorted(lead, at))


#: States of the boundary automaton: nothing open, in a word, a number, other signs, white space, behind a blank that joins the next
#: pre-token, one or two letters before the end of a contraction.
FRESH, WORD, DIGITS, SIGNS, BLANKS, JOINING, LAST, LAST_TWO = range(8)
#: Classes of a sign beside the code point classes: white space before more of it or a text's end, other white space before a sign, a
#: blank before a sign, an apostrophe before a one-letter or a two-letter contraction. From 8 on: the same, first in a text.
RUN, LONE, JOINED, SHORT, LONG = 3, 4, 5, 6, 7


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """The transition function of each class, state by state (16 x 8), and whether a pre-token begins at the sign (16 x 8)."""
    goes, begins = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    opens = {LETTER: WORD, NUMBER: DIGITS, OTHER: SIGNS, RUN: BLANKS, LONE: FRESH, JOINED: JOINING, SHORT: LAST, LONG: LAST_TWO}
    goes_on = {LETTER: (WORD, JOINING), NUMBER: (DIGITS, JOINING), OTHER: (SIGNS, JOINING), RUN: (BLANKS,), LONE: (), JOINED: (), SHORT: (SIGNS, JOINING), LONG: (SIGNS, JOINING)}
    for kind, state in opens.items():
        for before in range(8):
            if before in (LAST, LAST_TWO):  # a contraction takes its letters whatever they are
                goes[kind, before] = FRESH if before == LAST else LAST
            elif before in goes_on[kind]:
                goes[kind, before] = SIGNS if kind in (SHORT, LONG) else state
            else:
                goes[kind, before], begins[kind, before] = state, True
        goes[8 + kind], begins[8 + kind] = state, True  # the first sign of a text forgets what was before
    return goes, begins


def scan(kinds: np.ndarray, goes: np.ndarray) -> np.ndarray:
    """The state before every sign, from FRESH on.

    The state at a sign is the composition of the transition functions before it. Composition is associative, so the signs are cut
    into about as many rows as a row is long: all rows compose their functions side by side, the rows' functions are
    scanned in the same way, and all rows are run side by side once more from the states they begin in."""
    n = len(kinds)
    width = 1 << max(3, (n.bit_length() + 1) // 2)
    rows = -(-n // width)
    table = np.ascontiguousarray(goes).ravel()
    columns = np.zeros((width, rows), np.intp)
    columns.T.flat[:n] = kinds
    columns <<= 3
    start = np.zeros(rows, np.intp)
    if rows > 1:
        whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, axis=1)
        for column in columns:
            whole = table[column + whole]
        if rows <= 64:
            for k in range(1, rows):
                start[k] = whole[start[k - 1], k - 1]
        else:
            start[:] = scan(np.arange(rows), whole.T)
    before = np.empty((width, rows), np.uint8)
    for k, column in enumerate(columns):
        before[k] = start
        start = table[column + start]
    return before.T.ravel()[:n]


@lru_cache(1)
def by_four() -> np.ndarray:
    """The composed function of every four classes in a row, the first as the highest hexadecimal digit (65536 x 8)."""
    goes, _ = automaton()
    whole = goes
    for _ in range(3):
        whole = goes[np.arange(16)[None, :, None], whole[:, None, :]].reshape(-1, 8)
    return whole


def states(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state before every sign: four signs are one symbol of the scan, and what is between follows from it."""
    n = len(kinds)
    four = np.zeros((-(-n // 4), 4), np.uint8)
    four.ravel()[:n] = kinds
    digits = [four[:, k].astype(np.intp) for k in range(4)]
    code = (((digits[0] << 4 | digits[1]) << 4 | digits[2]) << 4) | digits[3]
    table = automaton()[0].ravel()
    before = np.empty((len(four), 4), np.uint8)
    state = scan(code, by_four())
    for k in range(4):
        before[:, k] = state
        state = table[(digits[k] << 3) + state]
    return before.ravel()[:n]


def byte_bpe_starts(t: Texts) -> np.ndarray:
    """Indexes of the code points that begin a pre-token of the byte-level tokenizers."""
    n = len(t.cp)
    cp = np.concatenate([t.cp, np.zeros(4, np.uint32)])
    new = np.zeros(n + 4, bool)  # begins a text; beyond the end counts as one
    new[t.first[:-1]] = True
    new[n:] = True
    kind = classes()[t.cp]
    at = np.flatnonzero(kind == SPACE)
    more = new[at + 1] | (np.append(kind, SPACE)[at + 1] == SPACE)
    kind = np.where(kind == SPACE, RUN, kind)
    kind[at[~more]] = np.where(cp[at[~more]] == 32, JOINED, LONE)
    a = np.flatnonzero(t.cp == 39)
    a = a[~new[a + 1]]
    c1, c2 = cp[a + 1], cp[a + 2]
    letter = lambda x, y: x == ord(y)
    one = letter(c1, "s") | letter(c1, "t") | letter(c1, "m") | letter(c1, "d")
    two = ~new[a + 2] & ((letter(c1, "r") | letter(c1, "v")) & letter(c2, "e") | letter(c1, "l") & letter(c2, "l"))
    kind[a[one]] = SHORT
    kind[a[two]] = LONG
    kind[new[:n]] += 8
    return np.flatnonzero(automaton()[1].ravel()[(kind.astype(np.intp) << 3) + states(kind)])


def piece_bpe_starts(t: Texts, apart: np.ndarray) -> np.ndarray:
    """Indexes of the code points before which no merge can reach: no piece of the vocabulary has the two signs side by
    side (above all, none has a blank behind another sign)."""
    cp = np.where(t.cp == 32, 0x2581, t.cp)
    low = np.where(cp == 0x2581, 0, np.minimum(cp, len(apart) - 1))
    start = np.zeros(len(cp), bool)
    start[1:] = apart[low[:-1], low[1:]]
    start[t.first[:-1][t.first[:-1] < len(t.cp)]] = True
    return np.flatnonzero(start)


@dataclass
class Encoded:
    ids: np.ndarray
    ends: np.ndarray  # byte offset behind each token, within the slice's bytes
    counts: np.ndarray  # tokens of each text
    texts: Texts


def encode(column: pa.Array, vocabulary: Vocabulary) -> Encoded:
    t = as_texts(column, vocabulary.prefix)
    rows = len(t.at) - 1
    if not len(t.cp):
        none = np.zeros(0, np.int32)
        return Encoded(none, none.astype(np.int64), np.zeros(rows, np.int64), t)
    starts = piece_bpe_starts(t, vocabulary.apart) if vocabulary.prefix else byte_bpe_starts(t)
    cuts = np.append(t.lead[starts], len(t.raw)).astype(np.int32)
    slices_ = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(t.raw))]).dictionary_encode()
    ids, sizes, per = vocabulary.encode_all(slices_.dictionary.to_pylist())
    code = np.asarray(slices_.indices)
    n = per[code]
    ends = np.cumsum(n)
    place = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat((np.cumsum(per) - per)[code], n)
    edge = np.concatenate([[0], ends])[np.searchsorted(starts, t.first)]
    return Encoded(ids[place], np.cumsum(sizes[place], dtype=np.int64), np.diff(edge), t)


def _run(df: DataFrame, id_col: str, text_col: str, shipped: Shipped, schema: str, make) -> DataFrame:
    def work(batches):
        vocabulary = shipped.get()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield make(part, encode(part.column(1), vocabulary))

    return df.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_")).mapInArrow(work, schema)


def encode_ids(df: DataFrame, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Token ids of every row's text: (id_col, ids array<int>), one row out for each row in.

    Empty and null texts get the empty list, never null. A null id stays null; repeated rows give repeated rows; strings
    of special tokens are ordinary text; other columns of df are not read. An empty table gives an empty one."""
    kind = dict(df.dtypes)[id_col]

    def make(part, e):
        offsets = np.concatenate([[0], np.cumsum(e.counts)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(e.ids))], names=[id_col, "ids"])

    return _run(df, id_col, text_col, Shipped(df.sparkSession, tokenizer, tokenizer_dir), f"`{id_col}` {kind}, ids array<int>", make)


def decode_ids(df: DataFrame, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", ids_col: str = "ids", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Texts of lists of token ids: (id_col, text). A null or empty list gives the empty text."""
    shipped, kind = Shipped(df.sparkSession, tokenizer, tokenizer_dir), dict(df.dtypes)[id_col]

    def work(batches):
        v = shipped.get()
        for batch in batches:
            texts = [v.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(F.col(id_col).alias("id_"), F.col(ids_col).alias("ids_")).mapInArrow(work, f"`{id_col}` {kind}, text string")


def count_tokens(df: DataFrame, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, n_tokens bigint, n_chars bigint, n_letters bigint) of every row; 0 for empty and null texts."""
    kind = dict(df.dtypes)[id_col]

    def make(part, e):
        t = e.texts
        letters = np.concatenate([[0], np.cumsum(classes()[t.cp] == LETTER)])
        columns = [part.column(0), pa.array(e.counts), pa.array(np.diff(t.first).astype(np.int64)), pa.array(np.diff(letters[t.first]).astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "n_chars", "n_letters"])

    return _run(df, id_col, text_col, Shipped(df.sparkSession, tokenizer, tokenizer_dir), f"`{id_col}` {kind}, n_tokens bigint, n_chars bigint, n_letters bigint", make)
