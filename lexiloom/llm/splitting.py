"""Splitting texts above a token limit at natural boundaries.

Tokens are counted by the vectorised encoder, which hands on one letter per token: the strength of the boundary behind
it. On that string of letters the split itself is one bounded-quantifier regular expression: alternatives ordered by
boundary strength consume up to the limit, with single signs as the last resort. Overlaps are look-backs by token
offset. Everything behind the encoder is Spark's array functions, and work is linear in the text.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import encoding
from lexiloom.llm.vocab import TOKENIZER_DIR, Shipped

#: Letters of boundaries behind a token, strongest first: paragraph, line, sentence, clause, word, inside a word; x: inside a sign.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, INSIDE, BROKEN = "PLSCWNx"
#: Signs that end a sentence or a clause, and signs that may follow before the white space.
SENTENCE_ENDS, CLAUSE_ENDS, CLOSERS = ".!?…。！？", ",;:—–，；：", "\"'»”’)]"
#: A boundary that isn't a word's counts only where a piece of at least this share of the limit ends there.
LEAST_SHARE = 0.5
#: Pieces whose sizes are summed up as one chunk.
CHUNK = 256
#: Rows of split_limits are read on the driver up to this number.
MOST_LIMITS = 1000


def _boundaries(t: encoding.Texts) -> np.ndarray:
    """Letter of the boundary before every code point and behind the last."""
    n = len(t.cp)
    kind = encoding.classes()[t.cp]
    space = kind == encoding.SPACE
    at = np.arange(n)
    word = np.concatenate([[-1], np.maximum.accumulate(np.where(space, -1, at))])  # the last sign before that isn't white space
    core = np.concatenate([[-1], np.maximum.accumulate(np.where(space | np.isin(t.cp, [ord(c) for c in CLOSERS]), -1, at))])
    lines = np.concatenate([[0], np.cumsum(t.cp == 10)])
    broken = lines[np.arange(n + 1)] - lines[word + 1]
    beside = np.zeros(n + 1, bool)  # white space on one side
    beside[1:] |= space
    beside[:n] |= space
    last = np.where(core >= 0, t.cp[np.maximum(core, 0)], 0) if n else np.zeros(1, np.uint32)
    ended = np.isin(last, [ord(c) for c in SENTENCE_ENDS])
    paused = np.isin(last, [ord(c) for c in CLAUSE_ENDS])
    wide = np.isin(last, [ord(c) for c in "。！？"]) & (core == np.arange(n + 1) - 1)
    out = np.full(n + 1, ord(INSIDE), np.uint8)
    out[beside] = ord(WORD)
    out[beside & paused] = ord(CLAUSE)
    out[beside & ended | wide] = ord(SENTENCE)
    out[broken == 1] = ord(LINE)
    out[broken >= 2] = ord(PARAGRAPH)
    return out


def _tokens(df: DataFrame, id_col: str, text_col: str, shipped: Shipped, least: int) -> DataFrame:
    """(id_, n_tokens, marks, ends, raw) of the rows with more than `least` tokens; ends are byte offsets behind tokens."""
    prefix = shipped.name.startswith("piece")

    def make(part, e):
        t = e.texts
        marks = np.full(len(t.raw) + 1, ord(BROKEN), np.uint8)
        marks[np.append(t.lead, len(t.raw))] = _boundaries(t)
        long = np.flatnonzero(e.counts > least)
        edge = np.concatenate([[0], np.cumsum(e.counts)])
        keep = np.repeat(e.counts > least, e.counts)
        offsets = np.concatenate([[0], np.cumsum(e.counts[long])]).astype(np.int32)
        blank = (np.diff(t.at) > 0).astype(np.int64) if prefix else np.zeros(len(t.at) - 1, np.int64)  # the blank in front isn't text
        ends = np.maximum(e.ends - np.repeat(t.at[:-1] + blank, e.counts), 0)[keep].astype(np.int32)
        letters = np.ascontiguousarray(marks[e.ends][keep])
        letters[np.flatnonzero(ends == 0)] = ord(BROKEN)  # nothing is cut behind the blank in front alone
        texts = part.column(1).take(pa.array(long)).cast(pa.binary())
        return pa.RecordBatch.from_arrays(
            [
                part.column(0).take(pa.array(long)),
                pa.array(np.diff(edge)[long]),
                pa.Array.from_buffers(pa.binary(), len(long), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(ends)),
                texts,
            ],
            names=["id_", "n_tokens", "marks", "ends", "raw"],
        )

    kind = dict(df.dtypes)[id_col]
    wide = df.where(F.octet_length(F.col(text_col).cast("string")) >= least)  # a token has a byte at least, but for the blank in front
    return encoding._run(wide, id_col, text_col, shipped, f"id_ {kind}, n_tokens bigint, marks binary, ends array<int>, raw binary", make)


def pattern(most: int, overlap: int) -> str:
    """One piece: all that is left, else the longest stretch up to the limit that ends at the strongest boundary."""

    def part(limit: int) -> str:
        least = max(1, int(limit * LEAST_SHARE))
        strong = "|".join(f".{{{least - 1},{limit - 1}}}{x}" for x in (PARAGRAPH, LINE, SENTENCE, CLAUSE))
        ends = rf".{{1,{limit}}}\z|{strong}|.{{0,{limit - 1}}}[{PARAGRAPH}{LINE}{SENTENCE}{CLAUSE}{WORD}]"
        return f"{ends}|.{{0,{limit - 1}}}[^{BROKEN}]|.{{1,{limit}}}"

    return part(most) if not overlap else rf"\A(?:{part(most)})|(?:{part(most - overlap)})"


def split_texts(df: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Pieces of every text with more tokens than a limit: (limit_id, id_col, piece_no, token_start, token_end, n_tokens, n_shared, boundary, piece).

    limits: (limit_id, tokenizer, max_tokens, overlap_tokens), at most MOST_LIMITS rows; rows without tokenizer or
    max_tokens and repeated rows are left out, a null overlap is none; an overlap not below max_tokens, or an unknown
    tokenizer, is a ValueError. token_start and token_end count the whole text's tokens, from 0 and exclusive; a piece
    begins overlap_tokens before the end of the piece before it, or up to three tokens later where a token begins inside a sign.
    boundary is the letter of the boundary at its end. Pieces put end to end without what they share are the text.
    Empty, null and short texts have no pieces. A tokenizer that puts a blank in front of a text is asked for one token
    less than max_tokens, so that a piece by itself also keeps the limit. Repeated rows give repeated pieces; other
    columns are not read."""
    spark = df.sparkSession
    rows = limits.select("limit_id", "tokenizer", "max_tokens", "overlap_tokens").where("tokenizer is not null and max_tokens is not null").distinct().limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    kind = dict(df.dtypes)[id_col]
    out = None
    for name in sorted({r.tokenizer for r in rows}):
        shipped = Shipped(spark, name, tokenizer_dir)
        of_name = sorted((r.limit_id, r.max_tokens, r.overlap_tokens or 0) for r in rows if r.tokenizer == name)
        tokens = _tokens(df, id_col, text_col, shipped, min(m for _, m, _ in of_name))
        reserve = 1 if name.startswith("piece") else 0
        wanted = []
        for limit_id, most, overlap in of_name:
            if not 0 <= overlap < most - reserve:
                raise ValueError(f"limit {limit_id}: overlap_tokens must be below max_tokens")
            wanted.append((limit_id, most, overlap, most - reserve))
        # 1. token counts of the pieces, by the pattern
        staged = tokens.select("*", *(F.when(F.col("n_tokens") > most, F.transform(F.regexp_extract_all(F.col("marks").cast("string"), F.lit(f"({pattern(use, overlap)})"), F.lit(0)), F.length)).alias(f"sizes_{k}") for k, (_, most, overlap, use) in enumerate(wanted)))
        # 2. running sums: where each piece ends
        staged = staged.select("id_", "marks", "ends", "raw", *(_running(F.col(f"sizes_{k}")).alias(f"cuts_{k}") for k in range(len(wanted))))
        # 3. look-backs and slices of the bytes
        staged = staged.select("id_", F.flatten(F.filter(F.array(*(_spans(k, limit_id, overlap) for k, (limit_id, _, overlap, _) in enumerate(wanted))), F.isnotnull)).alias("pieces"))
        # outer, since each row has pieces: a plain inline has Catalyst push a filter that works out cuts_k once per piece
        part = staged.select("id_", F.inline_outer("pieces")).select("limit_id", F.col("id_").alias(id_col), "piece_no", "token_start", "token_end", (F.col("token_end") - F.col("token_start")).alias("n_tokens"), "n_shared", "boundary", "piece")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"limit_id int, `{id_col}` {kind}, piece_no int, token_start int, token_end int, n_tokens int, n_shared int, boundary string, piece string")
    return out


def _sums(a: Column, first: Column) -> Column:
    """first, and the running sums from there on. Each step copies the array, so it is for short ones."""
    return F.aggregate(a, F.array(first), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _running(sizes: Column) -> Column:
    """0 and the running sums of an array of any length: within chunks of CHUNK elements, and over the chunks' totals."""
    count = F.size(sizes)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(count, F.lit(1)) - 1) / CHUNK).cast("int")), lambda i: F.slice(sizes, i * CHUNK + 1, F.lit(CHUNK)))
    total = lambda c: F.aggregate(c, F.lit(0), lambda acc, n: acc + n)
    # chunk by chunk, each from the sum before it; one chunk is the usual case
    starts = _sums(F.transform(chunks, total), F.lit(0))
    many = F.concat(F.array(F.lit(0)), F.flatten(F.transform(chunks, lambda c, i: F.slice(_sums(c, F.get(starts, i)), F.lit(2), F.lit(CHUNK)))))
    return F.when(count <= CHUNK, _sums(sizes, F.lit(0))).otherwise(many)


def _spans(k: int, limit_id: int, overlap: int) -> Column:
    """Array of the pieces' structs from cuts_k, the ends of pieces in tokens behind a leading 0."""
    cuts = F.col(f"cuts_{k}")

    def letters(token: Column, n: int) -> Column:
        """n letters from the one behind token `token` - 1 on; marks is binary, so this doesn't walk through the text."""
        return F.substring("marks", token, F.lit(n)).cast("string")

    def whole(token: Column) -> Column:
        """The first token from `token` on that begins a sign."""
        return token + F.length(F.regexp_extract(letters(token, 3), f"^{BROKEN}*", 0))

    def span(i: Column) -> Column:
        before, end = F.get(cuts, i), F.get(cuts, i + 1)
        start = F.when(i == 0, F.lit(0)).otherwise(whole(F.greatest(before - overlap, F.lit(1))) if overlap else before)
        return F.struct(i.alias("i"), start.alias("start"), end.alias("end"), before.alias("before"))

    def cut(p: Column) -> Column:
        from_byte = F.when(p["start"] > 0, F.get(F.col("ends"), p["start"] - 1)).otherwise(F.lit(0))
        to_byte = F.get(F.col("ends"), p["end"] - 1)
        return F.struct(
            F.lit(limit_id).cast("int").alias("limit_id"),
            p["i"].alias("piece_no"),
            p["start"].alias("token_start"),
            p["end"].alias("token_end"),
            F.greatest(p["before"] - p["start"], F.lit(0)).alias("n_shared"),
            letters(p["end"], 1).alias("boundary"),
            F.substring("raw", from_byte + 1, to_byte - from_byte).cast("string").alias("piece"),
        )

    return F.transform(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), span), cut)
