"""Records that differ only in formatting or in which column holds which text.

Texts are read as streams of code points through one lookup table that skips white space and punctuation and folds letter
case. A sign that is kept adds its term to two polynomial hashes, whose power is the number of signs kept before it; a skipped one
adds nothing, so no canonical string or array is built. Rows with equal hashes are compared by two pointers that skip by the same
table on either side, a stretch of signs at a time for all rows at once, before they count as copies.
"""
from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.encoding import as_texts, slices
from lexiloom.plans.skew import join_unique
from lexiloom.plans.staging import cut

#: Prime moduli and bases of the two hashes.
HASHES = ((2147483647, 1000003), (2147483629, 69069069))
#: Signs that all rows of a comparison together look at in one step.
STRETCH = 1 << 20
#: Copies of one record that are compared with one replica of its first row.
COPIES_PER_REPLICA = 50_000


@lru_cache(1)
def fold_table() -> np.ndarray:
    """For every code point 0 where it is skipped (white space, punctuation), else its lower-case code point."""

    def fold(i: int) -> int:
        c = chr(i)
        if c.isspace() or unicodedata.category(c)[0] == "P":
            return 0
        low = c.lower()
        return ord(low) if len(low) == 1 else i

    table = np.fromiter((fold(i) for i in range(sys.maxunicode + 1)), np.uint32, sys.maxunicode + 1)
    table[0x3C2] = 0x3C3  # final sigma is a form of sigma
    return table


_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(n: int, p: int, base: int) -> np.ndarray:
    """base ** i modulo p for i below n."""
    known = _powers.get((p, base), np.ones(1, np.uint64))
    while len(known) < n:
        step = pow(base, len(known), p)
        known = np.concatenate([known, known * np.uint64(step) % np.uint64(p)])
    _powers[p, base] = known
    return known[:n]


@dataclass
class Stream:
    """Texts as they are, each sign through the fold table (0: skipped), where each text begins, and how many signs are kept before each place."""

    folded: np.ndarray
    first: np.ndarray
    kept: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> "Stream":
        t = as_texts(column, False)
        folded = fold_table()[t.cp]
        return cls(folded, t.first, np.concatenate([[0], np.cumsum(folded != 0)]))

    def sizes(self) -> np.ndarray:
        return np.diff(self.kept[self.first])


def fingerprints(column: pa.Array) -> np.ndarray:
    """62-bit hash of every text of an Arrow string column; -1 for null."""
    t = Stream.of(column)
    length = np.diff(t.first)
    full = length > 0
    out = np.zeros(len(length), np.int64)
    power = t.kept[:-1] - np.repeat(t.kept[t.first[:-1]], length)
    for p, base in HASHES:
        part = np.zeros(len(length), np.uint64)
        if len(t.folded):
            terms = t.folded.astype(np.uint64) * _power(int(t.sizes().max()) + 1, p, base)[power] % np.uint64(p)
            part[full] = np.add.reduceat(terms, t.first[:-1][full]) % np.uint64(p)
        out = (out << 31) | part.astype(np.int64)
    out[np.asarray(column.is_null())] = -1
    return out


def same_text(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Whether the texts of two columns are equal row by row but for what the table skips and folds; null equals only null.

    Each row has a pointer on either side. In a step both move over their next kept signs, as many as all rows together may
    look at, past whatever is skipped between; a row is done at its first difference or its end."""
    a, b = Stream.of(left), Stream.of(right)
    a_null, b_null = np.asarray(left.is_null()), np.asarray(right.is_null())
    sizes = a.sizes()
    same = (sizes == b.sizes()) & ~a_null & ~b_null
    open_, at = np.flatnonzero(same & (sizes > 0)), 0
    while len(open_):
        step = max(64, STRETCH // len(open_))
        n = np.minimum(sizes[open_] - at, step)
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at
        row = np.repeat(open_, n)
        pointers = (np.searchsorted(x.kept, x.kept[x.first[row]] + rank, "right") - 1 for x in (a, b))
        differ = np.not_equal(*(x.folded[i] for x, i in zip((a, b), pointers)))
        same[row[differ]] = False
        at += step
        open_ = open_[same[open_] & (sizes[open_] > at)]
    return same | (a_null & b_null)


def _hash_rows(batches):
    for batch in batches:
        for i, j in slices(batch.column(1)):
            part = batch.slice(i, j - i)
            x, y = fingerprints(part.column(1)), fingerprints(part.column(2))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["row", "ka", "kb"])


def _verify(batches):
    for batch in batches:
        for i, j in slices(batch.column(2)):
            b = batch.slice(i, j - i)
            first, copy, en, fr, en0, fr0 = b.columns
            ok = (same_text(en, en0) & same_text(fr, fr0)) | (same_text(en, fr0) & same_text(fr, en0))
            yield pa.RecordBatch.from_arrays([first, copy, pa.array(ok)], names=["first_id", "copy_id", "same"])


def _regroup(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows whose hash is another record's by chance, grouped among themselves: the first row left takes all that equal it."""
    rows, out = rows.sort_values("row").reset_index(drop=True), []
    while len(rows) > 1:
        en, fr = (pa.array(rows[c].where(rows[c].notna(), None).tolist(), pa.string()) for c in ("en", "fr"))
        head = lambda x: pa.array([x[0].as_py()] * len(x), pa.string())
        same = (same_text(en, head(en)) & same_text(fr, head(fr))) | (same_text(en, head(fr)) & same_text(fr, head(en)))
        out += [(rows["row"][0], r) for r in rows["row"][same][1:]]
        rows = rows[~same].reset_index(drop=True)
    return pd.DataFrame(out, columns=["first_id", "copy_id"])


def _once(df: DataFrame, id_col: str, left_col: str, right_col: str, time_col: str) -> DataFrame:
    """(row, en, fr): one row for each id, the last by time_col where there is such a column, then by its texts."""
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("row"), F.col(left_col).cast("string").alias("en"), F.col(right_col).cast("string").alias("fr"), (F.col(time_col) if time_col in df.columns else F.lit(0)).alias("time"))
    return texts.groupBy("row").agg(F.max(F.struct("time", "en", "fr")).alias("last")).select("row", "last.en", "last.fr")


def formatting_copies(df: DataFrame, id_col: str = "row_id", left_col: str = "en", right_col: str = "fr", time_col: str = "loaded_at") -> DataFrame:
    """(first_id, copy_id): for every row that isn't the first of its record, the record's smallest id and the row's own.

    Two rows are one record when their two texts, in either order, are equal but for white space, punctuation (Unicode
    categories Z and P, control white space) and letter case. Null equals only null; a text without any other sign equals the empty text, not null.
    Rows delivered twice with the same id are one row, the last by time_col and then by its texts; rows with a null id are left out. An empty table gives an empty
    result; other columns are not read."""
    return _copies(cut(_once(df, id_col, left_col, right_col, time_col)))


def _copies(texts: DataFrame) -> DataFrame:
    """(first_id, copy_id) of texts (row, en, fr), unique in row and read several times."""
    kind = dict(texts.dtypes)["row"]
    keys = cut(texts.mapInArrow(_hash_rows, f"row {kind}, ka bigint, kb bigint"))
    groups = keys.groupBy("ka", "kb").agg(F.min("row").alias("first_id"), F.max("row").alias("last_id"), F.count(F.lit(1)).alias("n")).where("first_id <> last_id").drop("last_id")
    members = cut(join_unique(keys, groups, ["ka", "kb"], "n", keys.count()).where("row <> first_id").select("row", "first_id", "n"))
    # the first rows of hot records are replicated, so that no task compares all copies
    replicas = F.ceil(F.col("n") / COPIES_PER_REPLICA)
    firsts = members.select("first_id", "n").distinct().join(texts.select(F.col("row").alias("first_id"), F.col("en").alias("en0"), F.col("fr").alias("fr0")), "first_id").withColumn("replica", F.explode(F.sequence(F.lit(0), (replicas - 1).cast("int"))))
    copies = members.join(texts, "row").withColumn("replica", F.pmod(F.xxhash64("row"), replicas).cast("int"))
    judged = cut(copies.join(firsts.drop("n"), ["first_id", "replica"]).select("first_id", F.col("row").alias("copy_id"), "en", "fr", "en0", "fr0").mapInArrow(_verify, f"first_id {kind}, copy_id {kind}, same boolean"))
    strays = judged.where("not same").join(texts, F.col("copy_id") == F.col("row")).select("first_id", "row", "en", "fr")
    return judged.where("same").select("first_id", "copy_id").unionByName(strays.groupBy("first_id").applyInPandas(_regroup, f"first_id {kind}, copy_id {kind}"))


def collapse_formatting(df: DataFrame, id_col: str = "row_id", left_col: str = "en", right_col: str = "fr", time_col: str = "loaded_at") -> DataFrame:
    """One row for each record: (first_id, en, fr, n_copies), the texts as the first row has them.

    n_copies counts the record's ids, the first included; the rest as for formatting_copies."""
    texts = cut(_once(df, id_col, left_col, right_col, time_col))
    copies = cut(_copies(texts))
    counts = copies.groupBy("first_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = texts.withColumnRenamed("row", "first_id")
    return firsts.join(copies.select(F.col("copy_id").alias("first_id")), "first_id", "left_anti").join(counts, "first_id", "left").select("first_id", "en", "fr", (F.coalesce("n", F.lit(0)) + 1).alias("n_copies"))
