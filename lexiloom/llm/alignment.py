"""Alignment of the sentences of two language versions of a work.

1. Vectors. Terms of paired documents (any table of rough translations) are counted together over all rows. The correlations
   of the most frequent terms of both languages are decomposed by SVD, which puts both languages' terms into one space. The
   rarer terms, from SEEN documents on, are read from the same term by document matrix through a random projection of the documents:
   two terms that stand in the same pairs have like vectors. Terms written alike that stand on both sides of their pairs (names,
   numbers), and terms never seen, have a vector made from their letters, the same in both languages; where such a term is frequent, beside its own.
2. Where to look. Signatures of random hyperplanes that one segment of either version alone has give anchors; their median offset in
   each cell of CELL segments tells which stretch of the other version the cell is compared with. Cells joined by several
   anchors elsewhere (moved chapters) are compared too. Work grows with the number of segments, not with its square, and a cell is
   a small group whatever share of all rows one work holds. A work of up to two cells is one cell.
3. Matching. Segments are cut into clauses; windows of up to three clauses are compared by cosine, scored by their margin over
   the neighbours of both, and taken where each is the other's best; distance from the local trend costs a little. Clauses
   left over are compared again whatever their distance, with all that are left over in the whole other version.

Batches of many groups are read as one: one regular expression and Arrow's dictionary give all words of a batch, sums of word vectors give
its clauses, and the coverage of all candidate windows of a group is one look-up in a matrix of word likenesses.
"""
from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.lookalike import LETTERS
from lexiloom.plans.skew import join_unique
from lexiloom.plans.staging import cut

#: Terms of each language in the decomposition, by document frequency, from LEAST documents on: the driver holds this number
#: squared of counts. Terms beyond, from SEEN documents on, are projected; so many of each language are held (64 bytes each).
VOCABULARY, LEAST = 3000, 3
PROJECTED, SEEN = 100_000, 3
#: A term is itself in both languages where at least this part of its documents has it on both sides.
ALIKE_SHARE = 0.5
#: Dimensions of the decomposition, and of the vectors of terms outside it.
RANK, OUTSIDE = 192, 64
#: Segments of a cell, of the margin around it, and around its stretch of the other version.
CELL, HALO, REACH = 256, 12, 64
#: Signatures of a segment, and their bits.
TABLES, BITS = 8, 24
#: Acceptance: score less what distance costs, coverage of both windows' terms, distance from the local trend in segments
#: up to which each step costs the same.
LEAST_SCORE, LEAST_COVERAGE, FARTHEST = 0.42, 0.62, 20
#: Clauses that this leaves over are compared once more, wherever they stand: any distance together costs FAR_COST, so that of two
#: equal sentences the nearer one wins; the cosine must be FAR_COSINE, and the margin FAR_MARGIN unless the cosine is FAR_SURE.
FAR_COST, FAR_COSINE, FAR_MARGIN, FAR_SURE = 0.03, 0.75, 1.06, 0.93
#: Clauses that the cells of a large work leave over, in a block compared with each such block of the other version.
LEFT_OVER = 1024
#: Where one side says more than the other (a phrase left out), this much of the longer and of the shorter must be covered.
PART_COVERAGE, FULL_COVERAGE = 0.35, 0.88
STEP_COST = 0.012
#: Neighbours for the margin, the weight of the margin in the score, and the least margin of single clauses.
NEIGHBOURS, MARGIN_WEIGHT, LEAST_MARGIN = 4, 0.1, 1.04
#: Likeness of two terms that counts nothing, and further likeness that counts whole.
UNLIKE, LIKE_SPAN = 0.3, 0.5

_thousands = re.compile(r"(?<=[0-9])[ ,.](?=[0-9]{3}(?![0-9]))")
#: Words, ends of clauses (sentence ends, semicolons, conjunctions with some words behind) and the end of a text.
_marks = re.compile(r"[^\W_]+|\n|[.?!](?=[\"'»”’)\] ]* [^ \n])|;(?= +[^ \n])|, +(?:and|et)(?= +[^ \n]+ +[^ \n]+ +[^ \n])")


class _Fold(dict):
    """A table for str.translate: lower case without accents, look-alikes of other scripts as Latin letters, white space as blanks,
    nothing for what prints nothing. Filled as signs are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c.isspace():
            out = " "
        elif unicodedata.category(c) == "Cf":
            out = ""
        else:
            c = {"œ": "oe", "Œ": "oe", "æ": "ae", "Æ": "ae", "’": "'"}.get(c, LETTERS.get(c, c))
            out = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        self[code] = out
        return out


_fold = _Fold({10: "\n"})  # stands between texts; texts' own line ends are blanks by then


@dataclass
class Words:
    """The words of many texts: distinct words, the number of each word, the first word of each clause (with an end), and each clause's text."""

    names: list[str]
    codes: np.ndarray
    starts: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> "Words":
        none = np.zeros(0, np.int64)
        if not texts:
            return cls([], none, np.zeros(1, np.int64), none)
        folded = "\n".join((x.replace("\n", " ") if "\n" in x else x) if x else "" for x in texts).translate(_fold)
        found = pa.array(_marks.findall(_thousands.sub("", folded) + "\n"), pa.string()).dictionary_encode()
        names, codes = found.dictionary.to_pylist(), np.asarray(found.indices).astype(np.int64)
        mark = np.array([not x[0].isalnum() for x in names], bool)[codes]
        end = codes == names.index("\n")
        word = ~mark
        row = (np.cumsum(end) - end)[word]
        clause = np.cumsum(mark)[word]
        first = np.flatnonzero(np.diff(clause, prepend=-1))
        return cls(names, codes[word], np.append(first, len(clause)), row[first])

    def parts(self) -> np.ndarray:
        """Number of each clause within its text, from 0."""
        new = np.flatnonzero(np.diff(self.row, prepend=-1))
        return np.arange(len(self.row)) - np.repeat(new, np.diff(np.append(new, len(self.row))))


def terms(text: str | None) -> list[str]:
    """The words of a text as they are compared."""
    w = Words.of([text])
    return [w.names[c] for c in w.codes]


def clauses(text: str | None) -> list[list[str]]:
    """The words of each stretch between sentence ends, semicolons and conjunctions; windows join what is cut too finely."""
    w = Words.of([text])
    return [[w.names[c] for c in w.codes[i:j]] for i, j in zip(w.starts, w.starts[1:])]


def _spelling(words: list[str]) -> np.ndarray:
    """Unit vectors made from the words' letters."""
    bits = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=OUTSIDE // 8).digest() for w in words), np.uint8).reshape(len(words), OUTSIDE // 8)
    return (np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(OUTSIDE))


def _unit(m: np.ndarray) -> np.ndarray:
    return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)).astype(np.float32)


@dataclass
class Space:
    """Vectors of both languages' terms, a pair of each: core terms with their numbers and unit vectors; projected terms with
    theirs; weights (inverse document frequency) of the core, then the projected terms; likeness of core terms in 255ths."""

    index: tuple[dict[str, int], dict[str, int]]
    vectors: tuple[np.ndarray, np.ndarray]
    projected: tuple[np.ndarray, np.ndarray]
    weights: tuple[np.ndarray, np.ndarray]
    alike: dict[str, float]
    rare: float
    like: np.ndarray

    def lookup(self, words: list[str], side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors, weights and core numbers (-1 for others) of the words."""
        index, n = self.index[side], len(self.vectors[side])
        at = np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))
        out = np.zeros((len(words), RANK + OUTSIDE), np.float32)
        core, middle, other = at >= 0, at >= n, np.flatnonzero(at < 0)
        core &= ~middle
        if core.any():
            out[core, : self.vectors[side].shape[1]] = self.vectors[side][at[core]]
        if middle.any():
            out[middle, RANK:] = _unit(self.projected[side][at[middle] - n].astype(np.float32))
        weight = np.append(self.weights[side], np.float32(self.rare))[at]
        if len(other):
            weight[other] = [self.alike.get(words[i], self.rare) for i in other]
        spelt = np.flatnonzero((at < 0) | np.fromiter((w in self.alike for w in words), bool, len(words)))
        if len(spelt):
            out[spelt, RANK:] = _spelling([words[i] for i in spelt])
        return _unit(out), weight, np.where(core, at, -1)


def learn(pairs: DataFrame, left_col: str, right_col: str, vocabulary: int = VOCABULARY, rank: int = RANK) -> Space:
    """The space of terms from paired texts. Counts cover all rows; rows with a null side are no pair. Which column holds
    which language is told for each row by votes: terms vote for the column in which most rows have them, so a row whose
    texts are swapped is turned round. An empty table gives a space in which terms only match themselves.

    Each task adds its rows up before it hands anything on, and there are no more tasks than cores, so what is shuffled
    doesn't grow with the rows: at most `vocabulary` squared counts and 2 * PROJECTED projections a core."""
    spark = pairs.sparkSession
    docs = pairs.where(F.col(left_col).isNotNull() & F.col(right_col).isNotNull()).select(F.col(left_col).cast("string").alias("a"), F.col(right_col).cast("string").alias("b"))
    docs = docs.coalesce(spark.sparkContext.defaultParallelism)  # never more partitions than there are

    def tally(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            w = Words.of(batch.column(0).to_pylist() + batch.column(1).to_pylist())
            doc, code = _distinct(w)
            side = doc >= n
            size = len(w.names)
            both = np.intersect1d((doc[~side]) * size + code[~side], (doc[side] - n) * size + code[side], assume_unique=True) % max(size, 1)
            counts = np.stack([np.bincount(x, minlength=size) for x in (code[~side], code[side], both)], axis=1)
            for name, c in zip(w.names, counts):
                total[name] = total[name] + c if name in total else c
        if total:
            c = np.array(list(total.values()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array(c[:, k]) for k in range(3))], names=["term", "na", "nb", "both"])

    counted = cut(docs.mapInArrow(tally, "term string, na bigint, nb bigint, both bigint").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("na", "nb", "both"))).where(f"greatest(na, nb) >= {SEEN}"))
    known = {r.term: (r.na, r.nb, r.both) for c in ("na", "nb") for r in counted.orderBy(F.col(c).desc(), "term").limit(vocabulary + PROJECTED).collect() if r.term[0].isalnum()}
    votes = {t: float(np.sign(a - b)) * min(1.0, abs(np.log((a + 0.5) / (b + 0.5))) / 2) for t, (a, b, _) in known.items()}
    same = {t for t, (a, b, both) in known.items() if both >= ALIKE_SHARE * max(a, b)}
    index: list[dict[str, int]] = []
    for k in (0, 1):  # a language's own terms, the most frequent first
        own = sorted((t for t, n in known.items() if n[k] >= SEEN and n[k] >= n[1 - k] / 4), key=lambda t: (-known[t][k], t))
        core = [t for t in own[:vocabulary] if known[t][k] >= LEAST]
        index.append({t: i for i, t in enumerate([*core, *[t for t in own[len(core) :] if t not in same][:PROJECTED]])})
        index[k]["\n"] = len(core)  # how many are core terms
    width = [x.pop("\n") for x in index]
    shipped = spark.sparkContext.broadcast((votes, index, width))

    def meet(batches):
        votes, index, width = shipped.value
        counts = np.zeros(width[0] * width[1], np.int32)
        single = [np.zeros(len(x), np.int64) for x in index]
        sums = [np.zeros((len(x) - n, OUTSIDE), np.int32) for x, n in zip(index, width)]
        rows = 0
        for batch in batches:
            n = batch.num_rows
            rows += n
            texts = batch.column(0).to_pylist() + batch.column(1).to_pylist()
            w = Words.of(texts)
            doc, code = _distinct(w)
            vote = np.fromiter((votes.get(x, 0.0) for x in w.names), float, len(w.names))[code]
            said = np.bincount(doc, vote, 2 * n)
            turned = np.tile(said[:n] < said[n:], 2)
            side = (doc >= n) ^ turned[doc]
            doc = doc % n
            found = []
            signs = np.random.default_rng(zlib.crc32((texts[0] or "").encode()) + n).integers(0, 2, (n, OUTSIDE), dtype=np.int8) * 2 - 1
            for k in (0, 1):
                at = np.fromiter((index[k].get(x, -1) for x in w.names), np.int64, len(w.names))[code]
                mine = (side == bool(k)) & (at >= 0)
                np.add.at(single[k], at[mine], 1)
                far = mine & (at >= width[k])
                np.add.at(sums[k], at[far] - width[k], signs[doc[far]])
                near = mine & (at < width[k])
                order = np.argsort(doc[near], kind="stable")
                found.append((doc[near][order], at[near][order]))
            (da, ia), (db, ib) = found  # all pairs of a core term of one side and one of the other, document by document
            per_b, first_b = np.bincount(db, minlength=n), np.searchsorted(db, np.arange(n))
            many = per_b[da]
            left = np.repeat(ia, many)
            right = ib[np.repeat(first_b[da], many) + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)]
            np.add.at(counts, left * width[1] + right, 1)
        counts = counts.reshape(width)
        out = [(0, int(i), counts[i].tobytes()) for i in np.flatnonzero(counts.any(1))] + [(1 + k, int(i), sums[k][i].tobytes()) for k in (0, 1) for i in np.flatnonzero(sums[k].any(1))]
        out += [(3 + k, 0, single[k].astype(np.int32).tobytes()) for k in (0, 1)] + [(5, 0, np.array([rows], np.int32).tobytes())]
        for i in range(0, len(out), 2000):
            kind, key, data = zip(*out[i : i + 2000])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int32()), pa.array(data, pa.binary())], names=["kind", "key", "data"])

    def add_up(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for kind, key, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                v = np.frombuffer(data, np.int32).astype(np.int64)
                total[kind, key] = total[kind, key] + v if (kind, key) in total else v
        for (kind, key), v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([key], pa.int32()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], names=["kind", "key", "data"])

    schema = "kind int, key int, data binary"
    summed = docs.mapInArrow(meet, schema).repartition("kind", "key").mapInArrow(add_up, schema).toArrow()
    corr = np.zeros(width, np.float32)
    projected = [np.zeros((len(x) - n, OUTSIDE), np.float32) for x, n in zip(index, width)]
    single, total = [np.zeros(len(x)) for x in index], 0.0
    for kind, key, data in zip(*(summed.column(k).to_pylist() for k in range(3))):
        v = np.frombuffer(data, np.float32)
        if kind == 0:
            corr[key] = v
        elif kind < 3:
            projected[kind - 1][key] = v
        elif kind < 5:
            single[kind - 3] = v.astype(float)
        else:
            total = float(v[0])
    n = [np.maximum(x, 1.0) for x in single]
    weights = tuple(np.log((total + 1) / x).astype(np.float32) for x in n)
    rare = max(float(np.log((total + 1) / max(SEEN, LEAST))), 1.0)
    alike = {t: min(rare, float(np.log((total + 1) / max(known[t][:2])))) for t in same}
    small = tuple((127 * x / np.maximum(np.abs(x).max(1, keepdims=True), 1)).astype(np.int8) if len(x) else x.astype(np.int8) for x in projected)
    if not width[0] or not width[1]:
        return Space(tuple(index), tuple(np.zeros((w, rank), np.float32) for w in width), small, weights, alike, rare, np.zeros(width, np.uint8))
    core = [x[:w] for x, w in zip(n, width)]
    spread = [np.sqrt(np.maximum(x * (1 - x / max(total, 1)), 1e-9)) for x in core]
    for i in range(len(corr)):  # in place, row by row: the matrix is the largest thing that the driver holds
        corr[i] = (corr[i] - core[0][i] * core[1] / max(total, 1)) / (spread[0][i] * spread[1])
    u, s, vt = _decompose(corr, rank)
    vectors = (_unit(u * np.sqrt(s)), _unit(vt.T * np.sqrt(s)))
    like = np.clip((vectors[0] @ vectors[1].T - UNLIKE) * (255 / LIKE_SPAN), 0, 255).astype(np.uint8)
    return Space(tuple(index), vectors, small, weights, alike, rare, like)


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of every word of every text, each once."""
    at = np.unique(np.repeat(w.row, np.diff(w.starts)) * len(w.names) + w.codes)
    return at // max(len(w.names), 1), at % max(len(w.names), 1)


def _decompose(m: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading singular triplets, by a randomised range with power iterations; outright for small matrices."""
    if min(m.shape) <= 2 * rank:
        u, s, vt = np.linalg.svd(m, full_matrices=False)
        return u[:, :rank], s[:rank], vt[:rank]
    q = np.linalg.qr(m @ np.random.default_rng(1).standard_normal((m.shape[1], min(rank + 32, min(m.shape)))).astype(m.dtype))[0]
    for _ in range(3):
        q = np.linalg.qr(m @ np.linalg.qr(m.T @ q)[0])[0]
    u, s, vt = np.linalg.svd(q.T @ m, full_matrices=False)
    return (q @ u)[:, :rank], s[:rank], vt[:rank]


class Read:
    """The words of many texts of both languages, with their vectors: groups of texts are cut from it."""

    def __init__(self, space: Space, texts: list[str | None], side: np.ndarray):
        self.space, self.words = space, Words.of(texts)
        w = self.words
        self.part, used = w.parts(), np.repeat(np.asarray(side)[w.row], np.diff(w.starts))
        self.vectors, self.weights, self.core, self.code = [], [], [], np.zeros(len(w.codes), np.int64)
        for k in (0, 1):
            mine = used == k
            own, code = np.unique(w.codes[mine], return_inverse=True)
            self.code[mine] = code
            v, weight, core = space.lookup([w.names[c] for c in own], k)
            self.vectors.append(v)
            self.weights.append(weight)
            self.core.append(core)

    def side(self, first: int, last: int, k: int) -> "Side":
        """The clauses of the texts first to last - 1, all of language k."""
        w = self.words
        a, b = np.searchsorted(w.row, (first, last))
        starts = w.starts[a : b + 1]
        codes = self.code[starts[0] : starts[-1]]
        vectors = np.add.reduceat(self.vectors[k][codes] * self.weights[k][codes, None], starts[:-1] - starts[0], axis=0) if b > a else np.zeros((0, RANK + OUTSIDE), np.float32)
        return Side(w.row[a:b] - first, self.part[a:b], starts - starts[0] if b > a else np.zeros(1, np.int64), codes, vectors)


@dataclass
class Side:
    """Clauses of one version's segments in order: number of the segment in the group, number in the segment, first words, words, vectors."""

    row: np.ndarray
    part: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    vectors: np.ndarray


class Coverage:
    """How much of the weight of a window's terms has a counterpart in another window, for many pairs of windows at once."""

    def __init__(self, read: Read, a: Side, b: Side):
        words, padded, weights = [], [], []
        for k, x in ((0, a), (1, b)):
            own, code = np.unique(x.codes, return_inverse=True)
            sizes = np.diff(x.starts)
            pad = np.full((len(sizes), int(sizes.max(initial=1))), len(own))
            pad[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(code)) - np.repeat(x.starts[:-1], sizes)] = code
            words.append(own)
            padded.append(pad)
            weights.append(np.append(read.weights[k][own], 0).astype(np.float32))
        core = [read.core[k][own] for k, own in enumerate(words)]
        like = np.zeros((len(words[0]) + 1, len(words[1]) + 1), np.float32)
        in_a, in_b = (np.flatnonzero(c >= 0) for c in core)
        like[np.ix_(in_a, in_b)] = read.space.like[np.ix_(core[0][in_a], core[1][in_b])] * np.float32(1 / 255)
        outside = [read.vectors[k][own, RANK:] for k, own in enumerate(words)]
        out_a, out_b = (np.flatnonzero(x.any(1)) for x in outside)
        at = np.ix_(out_a, out_b)
        like[at] = np.maximum(like[at], np.clip((_unit(outside[0][out_a]) @ _unit(outside[1][out_b]).T - UNLIKE) / LIKE_SPAN, 0, 1))
        self.like, self.padded, self.weights = like, padded, weights

    def of(self, i: np.ndarray, j: np.ndarray, i_size: int, j_size: int) -> tuple[np.ndarray, np.ndarray]:
        """The smaller and the larger part, for windows that begin at clauses i and j."""
        a = self.padded[0][i[:, None] + np.arange(i_size)].reshape(len(i), -1)
        b = self.padded[1][j[:, None] + np.arange(j_size)].reshape(len(j), -1)
        low, high = np.zeros(len(i), np.float32), np.zeros(len(i), np.float32)
        step = max(1, 2_000_000 // max(1, a.shape[1] * b.shape[1]))
        for k in range(0, len(i), step):
            x, y = a[k : k + step], b[k : k + step]
            sim = self.like[x[:, :, None], y[:, None, :]]
            wx, wy = self.weights[0][x], self.weights[1][y]
            p, q = (wx * sim.max(2)).sum(1) / np.maximum(wx.sum(1), 1e-9), (wy * sim.max(1)).sum(1) / np.maximum(wy.sum(1), 1e-9)
            low[k : k + step], high[k : k + step] = np.minimum(p, q), np.maximum(p, q)
        return low, high


_SHAPES = ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1))


def _windows(v: np.ndarray, size: int) -> np.ndarray:
    """Unit vectors of windows of `size` clauses, one for each start."""
    n = len(v) - size + 1
    if n <= 0:
        return np.zeros((0, v.shape[1]), np.float32)
    return _unit(sum(v[k : k + n] for k in range(size)))


def _best(sim: np.ndarray, k: int, axis: int) -> np.ndarray:
    """Mean of the k largest values along an axis."""
    n = sim.shape[axis]
    if n <= k:
        return sim.mean(axis)
    return (np.partition(sim, n - k, axis=1)[:, n - k :] if axis else np.partition(sim.T, n - k, axis=1)[:, n - k :]).mean(1)


def match(read: Read, a: Side, b: Side, left_at: np.ndarray, right_at: np.ndarray, whole: bool = True, anywhere: bool = False, used: list | None = None) -> list[tuple[int, int, float]]:
    """Pairs (row of left, row of right, score) of segments that render one another; *_at are the segments' positions, the right ones
    already moved by the expected offset. whole: nothing is missing in which what is left over could find its like, so it is
    looked up at any distance; anywhere: distance tells nothing from the start; used takes (side, row, clause) of what is in a pair."""
    if not len(a.row) or not len(b.row):
        return []
    pa_, pb = np.asarray(left_at, float)[a.row], np.asarray(right_at, float)[b.row]
    wins = [{size: _windows(x.vectors, size) for size in (1, 2, 3)} for x in (a, b)]
    single = wins[0][1] @ wins[1][1].T
    # local trend from clauses that are clearly each other's best
    pull = single - 0.002 * np.minimum(np.abs(pa_[:, None] - pb[None, :]), 60)
    best_b, best_a = pull.argmax(1), pull.argmax(0)
    sure = np.flatnonzero((best_a[best_b] == np.arange(len(pa_))) & (single[np.arange(len(pa_)), best_b] > 0.8))
    shift = np.zeros(len(pa_))
    if len(sure) >= 3:
        at, gap = pa_[sure], pb[best_b[sure]] - pa_[sure]
        order = np.argsort(at, kind="stable")
        at, gap = at[order], gap[order]
        padded = np.pad(gap, 6, constant_values=np.nan)
        shift = np.interp(pa_, at, np.nanmedian(np.lib.stride_tricks.sliding_window_view(padded, 13), axis=1))
    away = np.abs((pa_ + shift)[:, None] - pb[None, :]).astype(np.float32)
    found, shapes = [], []
    for i_size, j_size in _SHAPES:
        wa, wb = wins[0][i_size], wins[1][j_size]
        if not len(wa) or not len(wb):
            continue
        sim = single if i_size + j_size == 2 else wa @ wb.T
        near = (_best(sim, NEIGHBOURS, 1)[:, None] + _best(sim, NEIGHBOURS, 0)[None, :]) / 2
        dist = away if i_size + j_size == 2 else (away[: len(wa), : len(wb)] + away[i_size - 1 :, j_size - 1 :]) / 2
        shapes.append((i_size, j_size, sim, near, dist))
        if anywhere:
            continue
        score = np.where(dist <= FARTHEST, sim + MARGIN_WEIGHT * (sim - near) - STEP_COST * dist, np.float32(-1))
        at = score.argmax(1)
        i = np.flatnonzero((score.argmax(0)[at] == np.arange(len(at))) & (score[np.arange(len(at)), at] > LEAST_SCORE))
        j = at[i]
        if i_size + j_size == 2:
            keep = (sim[i, j] >= LEAST_MARGIN * near[i, j]) | (sim[i, j] > 0.85)
            i, j = i[keep], j[keep]
        found.append((score[i, j] - 0.02 * (i_size + j_size - 2), i, j, i_size, j_size))  # a larger window must earn what it adds
    covered = Coverage(read, a, b)
    used_a, used_b, out = [False] * len(pa_), [False] * len(pb), {}

    def take(found: list) -> None:
        """The best first, as far as their clauses are free and their terms have counterparts."""
        every = []
        for score, i, j, i_size, j_size in found:
            if len(i):
                low, high = covered.of(i, j, i_size, j_size)
                good = (low >= LEAST_COVERAGE) | ((low >= PART_COVERAGE) & (high >= FULL_COVERAGE))
                every += [(s, x, y, i_size, j_size) for s, x, y in zip(score[good].tolist(), i[good].tolist(), j[good].tolist())]
        for score, i, j, i_size, j_size in sorted(every, reverse=True):
            if any(used_a[i : i + i_size]) or any(used_b[j : j + j_size]):
                continue
            used_a[i : i + i_size] = [True] * i_size
            used_b[j : j + j_size] = [True] * j_size
            parts = [(x, y) for x in range(i, i + i_size) for y in range(j, j + j_size)]
            if i_size == j_size == 2:  # both merged: pair only clauses that share something
                x, y = np.array(parts).T
                parts = [p for p, h in zip(parts, covered.of(x, y, 1, 1)[1]) if h >= 0.5] or parts
            for x, y in parts:
                key = (int(a.row[x]), int(b.row[y]))
                out[key] = max(out.get(key, 0.0), score)

    take(found)
    found = []
    for i_size, j_size, sim, near, dist in shapes if whole and not (all(used_a) or all(used_b)) else ():
        free = [np.flatnonzero(~np.lib.stride_tricks.sliding_window_view(np.array(u), size).any(1)) for u, size in ((used_a, i_size), (used_b, j_size))]
        if not len(free[0]) or not len(free[1]):
            continue
        at = np.ix_(*free)
        sim, near, dist = sim[at], near[at], dist[at]
        good = (sim >= FAR_COSINE) & ((sim >= FAR_MARGIN * near) | (sim >= FAR_SURE))
        if not anywhere:
            good &= dist > FARTHEST
        score = np.where(good, sim + MARGIN_WEIGHT * (sim - near) - FAR_COST * dist / (dist + CELL), np.float32(-1))
        mutual = good & (score >= score.max(1, keepdims=True) - 1e-6) & (score >= score.max(0, keepdims=True) - 1e-6)
        i, j = np.nonzero(mutual)
        found.append((score[i, j] - 0.02 * (i_size + j_size - 2), free[0][i], free[1][j], i_size, j_size))
    take(found)
    if used is not None:
        used += [(side, int(x.row[i]), int(x.part[i])) for side, x, u in ((0, a, used_a), (1, b, used_b)) for i in np.flatnonzero(u)]
    return [(i, j, s) for (i, j), s in out.items()]


_planes = None


def _signatures(vectors: np.ndarray) -> np.ndarray:
    """TABLES numbers of BITS bits for each row: the sides of fixed random hyperplanes on which it lies."""
    global _planes
    if _planes is None:
        _planes = np.random.default_rng(11).standard_normal((RANK + OUTSIDE, TABLES * BITS)).astype(np.float32)
    bits = (vectors @ _planes > 0).reshape(len(vectors), TABLES, BITS)
    return bits @ (1 << np.arange(BITS, dtype=np.int64))


def _groups(batches, keys: int):
    """Tables of whole groups from batches sorted by their first `keys` columns, with where each group begins and ends;
    a group is small, so all groups of a batch come together and the last waits for the next batch."""
    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        change = np.zeros(max(table.num_rows - 1, 0), bool)
        for k in range(keys):
            v = np.asarray(table.column(k).combine_chunks())
            change |= v[1:] != v[:-1]
        edges = np.flatnonzero(change) + 1
        if len(edges):
            yield table.slice(0, edges[-1]).combine_chunks(), [0, *edges.tolist()]
            waiting = table.slice(edges[-1]).combine_chunks()
        else:
            waiting = table.combine_chunks()
    if waiting is not None and waiting.num_rows:
        yield waiting, [0, waiting.num_rows]


def works_of(books: DataFrame) -> DataFrame:
    """(work, book_id, side) of the books that make a work: titles equal but for ` (EN)` and ` (FR)` at the end; where a
    title occurs more than once in a language, books are paired in the order of their ids. Side 0 is English."""
    named = books.where("id is not null").select(F.col("id").alias("book_id"), F.regexp_extract("title", r"^(.*) \((?:EN|FR)\)\s*$", 1).alias("name"), F.regexp_extract("title", r" \((EN|FR)\)\s*$", 1).alias("version")).where("version <> ''").distinct()
    placed = named.withColumn("k", F.row_number().over(Window.partitionBy("name", "version").orderBy("book_id")))
    whole = placed.groupBy("name", "k").agg(F.min(F.expr("if(version = 'EN', book_id, null)")).alias("en"), F.min(F.expr("if(version = 'FR', book_id, null)")).alias("fr")).where("en is not null and fr is not null")
    return whole.select(F.col("en").alias("work"), F.explode(F.array(F.struct(F.col("en").alias("book_id"), F.lit(0).alias("side")), F.struct(F.col("fr").alias("book_id"), F.lit(1).alias("side")))).alias("b")).select("work", "b.*")


def _cells(rows: DataFrame, shipped) -> DataFrame:
    """(work, cell, part, shift, scale, low, high): cells of the English version, each with the French positions it is compared with."""
    extent = cut(rows.groupBy("work").agg(F.max(F.expr("if(side = 0, position, null)")).alias("n_en"), F.max(F.expr("if(side = 1, position, null)")).alias("n_fr")).where("n_en is not null and n_fr is not null"))
    small = extent.where((F.col("n_en") <= 2 * CELL) & (F.col("n_fr") <= 2 * CELL)).select("work", F.lit(0).cast("bigint").alias("cell"), F.lit(-1).alias("part"), F.lit(0.0).alias("shift"), (F.col("n_en") / F.greatest("n_fr", F.lit(1))).cast("double").alias("scale"), F.lit(0.0).alias("low"), F.col("n_fr").cast("double").alias("high"))
    large = extent.where((F.col("n_en") > 2 * CELL) | (F.col("n_fr") > 2 * CELL))

    def sign(batches):
        space = shipped.value
        for batch in batches:
            work, side, position = (batch.column(k) for k in range(3))
            read = Read(space, batch.column(3).to_pylist(), np.asarray(side))
            w = read.words
            if not len(w.codes):
                continue
            row = np.repeat(w.row, np.diff(w.starts))
            first = np.flatnonzero(np.diff(row, prepend=-1))
            sizes = np.diff(np.append(first, len(row)))
            of = np.asarray(side)[row[first]]
            for k in (0, 1):
                keep = np.flatnonzero((of == k) & (sizes >= 3))
                if not len(keep):
                    continue
                at = row[first[keep]]
                mine = np.repeat((of == k) & (sizes >= 3), sizes)
                codes = read.code[mine]
                v = np.add.reduceat(read.vectors[k][codes] * read.weights[k][codes, None], np.cumsum(sizes[keep]) - sizes[keep], axis=0)
                s = _signatures(_unit(v))
                rep = pa.array(np.repeat(at, TABLES))
                yield pa.RecordBatch.from_arrays([work.take(rep), side.take(rep), position.take(rep), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(at))), pa.array(s.ravel())], names=["work", "side", "position", "slot", "sign"])

    signed = rows.join(large.select("work"), "work", "left_semi").select("work", "side", "position", "text").mapInArrow(sign, "work bigint, side int, position bigint, slot int, sign bigint")
    one = lambda side: F.sum(F.expr(f"cast(side = {side} as int)")) == 1
    anchors = cut(signed.groupBy("work", "slot", "sign").agg(one(0).alias("a"), one(1).alias("b"), F.max(F.expr("if(side = 0, position, null)")).alias("i"), F.max(F.expr("if(side = 1, position, null)")).alias("j")).where("a and b").select("work", "i", "j").distinct())
    found = anchors.groupBy("work", F.floor(F.col("i") / CELL).alias("cell")).agg(F.expr("percentile_approx(j - i, 0.5)").cast("double").alias("gap"))
    every = large.select("work", "n_en", "n_fr", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_en") / CELL))).alias("cell"))
    back = Window.partitionBy("work").orderBy("cell")
    trend = (
        every.join(found, ["work", "cell"], "left")
        .withColumn("before", F.last("gap", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("after", F.first("gap", True).over(back.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("shift", F.coalesce((F.col("before") + F.col("after")) / 2, "before", "after", (F.col("cell") + 0.5) * CELL * (F.col("n_fr") / F.col("n_en") - 1)).cast("double"))
    )
    low, high = F.col("cell") * CELL + F.col("shift") - REACH, (F.col("cell") + 1) * CELL + F.col("shift") + REACH
    along = cut(trend.select("work", "cell", F.lit(0).alias("part"), "shift", F.lit(1.0).alias("scale"), low.alias("low"), high.alias("high")))
    moved = (
        anchors.withColumn("cell", F.floor(F.col("i") / CELL))
        .join(along.select("work", "cell", F.col("low").alias("l"), F.col("high").alias("h")), ["work", "cell"])
        .where("j < l or j > h")
        .groupBy("work", "cell", F.floor(F.col("j") / CELL).cast("int").alias("block"))
        .agg(F.expr("percentile_approx(j - i, 0.5)").cast("double").alias("shift"), F.count(F.lit(1)).alias("n"))
        .where("n >= 4")
        .select("work", "cell", (F.col("block") + 1).alias("part"), "shift", F.lit(1.0).alias("scale"), low.alias("low"), high.alias("high"))
    )
    return small.unionByName(along).unionByName(moved)


def _by_group(df: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """work over the groups of df, each whole in one task: dealt out by key, sorted, then read batch by batch."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, "side", "position", "id", "clause").mapInArrow(work, schema)


def _left_over(rows: DataFrame, found: DataFrame, shipped) -> DataFrame:
    """(segment_en, segment_fr, score) of clauses of large works that no cell has paired, each compared with all such clauses of
    the other version, in blocks of about LEFT_OVER; a pair stands if no other block has a better one for either clause."""

    def split(batches):
        for batch in batches:
            w = Words.of(batch.column(4).to_pylist())
            rep = pa.array(w.row)
            texts = [" ".join([w.names[c] for c in w.codes[i:j]]) for i, j in zip(w.starts, w.starts[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rep) for k in range(4)), pa.array(w.parts(), pa.int32()), pa.array(texts, pa.string())], names=["work", "side", "id", "position", "clause", "text"])

    columns = "work bigint, side int, id bigint, position bigint, clause int, text string"
    every = rows.select("work", "side", "id", "position", "text").mapInArrow(split, columns)
    held = found.where("side >= 0").select("side", F.col("segment_en").alias("id"), "clause").distinct()
    free = cut(every.join(held, ["side", "id", "clause"], "left_anti").withColumn("cell", F.floor(F.col("position") / CELL)))
    upto = Window.partitionBy("work", "side").orderBy("cell")
    blocks = cut(free.groupBy("work", "side", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor((F.sum("n").over(upto) - F.col("n")) / LEFT_OVER)).drop("n"))
    number = blocks.groupBy("work").agg(F.max(F.expr("if(side = 0, block, null)")).alias("last_en"), F.max(F.expr("if(side = 1, block, null)")).alias("last_fr")).where("last_en is not null and last_fr is not null")
    placed = free.join(blocks, ["work", "side", "cell"]).join(number, "work")
    met = placed.withColumn("other", F.explode(F.expr("sequence(0L, if(side = 0, last_fr, last_en))"))).select("work", F.expr("if(side = 0, block, other)").alias("block_en"), F.expr("if(side = 0, other, block)").alias("block_fr"), "side", "position", "id", "clause", "text")

    def work_out(batches):
        for table, edges in _groups(batches, 3):
            side, position, ids, clause = (np.asarray(table.column(k)) for k in range(3, 7))
            read = Read(shipped.value, table.column(7).to_pylist(), side)
            got = []
            for i, j in zip(edges, edges[1:]):
                m = i + int(np.searchsorted(side[i:j], 1))
                got += [(int(ids[i + x]), int(clause[i + x]), int(ids[m + y]), int(clause[m + y]), float(s)) for x, y, s in match(read, read.side(i, m, 0), read.side(m, j, 1), position[i:m], position[m:j], anywhere=True)]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64()))], names=["segment_en", "clause_en", "segment_fr", "clause_fr", "score"])

    far = cut(_by_group(met, ["work", "block_en", "block_fr"], work_out, "segment_en bigint, clause_en int, segment_fr bigint, clause_fr int, score double"))
    best = lambda side: F.max("score").over(Window.partitionBy(f"segment_{side}", f"clause_{side}"))
    return far.withColumn("a", best("en")).withColumn("b", best("fr")).where("score >= a and score >= b").select("segment_en", "segment_fr", "score")


def stored_texts(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """(en, fr): texts of stored alignments (segment_en_id, segment_fr_id), each pair of ids once, whatever their confidence. Many may be
    wrong: right ones repeat the same terms and wrong ones don't, so they only blur the counts. rows (id, text) is unique in id."""
    of = lambda side: rows.select(F.col("id").alias(f"segment_{side}_id"), F.col("text").alias(side))
    ids = stored.select("segment_en_id", "segment_fr_id").where("segment_en_id is not null and segment_fr_id is not null").distinct()
    return ids.join(of("en"), "segment_en_id").join(of("fr"), "segment_fr_id").select("en", "fr")


def align(books: DataFrame, segments: DataFrame, pairs: DataFrame, left_col: str = "en", right_col: str = "fr", vocabulary: int = VOCABULARY, stored: DataFrame | None = None) -> DataFrame:
    """(segment_en, segment_fr, score): pairs of segments of the same work of which one renders the other, wholly or in part.

    books (id, title), segments (id, book_id, position, text), pairs: rough translations from which the terms' vectors are learned,
    stored: alignments of these segments (segment_en_id, segment_fr_id), from whose texts they are learned as well.
    A segment may be in several pairs, or in none. Segments delivered again count once; those with a null id, book, position
    or text, and books without a counterpart, have no pairs. Empty tables give an empty result; without pairs to learn from only terms
    written alike in both languages tell. Extra columns are not read."""
    spark = segments.sparkSession
    clean = segments.where("id is not null and book_id is not null and position is not null and text is not null").select("id", "book_id", F.col("position").cast("bigint").alias("position"), "text")
    sizes = clean.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    known = cut(works_of(books).join(sizes, "book_id"))
    total = (known.agg(F.sum("n")).first()[0] or 0)
    rows = cut(join_unique(clean, known, ["book_id"], "n", total).select("work", F.col("side").cast("int").alias("side"), "id", "position", "text").dropDuplicates(["id"]))
    rough = pairs.select(F.col(left_col).cast("string").alias("en"), F.col(right_col).cast("string").alias("fr"))
    space = spark.sparkContext.broadcast(learn(rough if stored is None else rough.unionByName(cut(stored_texts(stored, rows))), "en", "fr", vocabulary))
    cells = cut(_cells(rows, space))
    # the English side: a cell and its margin; the French side: the blocks that its stretch touches
    en = rows.where("side = 0").withColumn("block", F.floor(F.col("position") / CELL))
    fr = rows.where("side = 1").withColumn("block", F.floor(F.col("position") / CELL))
    en_blocks = cells.withColumn("block", F.explode(F.expr("if(part = -1, array(0L, 1L, 2L), array(cell - 1, cell, cell + 1))"))).where("block >= 0")
    fr_blocks = cells.withColumn("block", F.explode(F.expr(f"sequence(cast(floor(greatest(low, 0.0) / {CELL}) as bigint), cast(floor(greatest(high, 0.0) / {CELL}) as bigint))")))
    left = en_blocks.join(en, ["work", "block"]).where(f"position >= cell * {CELL} - {HALO} and (position < (cell + 1) * {CELL} + {HALO} or part = -1)")
    right = fr_blocks.join(fr, ["work", "block"]).where("position >= low and position <= high")
    columns = ["work", "cell", "part", "side", "position", "id", F.lit(0).alias("clause"), "shift", "scale", "text"]

    def work_out(batches):
        for table, edges in _groups(batches, 3):
            cell, part, side, at, ids, _, shift, scale = (np.asarray(table.column(k)) for k in range(1, 9))
            read = Read(space.value, table.column(9).to_pylist(), side)
            out = []
            for i, j in zip(edges, edges[1:]):
                m = i + int(np.searchsorted(side[i:j], 1))
                small, first = part[i] == -1, cell[i] * CELL
                used: list | None = None if small else []
                got = match(read, read.side(i, m, 0), read.side(m, j, 1), at[i:m], (at[m:j] - shift[i]) * scale[i], whole=small, used=used)
                core = lambda x: small or first <= at[i + x] < first + CELL  # noqa: E731, B023
                out += [(int(ids[i + x]), int(ids[m + y]), s, -1, -1) for x, y, s in got if core(x)]
                if not small:  # clauses that pairs of the core hold
                    held = {y for x, y, _ in got if core(x)}
                    out += [(int(ids[m + r if k else i + r]), 0, 0.0, k, c) for k, r, c in used if (r in held if k else core(r))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], names=["segment_en", "segment_fr", "score", "side", "clause"])

    schema = "segment_en bigint, segment_fr bigint, score double, side int, clause int"
    found = cut(_by_group(left.select(*columns).unionByName(right.select(*columns)), ["work", "cell", "part"], work_out, schema))
    left_over = _left_over(rows.join(cells.where("part >= 0").select("work").distinct(), "work", "left_semi"), found, space)
    return found.where("side = -1").select("segment_en", "segment_fr", "score").unionByName(left_over).groupBy("segment_en", "segment_fr").agg(F.max("score").alias("score"))
