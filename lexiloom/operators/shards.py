"""Stored postings, and the scoring of tables of queries against them, in Arrow batches.

The pairs of a language are dealt out by id over shards of SHARD pairs. A shard meets every query, so work grows with pairs
times queries; each meeting is two counted sums over the shard's postings, and hands on no more pairs than the query's limit."""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

K1, B = 1.2, 0.75
SHARD_BITS = 16
#: Pairs of a shard, queries that meet it at once, and postings that are coded at once.
SHARD, BLOCK, FLUSH = 1 << SHARD_BITS, 20_000, 400_000

RAW = "piece string, lang string, shard bigint, pairs binary, places binary, counts binary, ats binary, codes binary, words array<string>"
PIECE = "lang string, shard bigint, pairs binary, places binary, counts binary, ats binary, codes binary, terms array<string>, dfs array<int>, tokens bigint"
POSTED = "lang string, pair_id bigint, term string, position int"
#: Kinds of what is asked of a shard: a query term's expansion (a, b, x weight), a query's term (a, n position), a query (n
#: distinct terms, m limit, x phrase weight, y mean length), and a pair whose whole field is near (n pair, m position, x score).
EXPANSION, TERM, QUERY, FIELD = range(4)


def _packed(a: np.ndarray) -> bytes:
    return zlib.compress(a.astype(np.int32).tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), np.int32)


def _pieces(t: pa.Table) -> Iterator[dict]:
    """Pieces of whole pairs (lang, pair_id, place, word, position), each pair's rows side by side."""
    lang, word = (t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "word"))
    lang, word = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (lang, word))
    langs, codes, pair = lang.indices.to_numpy(zero_copy_only=False), word.indices.to_numpy(zero_copy_only=False), t.column("pair_id").to_numpy()
    place, at = t.column("place").to_numpy(), t.column("position").to_numpy()
    first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (langs[1:] != langs[:-1])])
    counts = np.diff(np.r_[first, len(pair)])
    shard = pair[first] >> SHARD_BITS
    for key in np.unique(np.stack([langs[first].astype(np.int64), shard]), axis=1).T:
        own = (langs[first] == key[0]) & (shard == key[1])
        rows = np.repeat(own, counts)
        known, code = np.unique(codes[rows], return_inverse=True)
        yield {
            "piece": uuid.uuid4().hex, "lang": lang.dictionary[int(key[0])].as_py(), "shard": int(key[1]), "pairs": pair[first][own].astype(np.int64).tobytes(), "places": place[first][own].astype(np.int64).tobytes(), "counts": _packed(counts[own]),
            "ats": _packed(at[rows]), "codes": _packed(code), "words": word.dictionary.take(pa.array(known)).to_pylist(),
        }


_BINARY = ("pairs", "places", "counts", "ats", "codes")
_RAW_TYPE = pa.schema([("piece", pa.string()), ("lang", pa.string()), ("shard", pa.int64()), *((c, pa.binary()) for c in _BINARY), ("words", pa.list_(pa.string()))])
_PIECE_TYPE = pa.schema([("lang", pa.string()), ("shard", pa.int64()), *((c, pa.binary()) for c in _BINARY), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int32())), ("tokens", pa.int64())])


def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (RAW) of words (lang, pair_id, place, word, position) in which each pair's rows stand side by side."""

    def flushed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(t):
            yield pa.RecordBatch.from_pylist([piece], _RAW_TYPE)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= FLUSH:
            t = pa.Table.from_batches(held)
            pair, lang = t.column("pair_id").to_numpy(), t.column("lang")
            last = np.flatnonzero(pair != pair[-1])
            end = int(last[-1]) + 1 if len(last) else 0  # the last pair may go on in the next batch, in its other language too
            if end:
                yield from flushed(t.slice(0, end))
                held = t.slice(end).to_batches()
    if held:
        yield from flushed(pa.Table.from_batches(held))


def stemmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (PIECE) of raw pieces whose words' terms, in the words' order, are in column stems."""
    for batch in batches:
        for piece in batch.to_pylist():
            terms = sorted(set(piece["stems"]))
            to = {x: i for i, x in enumerate(terms)}
            code, counts = np.array([to[x] for x in piece["stems"]], np.int64)[_unpacked(piece["codes"])], _unpacked(piece["counts"])
            n = len(counts)
            held = np.unique(code * n + np.repeat(np.arange(n), counts)) // n
            made = {c: piece[c] for c in ("lang", "shard", *_BINARY)} | {"codes": _packed(code), "terms": terms, "dfs": np.bincount(held, minlength=len(terms)).tolist(), "tokens": len(code)}
            yield pa.RecordBatch.from_pylist([made], _PIECE_TYPE)


def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings (POSTED) of pieces."""
    for batch in batches:
        for piece in batch.to_pylist():
            counts, ats, codes = (_unpacked(piece[c]) for c in ("counts", "ats", "codes"))
            pair = np.repeat(np.frombuffer(piece["pairs"], np.int64), counts)
            lang = pa.array([piece["lang"]], pa.string()).take(pa.array(np.zeros(len(ats), np.int32)))
            yield pa.RecordBatch.from_arrays([lang, pa.array(pair), pa.array(piece["terms"], pa.string()).take(pa.array(codes)), pa.array(ats)], ["lang", "pair_id", "term", "position"])


class Shard:
    """Postings of one shard, ready for scoring."""

    def __init__(self, pieces: list[dict]):
        self.code: dict[str, int] = {}
        codes, counts, ats, pairs, places = [], [], [], [], []
        for p in pieces:
            to = np.array([self.code.setdefault(x, len(self.code)) for x in p["terms"]], np.int64)
            codes.append(to[_unpacked(p["codes"])])
            counts.append(_unpacked(p["counts"]))
            ats.append(_unpacked(p["ats"]))
            pairs.append(np.frombuffer(p["pairs"], np.int64))
            places.append(np.frombuffer(p["places"], np.int64))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        code, self.pairs, self.places = join(codes), join(pairs), join(places)
        self.n, self.dl = len(self.pairs), join(counts)
        doc, at = np.repeat(np.arange(self.n), self.dl), join(ats).astype(np.int64)
        order = np.argsort(code, kind="stable")
        self.token_doc, self.token_at = doc[order], at[order]
        self.token_ends = np.searchsorted(code[order], np.arange(len(self.code) + 1))
        key, tf = np.unique(code * max(self.n, 1) + doc, return_counts=True)
        self.doc, self.tf = key % max(self.n, 1), tf
        self.ends = np.searchsorted(key // max(self.n, 1), np.arange(len(self.code) + 1))
        self.by_pair = np.argsort(self.pairs, kind="stable")
        self.best = np.zeros(self.n)

    def saturated(self, freq: np.ndarray, docs: np.ndarray, avg_dl: float) -> np.ndarray:
        return freq * (K1 + 1) / (freq + K1 * (1 - B + B * self.dl[docs] / avg_dl))

    def term(self, expansions: list[tuple[str, float]], avg_dl: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that hold a query term, and the score of its best expansion in each."""
        found = []
        for term, weight in expansions:
            if (c := self.code.get(term)) is not None:
                own = slice(self.ends[c], self.ends[c + 1])
                found.append((self.doc[own], weight * self.saturated(self.tf[own], self.doc[own], avg_dl)))
        if len(found) < 2:
            return found[0] if found else (np.zeros(0, np.int64), np.zeros(0))
        for docs, score in found:
            self.best[docs] = np.maximum(self.best[docs], score)
        docs = np.unique(np.concatenate([d for d, _ in found]))
        score = self.best[docs]
        self.best[docs] = 0
        return docs, score

    def phrase(self, slots: list[tuple[str, int]], docs: np.ndarray) -> np.ndarray:
        """How often each of the pairs at these places has the terms in order, one step of displacement in all allowed."""
        freq = np.zeros(self.n)
        inside = np.zeros(self.n, bool)
        inside[docs] = True
        exact, loose = [], []
        for term, at in slots:
            c = self.code.get(term)
            if c is None:
                return freq[docs]
            own = slice(self.token_ends[c], self.token_ends[c + 1])
            kept = inside[self.token_doc[own]]
            start = (self.token_doc[own][kept] << 32) + (1 << 31) + self.token_at[own][kept] - at
            exact.append(np.unique(start))
            loose.append(np.unique(np.concatenate([start, start - 1])))
        starts, n = np.unique(np.concatenate(loose), return_counts=True)
        exact_at, m = np.unique(np.concatenate(exact), return_counts=True)
        whole = starts[n == len(slots)]
        i = np.minimum(np.searchsorted(exact_at, whole), max(len(exact_at) - 1, 0))
        if len(exact_at):
            hit = exact_at[i] == whole
            np.add.at(freq, whole[hit] >> 32, np.where(m[i[hit]] == len(slots), 1.0, 0.5))
        return freq[docs]

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """Places of pairs, -1 where a pair has no terms."""
        if not self.n:
            return np.full(len(pairs), -1)
        i = np.minimum(np.searchsorted(self.pairs, pairs, sorter=self.by_pair), self.n - 1)
        at = self.by_pair[i]
        return np.where(self.pairs[at] == pairs, at, -1)


def first(score: np.ndarray, place: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Which are the best by score to six decimals and then by place, and these scores."""
    near = np.arange(len(score))
    if len(score) > limit:
        near = np.flatnonzero(score >= np.partition(score, len(score) - limit)[len(score) - limit] - 2e-6)
    values, back = np.unique(score[near], return_inverse=True)
    exact = np.array([float("%.6f" % v) for v in values])[back]
    order = np.lexsort((place[near], -exact))[:limit]
    return near[order], exact[order]


_RANKED_NAMES = ("lang", "pair_id", "position", "score")


def scorer(phrase_boost: float, text_boost: float, should_match: float):
    """The function that scores what is asked (kind, query_id, a, b, n, m, x, y) in a shard: (query_id, lang, pair_id, position,
    score), for each query its limit at most."""

    def score(key: tuple, pieces: pa.Table, asked: pa.Table) -> pa.Table:
        lang = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
        shard = Shard(pieces.select(["pairs", "places", "counts", "ats", "codes", "terms"]).to_pylist())
        kind = asked.column("kind").to_numpy()
        part = lambda k, *names: zip(*(asked.filter(pa.array(kind == k)).column(c).to_pylist() for c in names))
        near: dict[str, list] = {}
        for a, b, x in part(EXPANSION, "a", "b", "x"):
            near.setdefault(a, []).append((b, x))
        slots: dict = {}
        for q, a, n in part(TERM, "query_id", "a", "n"):
            slots.setdefault(q, set()).add((a, n))
        fields: dict = {}
        for q, n, m, x in part(FIELD, "query_id", "n", "m", "x"):
            fields.setdefault(q, []).append((n, m, x))
        done: dict[str, tuple] = {}
        ids, out = [], []
        for q, n_terms, limit, weight, avg_dl in part(QUERY, "query_id", "n", "m", "x", "y"):
            parts = []
            for term in sorted({a for a, _ in slots.get(q, ())}):
                if term not in done:
                    done[term] = shard.term(sorted(near.get(term, ())), avg_dl)
                if len(done[term][0]):
                    parts.append(done[term])
            total, cand = np.zeros(0), np.zeros(0, np.int64)
            if parts and len(parts) >= max(1, int(np.floor(should_match * n_terms))):
                docs = np.concatenate([d for d, _ in parts])
                matched = np.bincount(docs, minlength=shard.n)
                cand = np.flatnonzero(matched >= max(1, int(np.floor(should_match * n_terms))))
                total = text_boost * np.bincount(docs, np.concatenate([s for _, s in parts]), shard.n)[cand]
            pair, place = shard.pairs[cand], shard.places[cand]
            if q in fields:
                p, at, x = (np.array(v) for v in zip(*fields[q]))
                i = shard.find(p)
                where = np.full(shard.n + 1, -1)
                where[cand] = np.arange(len(cand))
                known = np.where(i >= 0, where[i], -1)
                np.maximum.at(total, known[known >= 0], x[known >= 0])
                new = known < 0
                cand, total, pair, place = np.concatenate([cand, i[new]]), np.concatenate([total, x[new]]), np.concatenate([pair, p[new]]), np.concatenate([place, at[new]])
            if parts and len(parts) == n_terms and len(cand):
                full = np.flatnonzero((cand >= 0) & (matched[cand] == n_terms))
                if len(full):
                    freq = shard.phrase(sorted(slots[q]), cand[full])
                    total[full] += np.where(freq > 0, phrase_boost * weight * shard.saturated(freq, cand[full], avg_dl), 0.0)
            if len(cand) and limit > 0:
                best, exact = first(total, place, limit)
                ids.extend([q] * len(best))
                out.append((pair[best], place[best], exact))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(ids, asked.schema.field("query_id").type), pa.array([lang] * len(ids), pa.string()), *map(pa.array, columns)], names=["query_id", *_RANKED_NAMES])

    return score
