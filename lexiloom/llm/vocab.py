"""Public tokenizer vocabularies and exact pair merging over one pre-token.

The vocabulary file is read once on the driver and shipped as a broadcast of its bytes (at most 2 MB, a fixed file, so
the size does not follow the data); executors need no access to the tokenizer folder.
"""
from __future__ import annotations

import base64
import heapq
import os
from itertools import chain

import numpy as np

TOKENIZER_DIR = "/opt/tokenizers"
#: Entries kept in a worker's cache of encoded pre-tokens; beyond it the cache starts anew. It only affects speed.
CACHE_ENTRIES = 300_000
#: Pre-tokens below this many bytes are merged natively where tiktoken is installed; longer ones by the heap below.
NATIVE_BYTES = 256


def merge_parts(parts: list, rank) -> list:
    """Merge adjacent parts, best rank first and leftmost among equals, until no pair has a rank.

    Short inputs rescan the pair list; long ones (a run of one sign may be megabytes) use a heap over a linked list, so
    the cost is n log n."""
    if len(parts) < 2:
        return parts
    if len(parts) <= 40:
        ranks = [rank(a, b) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == np.inf:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1], parts[i])
            if i < len(ranks):
                ranks[i] = rank(parts[i], parts[i + 1])
        return parts
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, len(parts[i]) + len(parts[i + 1])) for i in range(n - 1) if (r := rank(parts[i], parts[i + 1])) != np.inf]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n:
                right = after[left]
                if (r := rank(parts[left], parts[right])) != np.inf:
                    heapq.heappush(heap, (r, left, len(parts[left]) + len(parts[right])))
    return [p for p in parts if p is not None]


class Vocabulary:
    """Encodes one pre-token (bytes) into ids and the number of text bytes behind each id."""

    #: A blank that the tokenizer puts in front of every text that isn't empty.
    prefix = False

    def __init__(self):
        self.cache: dict[bytes, tuple[list[int], list[int]]] = {}

    def encode(self, piece: bytes) -> tuple[list[int], list[int]]:
        raise NotImplementedError

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte lengths of all pieces end to end, and how many ids each piece has."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        cache, found = self.cache, []
        for p in pieces:
            hit = cache.get(p)
            if hit is None:
                hit = self.encode(p)
                if len(p) <= 64:
                    cache[p] = hit
            found.append(hit)
        counts = np.fromiter((len(x[0]) for x in found), np.int64, len(found))
        total = int(counts.sum())
        return (
            np.fromiter(chain.from_iterable(x[0] for x in found), np.int32, total),
            np.fromiter(chain.from_iterable(x[1] for x in found), np.int32, total),
            counts,
        )


class ByteBpe(Vocabulary):
    """Byte-level BPE from a rank file of lines `base64 rank`."""

    def __init__(self, raw: bytes):
        super().__init__()
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.tokens = {v: k for k, v in self.ids.items()}
        try:
            import tiktoken

            self.merge = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=self.ids, special_tokens={})._encode_single_piece
        except ImportError:
            self.merge = None

    def encode(self, piece):
        ids = self.ids
        if self.merge and len(piece) < NATIVE_BYTES:
            found = self.merge(piece)
            return found, [len(self.tokens[i]) for i in found]
        parts = merge_parts([piece[i : i + 1] for i in range(len(piece))], lambda a, b: ids.get(a + b, np.inf))
        return [ids[p] for p in parts], [len(p) for p in parts]

    def decode(self, ids) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


class PieceBpe(Vocabulary):
    """BPE over characters with byte fallback from a sentencepiece model; blanks are U+2581 inside."""

    prefix = True

    def __init__(self, raw: bytes):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.ids, self.rank, self.byte = {}, {}, {}
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(text[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[text] = i
                self.rank[text] = -model.get_score(i)
        self.pieces = {v: k for k, v in self.ids.items()}
        self.bytes_of = {v: k for k, v in self.byte.items()}
        #: [x, y] true: no piece has y right behind x, so no merge joins them. 0 stands for the blank, 1023 for all signs
        #: from there on, which are kept together with any neighbour that some such sign follows or precedes.
        self.apart = np.ones((1024, 1024), bool)
        low = lambda c: 0 if c == "▁" else min(ord(c), 1023)
        for text in self.ids:
            for a, b in zip(text, text[1:]):
                self.apart[low(a), low(b)] = False

    def encode(self, piece):
        rank = self.rank
        chars = piece.decode("utf-8")
        parts = merge_parts(list(chars.replace(" ", "▁")), lambda a, b: rank.get(a + b, np.inf))
        ids, sizes, at = [], [], 0
        for p in parts:
            raw = chars[at : at + len(p)].encode("utf-8")
            at += len(p)
            if p in self.ids:
                ids.append(self.ids[p])
                sizes.append(len(raw))
            else:
                ids.extend(self.byte[b] for b in raw)
                sizes.extend([1] * len(raw))
        return ids, sizes

    def decode(self, ids) -> str:
        raw = b"".join(bytes([self.bytes_of[i]]) if i in self.bytes_of else self.pieces[i].encode("utf-8") for i in ids)
        text = raw.decode("utf-8", "replace").replace("▁", " ")
        return text[1:] if text.startswith(" ") else text


#: Tokenizers by name: file and class.
TOKENIZERS = {
    "byte_bpe_50k": ("byte_bpe_50k.tiktoken", ByteBpe),
    "byte_bpe_multi_50k": ("byte_bpe_multi_50k.tiktoken", ByteBpe),
    "piece_bpe_32k": ("piece_bpe_32k.model", PieceBpe),
}

_loaded: dict[str, Vocabulary] = {}


class Shipped:
    """A vocabulary to be used on executors: its file's bytes in a broadcast, parsed once per Python worker."""

    def __init__(self, spark, name: str, tokenizer_dir: str = TOKENIZER_DIR):
        if name not in TOKENIZERS:
            raise ValueError(f"unknown tokenizer {name!r}; known: {', '.join(TOKENIZERS)}")
        self.name = name
        with open(os.path.join(tokenizer_dir, TOKENIZERS[name][0]), "rb") as f:
            self.raw = spark.sparkContext.broadcast(f.read())

    def get(self) -> Vocabulary:
        if self.name not in _loaded:
            _loaded[self.name] = TOKENIZERS[self.name][1](self.raw.value)
        return _loaded[self.name]
