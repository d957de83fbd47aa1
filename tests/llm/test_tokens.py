"""Encoding, splitting and mixing against the public libraries and by exact round trips."""
import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import encoding, mixing, splitting, vocab

pytestmark = pytest.mark.skipif(not os.path.isdir(vocab.TOKENIZER_DIR), reason="no tokenizers")
TRICKY = ["don't 'sabc ''s  's\n's \n\n'll x  ", "'", "'re", " 's", "é'd   \u3000 a", "'st've'lla", "   ", "\n\n\na", "aaaa" * 3000, "!" * 5000, "1 2  3", "", None, "a'\u0301s", "👨‍👩‍👧 葉 שלום", "<|endoftext|> </s>", "▁x ▁"]


def load(name):
    file, kind = vocab.TOKENIZERS[name]
    with open(os.path.join(vocab.TOKENIZER_DIR, file), "rb") as f:
        return kind(f.read())


@pytest.fixture(scope="module")
def byte_bpe():
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(os.path.join(vocab.TOKENIZER_DIR, "byte_bpe_50k.json"))
    public.encode_special_tokens = True
    return load("byte_bpe_50k"), lambda t: public.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def piece_bpe():
    sentencepiece = pytest.importorskip("sentencepiece")
    public = sentencepiece.SentencePieceProcessor(model_file=os.path.join(vocab.TOKENIZER_DIR, "piece_bpe_32k.model"))
    return load("piece_bpe_32k"), public.encode


def ids(vocabulary, texts):
    e = encoding.encode(pa.array(texts, pa.string()), vocabulary)
    assert not len(e.ends) or e.ends[-1] == len(e.texts.raw)
    return [x.tolist() for x in np.split(e.ids, np.cumsum(e.counts)[:-1])]


@pytest.mark.parametrize("which", ["byte_bpe", "piece_bpe"])
def test_equal_to_the_library(which, request):
    vocabulary, public = request.getfixturevalue(which)
    assert ids(vocabulary, TRICKY) == [public(t or "") for t in TRICKY]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 'sdtrevml\n\t.!1é葉\u00a0\u3000▁"), max_size=30), min_size=1, max_size=5))
def test_random_texts(byte_bpe, piece_bpe, texts):
    for vocabulary, public in (byte_bpe, piece_bpe):
        assert ids(vocabulary, texts) == [public(t) for t in texts]


def test_own_merging_equals_native(byte_bpe):
    vocabulary, _ = byte_bpe
    own = load("byte_bpe_50k")
    own.merge = None
    assert ids(own, TRICKY) == ids(vocabulary, TRICKY)


def test_encode_ids(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", "z"), (None, "a", "q"), (1, "a b", "x")], "doc_id bigint, text string, ids string")
    got = encoding.encode_ids(df)
    assert got.columns == ["doc_id", "ids"]
    assert sorted(((r.doc_id, tuple(r.ids)) for r in got.collect()), key=str) == sorted([(1, (64, 275)), (2, ()), (3, ()), (None, (64,)), (1, (64, 275))], key=str)
    assert sorted(r.text for r in encoding.decode_ids(got).collect()) == ["", "", "a", "a b", "a b"]
    assert encoding.encode_ids(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        encoding.encode_ids(df, "nothing")


LIMITS = "limit_id int, tokenizer string, max_tokens int, overlap_tokens int"


def test_split(spark, byte_bpe, piece_bpe):
    long = "First paragraph here, with words.\n\nSecond one follows; it is longer. It goes on!\nA line. " * 12
    texts = [(1, long), (2, "x" * 400), (3, None), (4, ""), (5, "short"), (6, "👨‍👩‍👧葉" * 60), (7, "a  b   c\n" * 60), (8, "nobreak" + "é" * 300)]
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id bigint, text string, piece_no int")
    limits = spark.createDataFrame([(1, "byte_bpe_50k", 32, 4), (2, "byte_bpe_50k", 16, 0), (3, "piece_bpe_32k", 20, 0), (4, None, 3, 0), (1, "byte_bpe_50k", 32, 4)], LIMITS)
    pieces = {}
    for r in splitting.split_texts(df, limits).collect():
        pieces.setdefault((r.limit_id, r.doc_id), []).append(r)
    text = dict(texts)
    for limit_id, most, overlap, (vocabulary, public) in ((1, 32, 4, byte_bpe), (2, 16, 0, byte_bpe), (3, 20, 0, piece_bpe)):
        for doc_id, t in texts:
            got = sorted(pieces.get((limit_id, doc_id), []), key=lambda r: r.piece_no)
            whole = ids(vocabulary, [t])[0]
            assert bool(got) == (len(whole) > most), (limit_id, doc_id)
            if not got:
                continue
            assert [r.piece_no for r in got] == list(range(len(got))) and got[0].token_start == 0 and got[-1].token_end == len(whole)
            for a, b in zip(got, got[1:]):
                assert 0 <= overlap - (a.token_end - b.token_start) <= 3 and b.n_shared == a.token_end - b.token_start
            assert all(0 < r.n_tokens <= most and r.n_tokens == r.token_end - r.token_start for r in got)
            if not overlap:
                assert "".join(r.piece for r in got) == t
            assert all(r.piece in t and len(public(r.piece)) <= most for r in got), (limit_id, doc_id)
    assert {r.boundary for r in pieces[1, 1]} <= {"P", "L", "S"}
    assert all(doc in text for _, doc in pieces)
    with pytest.raises(ValueError):
        splitting.split_texts(df, spark.createDataFrame([(1, "byte_bpe_50k", 4, 4)], LIMITS))
    assert splitting.split_texts(df, limits.limit(0)).count() == 0
    assert splitting.split_texts(df.limit(0), limits).count() == 0


def test_mix(spark):
    docs = [(i, "word " * (1 + i % 7), ["big", "big", "big", "mid", "small"][i % 5] if i % 50 else None) for i in range(2000)] + [(9000, "", "big"), (9001, None, "mid")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, n_tokens int")
    targets = spark.createDataFrame([(1, "big", 0.5, 1), (1, "mid", 0.3, 2), (1, "small", 0.4, 3), (1, "none", 0.2, 9), (2, "small", 1.0, None), (2, "big", None, 2), (1, "big", 0.5, 1), (None, "big", 1.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    taken, report = mixing.mix_sources(df, targets)
    rows = report.collect()
    assert {(r.mix_id, r.source) for r in rows} == {(1, "big"), (1, "mid"), (1, "small"), (1, "none"), (2, "small"), (2, "big")}
    for r in rows:
        assert abs(r.actual_share - r.share) < 0.01 and r.taken_tokens <= r.available_tokens * r.max_repeats
    assert [r.taken_tokens for r in rows if r.source == "none"] == [0]
    caps = {(1, "big"): 1, (1, "mid"): 2, (1, "small"): 3, (2, "small"): 1}
    got = taken.collect()
    assert len({(r.mix_id, r.doc_id) for r in got}) == len(got) and all(1 <= r.copies <= caps[r.mix_id, r.source] for r in got)
    assert all(r.doc_id < 9000 for r in got)
    sums = {}
    for r in got:
        sums[r.mix_id, r.source] = sums.get((r.mix_id, r.source), 0) + r.copies * r.n_tokens
    assert all(sums.get((r.mix_id, r.source), 0) == r.taken_tokens for r in rows)
    fixed = {(r.mix_id, r.source): r for r in mixing.mix_sources(df, targets.where("mix_id = 1"), total_tokens=1000)[1].collect()}
    assert sum(r.taken_tokens for r in fixed.values()) == pytest.approx(1000, abs=8)
    assert mixing.mix_sources(df.limit(0), targets)[0].count() == 0


def test_scan_is_the_automaton_run_sign_by_sign():
    rng = np.random.default_rng(2)
    goes, begins = encoding.automaton()
    for n in (1, 3, 7, 100, 5000, 70_001):
        kinds = rng.choice(16, n).astype(np.uint8)
        want, state = [], encoding.FRESH
        for k in kinds:
            want.append(state)
            state = goes[k, state]
        assert encoding.states(kinds).tolist() == want
        assert encoding.scan(kinds.astype(np.int64), goes).tolist() == want


def test_running_sums_of_any_length(spark):
    sizes = [[], [3], list(range(1, 257)), list(range(1, 258)), [1] * 5000]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(sizes)], "i int, sizes array<int>").select("i", splitting._running(F.col("sizes")).alias("sums")).orderBy("i").collect()
    assert [r.sums for r in got] == [np.concatenate([[0], np.cumsum(x)]).astype(int).tolist() for x in sizes]
