import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from factmill.llm import bpe, pretokens

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Every class of the automaton, and characters of one to four bytes.
ALPHABET = "'''stmdrvleaZ \n\t 　é中1٣½.!_😀​́" + chr(0x13460)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load(FILE))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(FILE), special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=ALPHABET, max_size=20), st.text(max_size=10, alphabet=st.characters(exclude_categories=["Cs"]))), max_size=8))
def test_ids_are_the_librarys(encoder, library, texts):
    assert [x.tolist() for x in encoder.texts(texts)] == [library.encode_ordinary(t) for t in texts]


def test_ids_in_windows(encoder, library, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices(ALPHABET, k=k)) for k in (0, 1, 30, 200, 700, 3000)] + ["a" * 900, " " * 400 + "b", "'" * 77]
    for window in (1, 4, 16, 100, 1 << 20):
        monkeypatch.setattr(bpe, "WINDOW", window)
        assert [x.tolist() for x in encoder.texts(texts)] == [library.encode_ordinary(t) for t in texts]


def test_classes_of_all_code_points_are_the_librarys():
    """Merges of any byte with one letter, digit or full stop show whether the library puts both into one token."""
    ranks = {bytes([i]): i for i in range(256)}
    for c in b"a1.":
        for i in range(256):
            ranks[bytes([i, c])] = len(ranks)
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    p, kinds = pretokens, pretokens.classes()
    joins = {c: {p.SPACE, *k} for c, k in (("a", (p.ONE, p.R_V, p.EL, p.EE, p.LETTER)), ("1", (p.NUMBER,)), (".", (p.OTHER, p.QUOTE)))}
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            size = len(chr(c).encode())
            assert [len(probe.encode_ordinary(chr(c) + x)) == size for x in "a1."] == [kinds[c] in joins[x] for x in "a1."], hex(c)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 17), max_size=300))
def test_scan_is_composition_in_order(xs):
    _, table, values = pretokens.functions()
    assert len(values) == 18
    want, state = [], pretokens.NEW
    for x in xs:
        state = values[x, state]
        want.append(state)
    got = pretokens.scan(np.array(xs, dtype=np.uint8), table)
    assert values[got, pretokens.NEW].tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=150))
def test_both_ways_of_merging_agree(encoder, piece):
    if len(piece) < bpe.LONG:
        assert encoder._merge_long(piece) == encoder.merge(piece)
    assert b"".join(_tokens()[i] for i in encoder._merge_long(piece)) == piece


def _tokens() -> list[bytes]:
    if not hasattr(_tokens, "all"):
        _tokens.all = sorted(r := bpe.load(FILE), key=r.get)
    return _tokens.all


def test_cache_of_two_generations(library):
    small = bpe.Encoder(bpe.load(FILE), cached=3)
    text = "one two three four five one two three " * 5
    assert small.texts([text])[0].tolist() == library.encode_ordinary(text)
    assert len(small.known) <= 3 and len(small.older) <= 3


def test_round_trip_of_odd_rows(docs, corpus, library):
    got = bpe.digests(bpe.decode(bpe.encode(docs, FILE), FILE)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r[0], len(ids := library.encode_ordinary(r[1] or "")), sha(np.array(ids, dtype="<u4").tobytes()), sha((r[1] or "").encode())) for r in corpus]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bytes_that_are_not_utf8_and_foreign_offsets(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text, 'x' AS ids, 'y' AS starts")
    assert bytes(bpe.decode(bpe.encode(docs, FILE), FILE).head().decoded) == "a�b".encode()
    wrong = bpe.encode(spark.sql("SELECT 1L AS doc_id, 'two words' AS text"), FILE).selectExpr("doc_id", "ids", "unhex(repeat('00', octet_length(starts))) AS starts")
    with pytest.raises(Exception, match="offsets"):
        bpe.decode(wrong, FILE).collect()


def test_empty_table(empty):
    assert not bpe.digests(bpe.decode(bpe.encode(empty, FILE), FILE)).collect()


def test_a_long_text_needs_little_memory(encoder):
    import tracemalloc

    text = "some words, and more; " * (20 << 20 >> 4)
    tracemalloc.start()
    ids = encoder.texts([text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) > 1 << 20 and peak < 12 * len(text)
