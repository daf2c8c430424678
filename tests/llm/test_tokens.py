"""Ids, files and packing against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from buildlens.llm import binary, bpe, packing, tokens
from buildlens.llm.queries import QUERIES
from buildlens.session import scratch
from tests.llm.conftest import ODD

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(JSON)
TIKTOKEN = tiktoken.Encoding(
    "own", pat_str=P.PATTERN, special_tokens={},
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))})


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def many(encoder, texts):
    ids, ends = encoder.many(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, ends[:-1])]


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.read_ranks(RANKS)
    return bpe.codec(bpe.serialise_model(ranks), ranks, P.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1 .,'s\n\té中 \x1c𝒳<|"), max_size=25), min_size=1, max_size=6))
def test_words_encode_as_whole_texts(texts):
    own = tokens.library_encoder(tokens.vocabulary_text(JSON))
    assert many(own, texts) == [library_ids(t) for t in texts]


def test_added_tokens_stand_wherever_they_are():
    own = tokens.library_encoder(tokens.vocabulary_text(JSON))
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "é", "ing", "1", ".", "<|endoftext|>", "<|endoftext|", "<|", "|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1000)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> ", " <|endoftext|>x"]
    assert many(own, texts) == [library_ids(t) for t in texts]
    assert 50256 in many(own, ["a <|endoftext|> b"])[0]


def test_sentencepiece_model_encodes_as_the_ranks(codec):
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "ing", "1", ".", "'s", "中", "𝒳", "<|endoftext|>", "\x1c"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(2000)] + [None]
    found = many(codec.words, texts)
    assert found == [TIKTOKEN.encode_ordinary(t or "") for t in texts]
    assert all(codec.decode(np.array(i, "<u4").tobytes()) == (t or "").encode() for i, t in zip(found, texts))
    assert codec.whole == {}


def test_whole_token_that_merging_does_not_reach():
    # "abc" has no pair of tokens that makes it, but as a whole match it is a token.
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b" ": 4}
    own = bpe.Codec(bpe.serialise_model(ranks), ranks, P.PATTERN)
    assert many(own.words, ["abc", "abca", "abc abc"]) == [[3], [0, 1, 2, 0], [3, 4, 0, 1, 2]]


def test_a_small_memory_gives_the_same_ids():
    own = tokens.library_encoder(tokens.vocabulary_text(JSON))
    small = tokens.WordEncoder(own.split, own.encode, limit=8, added={"<|endoftext|>": 50256})
    texts = [t for _, t in ODD if t is None or len(t) < 1000]
    for _ in range(3):
        assert many(small, texts) == [library_ids(t) for t in texts]


def test_byte_bpe_of_odd_rows(odd, empty):
    ranks = bpe.read_ranks(RANKS)
    got = sorted(map(tuple, bpe.encode_documents(odd, ranks, P.PATTERN).collect()), key=str)
    want = []
    for i, t in ODD:
        ids = np.array(TIKTOKEN.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(empty, ranks, P.PATTERN).count() == 0


def test_byte_bpe_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op10_byte_bpe"](spark, folder).collect()}
    for d in docs:
        ids = np.array(TIKTOKEN.encode_ordinary(d.text), "<u4")
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(
    st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), min_size=1, max_size=90),
    min_size=1, max_size=5))
def test_simple8b_round_trip(docs):
    lengths = np.array([len(d) for d in docs])
    ids = np.array([i for d in docs for i in d], np.uint64)
    words, at, escaped = binary.encode(ids, lengths)
    assert (binary.decode(words, at, lengths, escaped) == ids).all()
    assert len(escaped) == sum(i >= 1 << 60 for i in ids.tolist())
    # Any document can be read by itself.
    stops = np.append(at[1:], len(words))
    for d, a, b in zip(docs, at, stops):
        alone = binary.decode(words[a:b], np.array([0]), np.array([len(d)]), escaped)
        assert alone.tolist() == d


def test_simple8b_words_are_full():
    words, _, _ = binary.encode(np.ones(600, np.uint64), np.array([600]))
    assert len(words) == 10
    words, _, _ = binary.encode(np.full(9, 50_000, np.uint64), np.array([9]))
    assert len(words) == 3


def token_rows(docs):
    start, want = 0, []
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    for i, t in order:
        ids = np.array([*library_ids(t), 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return want


def test_token_file_query(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op6_simple8b"](spark, folder).collect())) == token_rows(docs)


def test_token_file_of_odd_rows(spark, odd, empty):
    path = scratch(spark, "tokens")
    binary.write_tokens(odd, path, tokens.vocabulary_text(JSON))
    starts = {r.shard: r.before for r in binary.read_starts(spark, path).collect()}
    got = binary.read_tokens(spark, path).collect()
    want = token_rows(ODD)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == \
        sorted(((i, n, c) for i, _, n, c in want), key=key)
    at = sorted((starts[r.shard] + r.at, r.n_tokens) for r in got)
    assert [a for a, _ in at] == np.cumsum([0, *(n for _, n in at)])[:-1].tolist()
    path = scratch(spark, "tokens")
    binary.write_tokens(empty, path, tokens.vocabulary_text(JSON))
    assert binary.read_tokens(spark, path).count() == 0


def check_packing(pieces, docs, capacity):
    by_doc, sequences = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for i, t in docs:
        ids = np.array([*library_ids(t), 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert all(r.length == capacity for r in own[1:]) and sum(r.length for r in own) == len(ids)
        assert [r.ids_crc32 for r in own] == [
            zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in own]
    return len(sequences)


def test_packing_query(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    pieces = QUERIES["op8_certified_packing"](spark, folder).collect()
    used = check_packing(pieces, docs, packing.CAPACITY)
    assert used <= packing.lower_bound(np.array([r.length for r in pieces])) + 1


def test_packing_exchanges_between_partitions(spark):
    rng = np.random.default_rng(1)
    lengths = rng.choice([700, 650, 690, 400, 1500, 3], 3000).tolist()
    rows = [(i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    pieces = packing.store(spark.createDataFrame(rows, packing.PIECES_DDL), "pieces")
    few = packing.pack_pieces(pieces, partition_pieces=200).collect()
    assert sorted(r.doc_id for r in few) == list(range(3000))
    one = packing.pack_pieces(pieces).select("sequence_id").distinct().count()
    bound = packing.lower_bound(np.array(lengths))
    assert bound <= one and len({r.sequence_id for r in few}) <= one + 15
    by = {}
    for r in few:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 2048 for v in by.values())


def test_packing_of_odd_rows(odd, empty):
    vocabulary = tokens.vocabulary_text(JSON)
    got = packing.pack_documents(odd, vocabulary).collect()
    assert sum(r.length for r in got) == sum(len(library_ids(t)) + 1 for _, t in ODD)
    assert packing.pack_documents(empty, vocabulary).count() == 0


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(4)
    for capacity in (10, 64, 2048):
        for _ in range(40):
            lengths = rng.integers(1, capacity + 1, rng.integers(1, 60))
            bins = packing.best_fit_decreasing(lengths, capacity)
            assert np.bincount(bins, weights=lengths).max() <= capacity
            assert packing.lower_bound(lengths, capacity) <= bins.max() + 1
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([4, 4, 4, 4, 4]), 10) == 3
