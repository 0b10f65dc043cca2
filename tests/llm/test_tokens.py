import hashlib
import struct

import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers

from veritrack.llm.bpe import MergeTransducer, PieceCache, StreamDecoder, ascii_pattern, encode_and_decode, read_ranks, streamed, token_digests
from veritrack.llm.token_counts import MARK, PieceCounter, count_tokens, read_vocabulary

RANKS = read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TRANSDUCER = MergeTransducer(RANKS)
VOCABULARY = read_vocabulary(public.path("piece_bpe_32k.model"))
COUNTER = PieceCounter(VOCABULARY)
UNIGRAM = Tokenizer(models.Unigram(VOCABULARY, unk_id=0, byte_fallback=True))
UNIGRAM.normalizer = normalizers.Sequence([normalizers.Prepend(MARK), normalizers.Replace(" ", MARK)])
TEXTS = [None, "", " ", "Hello  world's\n\n end   x", "é漢字😀 1234 ::: don't", "a" * 3000, "the <s> <0x0A> \x1c\x85", "ünïcödé " * 50, "\n \n"]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_transducer_equals_the_library(text):
    import regex

    cache = PieceCache(TRANSDUCER)
    ids = [i for piece in regex.findall(public.PATTERN, text) for i in struct.unpack(f"<{len(cache[piece]) // 4}I", cache[piece])]
    assert ids == REFERENCE.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_transducer_equals_the_definition(piece):
    if piece and piece not in RANKS:
        assert TRANSDUCER.encode(piece) == TRANSDUCER.merge(piece)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, len(RANKS) - 1), max_size=30), st.integers(1, 5))
def test_streamed_text_is_the_whole_text(ids, step):
    decoder = StreamDecoder(TRANSDUCER.tokens)
    parts = "".join(decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)) + decoder.close()
    assert parts == b"".join(TRANSDUCER.tokens[i] for i in ids).decode("utf-8", "replace")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30), st.integers(1, 5))
def test_ids_are_decoded_by_the_state_machine(text, step):
    ids = memoryview(struct.pack(f"<{len(x := REFERENCE.encode_ordinary(text))}I", *x)).cast("I")
    assert streamed(ids, TRANSDUCER.tokens, step) == text.encode()


def test_ascii_pattern():
    import re

    import regex

    for text in TEXTS:
        if text and text.isascii() and "\x1c" not in text:
            assert re.findall(ascii_pattern(public.PATTERN), text) == regex.findall(public.PATTERN, text)


def test_digests(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, token_ids string")
    got = {r.doc_id: r for r in token_digests(encode_and_decode(docs, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)).collect()}
    for i, t in enumerate(TEXTS):
        ids = REFERENCE.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert encode_and_decode(docs.limit(0), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_counts_equal_the_library(text):
    assert sum(COUNTER[s] for s in COUNTER.segments(text)) == len(UNIGRAM.encode(text, add_special_tokens=False).ids)


def test_tie_goes_to_the_longer_last_piece():
    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), (MARK, -1.0)]
    counter = PieceCounter(vocabulary)
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0))
    for text in ("ab", "aba", "abab", "bbaab"):
        assert counter[text] == len(library.encode(text).ids)


def test_count_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, VOCABULARY).collect()}
    assert got == {i: len(UNIGRAM.encode(t, add_special_tokens=False).ids) if t else 0 for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("text", ["word " * 2000, "漢" * 500])
def test_long_texts(text):
    assert sum(COUNTER[s] for s in COUNTER.segments(text)) == len(UNIGRAM.encode(text, add_special_tokens=False).ids)
