import struct
import zlib

import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veritrack.llm import packing
from veritrack.llm.packing import ChunkEncoder, binary_lengths, decompose, number_sequences, piece_digests

PATH = public.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = ChunkEncoder(PATH)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 ́ΣσçİßéA's'LL")), max_size=60))
def test_chunks_encode_as_the_whole_text(text):
    assert ENCODER.encode(text.encode()) == struct.pack(f"<{len(x := ids_of(text))}I", *x)


@settings(max_examples=600, deadline=None)
@given(st.text(st.one_of(st.characters(min_codepoint=33, max_codepoint=0x180), st.sampled_from("'sStTmMdDlLvVrReE019.,<|>"), st.characters(min_codepoint=0xC0, max_codepoint=0x17F)), min_size=1, max_size=14))
def test_plain_chunks_encode_as_the_library_does(chunk):
    for text in (chunk, chunk.upper(), chunk.title()):
        if text.split() == [text]:
            assert ENCODER.ids(text.encode()) == ids_of(text)


def test_every_plain_character():
    for c in map(chr, range(33, 0x180)):
        for text in (c, f"a{c}", f"{c}{c}'s", f"1{c}a"):
            assert ENCODER.encode(text.encode()) == struct.pack(f"<{len(x := ids_of(text))}I", *x)


def test_generations_of_chunks(monkeypatch):
    monkeypatch.setattr(packing, "MOST_CHUNKS", 3)
    encoder = ChunkEncoder(PATH)
    text = "one two three four one five six seven one eight two nine"
    assert encoder.encode(text.encode()) == struct.pack(f"<{len(x := ids_of(text))}I", *x)
    assert len(encoder) <= 3 and len(encoder.before) <= 3


def test_spans_cut_between_chunks(monkeypatch):
    text = "Some words, <|endoftext|> don't\tstop\n\n here " * 40
    monkeypatch.setattr(packing, "SPAN", 7)
    assert ENCODER.encode(text.encode()) == struct.pack(f"<{len(x := ids_of(text))}I", *x)


@given(st.integers(0, 40_000), st.integers(0, 13))
def test_lengths_are_falling_powers_that_add_up(n, k):
    lengths = binary_lengths(n, 1 << k)
    assert sum(lengths) == n and lengths == sorted(lengths, reverse=True)
    assert all(x & (x - 1) == 0 and x <= 1 << k for x in lengths)
    assert len({x for x in lengths if x < 1 << k}) == sum(x < 1 << k for x in lengths)


TEXTS = [(1, None), (2, ""), (3, " \n "), (4, "one word more"), (4, "one word more"), (None, "no id at all"), (7, "long text of words " * 3000), (8, "x" * 5000), (9, "Ünï 漢字 😀 don't")]


@pytest.mark.parametrize("longest", [4096, 8])
def test_pieces_hold_every_id_once(spark, longest):
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in TEXTS], "doc_id long, text string, length int, sequence_id int").repartition(3)
    got = number_sequences(decompose(docs, PATH, longest=longest)).collect()
    want = sorted(((-1 if i is None else i), tuple([*ids_of(t or ""), 2])) for i, t in TEXTS)
    whole, rows = [], sorted(got, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.start))
    for r in (r for r in rows if r.start == 0):
        same = [x for x in rows if x.doc_id == r.doc_id]
        whole.append((-1 if r.doc_id is None else r.doc_id, tuple(y for x in same[:: len([s for s in same if s.start == 0])] for y in struct.unpack(f"<{x.length}I", x.ids))))
    assert sorted(whole) == want
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and {r.offset for r in got} == {0}
    assert [r.length for r in sorted(got, key=lambda r: r.sequence_id)] == sorted(r.length for r in got)
    assert all(r.length & (r.length - 1) == 0 and r.length <= longest and len(r.ids) == 4 * r.length for r in got)


def test_digests_and_empty_tables(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    one = piece_digests(decompose(docs.where("doc_id = 9"), PATH)).orderBy("start").collect()
    ids, at = [*ids_of(TEXTS[-1][1]), 2], 0
    for r in one:
        assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
        at += r.length
    assert at == len(ids)
    assert number_sequences(piece_digests(decompose(docs.limit(0), PATH))).count() == 0
    with pytest.raises(ValueError):
        decompose(docs, PATH, longest=12)


def test_registered_query_equals_the_library(spark):
    import pyarrow.parquet as pq

    from veritrack.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    rows = QUERIES["op11_binary_packing"](spark, d).collect()
    docs = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert len(pieces) == len(docs)
    for x in docs:
        ids, at = [*ids_of(x["text"] or ""), 2], 0
        for r in sorted(pieces[x["doc_id"]], key=lambda r: r.start):
            assert (r.start, r.offset, r.doc_tokens) == (at, 0, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
