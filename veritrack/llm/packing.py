"""Packing by power-of-two decomposition (operator 11).

A document's token ids, closed by an end id, are cut into pieces whose lengths
are powers of two: as many of the greatest length as fit, then one for each set
bit of the rest, longest first. A piece is a sequence by itself, so no sequence
crosses documents and none needs padding. Sequences of one length form a bucket
and are numbered without gaps, bucket after bucket by rising length, so that a
trainer takes batches of equal lengths as ranges of ``sequence_id``.

Ids come from the tokenizer one white-space-free chunk at a time: its normaliser
and its pattern never look across white space, so equal chunks have equal ids
and are encoded once per worker. Chunks of Latin letters and ASCII marks are
split by the same pattern here and their pieces go to the tokenizer's merges.
"""

from __future__ import annotations

import re
import struct
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrack.llm.kernels import slices, utf8
from veritrack.plans.lineage import cut

END_ID, LONGEST = 2, 4096
#: Chunks that a worker remembers in each of two generations, and the bytes of the longest that it does.
MOST_CHUNKS, LONGEST_CHUNK = 200_000, 48
#: Bytes of a long text that are cut into chunks at once.
SPAN = 1 << 20
_GAP = re.compile(rb"[ \t-\r]").search


#: Chunks of these characters, none of which the normaliser composes, are lower-cased and matched here; others go through the library whole.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿĀ-įĲ-ſ]+").fullmatch
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿĀ-ſ]+|[0-9]|[^a-z0-9ß-öø-ÿĀ-ſ]+").findall


def byte_letters() -> dict[int, str]:
    """The letter of each byte in a byte-level vocabulary: printable ones of Latin-1 stand for themselves, the rest follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ChunkEncoder(dict):
    """Chunk of UTF-8 bytes without ASCII white space to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        if sys.byteorder != "little":
            raise RuntimeError("ids are packed as the machine holds them, which has to be little-endian")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.marks: dict[str, list[int]] = {}
        self.before: dict[bytes, bytes] = {}

    def _piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern; those of marks and digits are remembered."""
        if piece.isalpha():
            return [t.id for t in self.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))]
        ids = self.marks.get(piece)
        if ids is None:
            ids = [t.id for t in self.tokenize(piece)]
            if len(piece) <= 4:
                self.marks[piece] = ids
        return ids

    def ids(self, chunk: bytes) -> list[int]:
        text = chunk.decode()
        if "<|" in text or not _PLAIN(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        text = text.lower()
        if text.isalpha():
            return self._piece(text)
        return [i for piece in _PIECES(text) for i in self._piece(piece)]

    def _known(self, word: bytes) -> bytes:
        """The packed ids of a lower-case word of ASCII letters, looked up before they are made."""
        packed = self.get(word) or self.before.get(word)
        return packed or array("I", [t.id for t in self.tokenize(word.decode())]).tobytes()

    def _packed(self, chunk: bytes) -> bytes:
        word = chunk.lower()
        if word.isalpha():  # of bytes: ASCII letters alone
            return self._known(word)
        if word[:-1].isalpha() and 33 <= word[-1] <= 126:
            return self._known(word[:-1]) + array("I", self._piece(chr(word[-1]))).tobytes()
        return array("I", self.ids(chunk)).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        packed = self.before.get(chunk)
        if packed is None:
            packed = self._packed(chunk)
        if len(chunk) <= LONGEST_CHUNK:
            if len(self) >= MOST_CHUNKS:  # what is still used moves over from the generation before
                self.before = dict(self)
                self.clear()
            self[chunk] = packed
        return packed

    def encode(self, text: bytes) -> bytes:
        parts, at = [], 0
        while at < len(text):
            gap = _GAP(text, at + SPAN)
            end = gap.start() if gap else len(text)
            parts += map(self.__getitem__, text[at:end].split())
            at = end
        return b"".join(parts)


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that add up to ``n``, falling, none over ``longest``, itself a power of two."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


_made: dict[str, ChunkEncoder] = {}


def decompose(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, longest: int = LONGEST) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, part, place``: a row for each piece of each row of ``docs(doc_id, text)``.

    ``ids`` packs the piece's ids as little-endian unsigned 32-bit integers.
    ``part`` is the task that made the piece and ``place`` counts the task's
    pieces of that length from 0. A null or empty text is the end id alone, so
    one piece of length 1. Repeated rows and null ids of documents are packed
    like others, other columns are ignored, an empty table gives no rows. The
    file of the tokenizer has to be where the executors find it.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _made:
            _made.clear()
            _made[tokenizer_path] = ChunkEncoder(tokenizer_path)
        encode, part = _made[tokenizer_path].encode, TaskContext.get().partitionId()
        places = dict.fromkeys((1 << k for k in range(longest.bit_length())), 0)
        for batch in slices(batches, 256):
            rows, starts, lengths, ids, totals, numbers = [], [], [], [], [], []
            for i, text in enumerate(utf8(batch.column(1))):
                packed, start = encode(text) + end, 0
                for length in binary_lengths(len(packed) // 4, longest):
                    rows.append(i)
                    starts.append(start)
                    lengths.append(length)
                    ids.append(packed[4 * start : 4 * (start + length)])
                    totals.append(len(packed) // 4)
                    numbers.append(places[length])
                    places[length] += 1
                    start += length
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(long(rows)), long(starts), long(lengths), pa.array(ids, pa.binary()), long(totals), pa.array([part] * len(rows), pa.int32()), long(numbers)], ["doc_id", "start", "length", "ids", "doc_tokens", "part", "place"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, part int, place long"))


def number_sequences(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` in place of ``part`` and ``place``.

    The pieces are written once to the shared folder, which fixes their places;
    tasks are then counted for each length, and a piece's number is what came
    before its task plus its place. No piece is shuffled for it and no length,
    however common, meets in one task. Columns that only the caller needs stay.
    """
    held = cut(pieces)
    counts = held.groupBy("length", "part").agg((F.max("place") + 1).alias("n"))
    lengths = counts.groupBy("length").agg(F.sum("n").alias("all"))
    # one row for each of the few lengths
    first = lengths.select("length", F.coalesce(F.sum("all").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.withColumn("earlier", earlier).join(first, "length").select("length", "part", (F.col("first") + F.col("earlier")).alias("before"))
    rest = [c for c in held.columns if c not in ("part", "place", "sequence_id", "offset")]
    return held.join(before, ["length", "part"]).select(*rest, (F.col("before") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``ids_crc32``, the unsigned checksum, in place of ``ids``."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
