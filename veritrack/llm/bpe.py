"""Byte-level BPE as a lazily determinised transducer (operator 5).

A sequence of tokens is the encoding of its bytes exactly if each token encodes
to itself and each adjacent pair does. So the encoder can be read as a
nondeterministic transducer whose configuration is (last whole token, tokens
not yet emitted, trie node of the token being spelled). Sets of configurations
become deterministic states on first use; what all configurations of a set
agree on is emitted at once, so output lags the input by the lookahead that
the vocabulary needs and no more.
"""

from __future__ import annotations

import base64
import gc
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrack.llm.kernels import slices

#: Most determinised moves and most pieces that a Python worker keeps unless told otherwise; beyond it starts anew, which gives whole arenas back.
MOST_MOVES, MOST_PIECES = 700_000, 300_000


_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: base64 of a token's bytes, a space, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeTransducer:
    """Compiles merge ranks; ``encode`` gives the ids of one piece of text."""

    def __init__(self, ranks: dict[bytes, int], most_moves: int = MOST_MOVES) -> None:
        self.ranks, self.most_moves = ranks, most_moves
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                step = node << 8 | byte
                if step not in self.child:
                    self.child[step] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.child[step]
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.names: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.ends: list[tuple[int, ...]] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.pairs.clear()
        self._name(((-1, (), 0),))

    def merge(self, piece: bytes) -> list[int]:
        """The encoding by its definition: join the adjacent pair of least rank, leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _edges(self, token: int) -> tuple[list, list] | None:
        """What stands at a token's left and right edge as it is built, latest first, each with the rank that swallows it.

        None if the bytes don't encode to the token itself.
        """
        if token in self.edges:
            return self.edges[token]
        piece = self.tokens[token]
        left, right = [piece[:1]], [piece[-1:]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                left.append(parts[0])
            if at == len(parts) - 1:
                right.append(parts[-1])
        found = None
        if len(parts) == 1:
            found = tuple([(x, self.ranks[x] if len(x) > 1 else -1, self.ranks[up] if up else _NEVER) for x, up in zip(reversed(side), [None, *reversed(side)][:-1], strict=True)] for side in (left, right))
        self.edges[token] = found
        return found

    def _fits(self, before: int, token: int) -> bool:
        """Whether the two tokens stay apart: no merge across their border comes before those that build them."""
        known = self.pairs.get(before << 32 | token)
        if known is None:
            a, b = self._edges(before)[1], self._edges(token)[0]
            i = j = 0
            known = True
            while True:
                (x, made_x, gone_x), (y, made_y, gone_y) = a[i], b[j]
                rank = self.ranks.get(x + y)
                if rank is not None and rank < gone_x and rank <= gone_y:
                    known = False
                    break
                if made_x < 0 and made_y < 0:
                    break
                if made_x > made_y:
                    i += 1
                else:
                    j += 1
            self.pairs[before << 32 | token] = known
        return known

    def _name(self, state: tuple) -> int:
        name = self.names.setdefault(state, len(self.states))
        if name == len(self.states):
            self.states.append(state)
            for _, held, node in state:
                if not node:
                    self.ends.append(held)
                    break
            else:
                self.ends.append(())
        return name

    def _determinise(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        found = []
        child, token_at, edges, pairs = self.child, self.token_at, self.edges, self.pairs
        for last, held, node in self.states[state]:
            below = child.get(node << 8 | byte)
            if below is None:
                continue
            found.append((last, held, below))
            token = token_at[below]
            if token < 0 or not (edges[token] if token in edges else self._edges(token)):
                continue
            if last >= 0:
                fits = pairs.get(last << 32 | token)
                if not (self._fits(last, token) if fits is None else fits):
                    continue
            found.append((token, (*held, token), 0))
        emitted = found[0][1]
        if emitted:
            for _, held, _ in found:
                if held != emitted:
                    n = 0
                    for x, y in zip(held, emitted):
                        if x != y:
                            break
                        n += 1
                    emitted = emitted[:n]
                if not emitted:
                    break
        if emitted:
            n = len(emitted)
            found = [(last, held[n:], node) for last, held, node in found]
        move = self.moves[state << 8 | byte] = (self._name(tuple(found)), emitted)
        return move

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.moves) > self.most_moves:
            self.reset()
        state, out, moves = 0, [], self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._determinise(state, byte)
            state, emitted = move
            if emitted:
                out.extend(emitted)
        out.extend(self.ends[state])
        return out


class PieceCache(dict):
    """Piece of text to its ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, transducer: MergeTransducer, most: int = MOST_PIECES) -> None:
        super().__init__()
        self.transducer, self.most = transducer, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = packed
        return packed


#: Bytes that follow each lead byte of UTF-8, -1 where a byte can't lead.
_FOLLOW = [0] * 128 + [-1] * 66 + [1] * 30 + [2] * 16 + [3] * 5 + [-1] * 11


class StreamDecoder:
    """Turns token ids into text as they come.

    A state machine over UTF-8 knows how many bytes the open character still
    needs and holds them back; bytes that no character can hold become U+FFFD.
    """

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens, self.held = tokens, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.tokens.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                cut -= back if _FOLLOW[byte] >= back else 0
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def streamed(ids: memoryview, tokens: dict[int, bytes], step: int = 4096) -> bytes:
    """The UTF-8 bytes of the text that a ``StreamDecoder`` makes of ``ids``, held bytes included."""
    decoder = StreamDecoder(tokens)
    return ("".join([decoder.feed(ids[at : at + step]) for at in range(0, len(ids), step)]) + decoder.close()).encode()


def ascii_pattern(pattern: str) -> str:
    """What ``pattern`` means on ASCII text, for the faster standard library."""
    out, inside, i = "", False, 0
    means = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r" \t-\r"}
    while i < len(pattern):
        name = next((k for k in means if pattern.startswith(k, i)), None)
        if name:
            out += means[name] if inside else f"[{means[name]}]"
        elif pattern.startswith(r"\S", i):
            name = r"\S"
            out += r"[^ \t-\r]"
        else:
            name = pattern[i]
            inside = name == "[" or inside and name != "]"
            out += name
        i += len(name)
    return out


_made: dict[tuple, tuple] = {}


def _codec(ranks: dict[bytes, int], pattern: str, most_moves: int, most_pieces: int):
    """This worker's compiled codec, made once."""
    key = (pattern, hash(frozenset(ranks.items())), most_moves, most_pieces)
    if key not in _made:
        _made.clear()
        transducer = MergeTransducer(ranks, most_moves)
        plain, full = re.compile(ascii_pattern(pattern)).findall, regex.compile(pattern).findall
        _made[key] = (lambda text: plain(text) if text.isascii() else full(text), PieceCache(transducer, most_pieces), transducer.tokens)
        gc.freeze()  # the tables hold no cycles
    return _made[key]


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, most_moves: int = MOST_MOVES, most_pieces: int = MOST_PIECES) -> DataFrame:
    """Token ids of every text and the bytes that they decode to.

    Returns ``doc_id, token_ids, decoded`` with a row for each row of ``docs``:
    ``token_ids`` packs the ids as little-endian unsigned 32-bit integers. Each
    match of ``pattern`` is encoded by itself, without special tokens. A null
    or empty text has no ids and no bytes. Repeated rows and null ids of
    documents are kept, other columns ignored; an empty table gives no rows.
    The ranks, whose size the file bounds, go to the executors as a broadcast.
    ``most_moves`` and ``most_pieces`` bound what a worker remembers and so its
    memory; they change the time and never the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, cache, tokens = _codec(shared.value, pattern, most_moves, most_pieces)
        packed_of = cache.__getitem__
        for part in slices(batches):
            gc.disable()  # states and moves are many and hold no cycles
            try:
                ids = [b"".join(map(packed_of, find(text))) if text else b"" for text in part.column(1).to_pylist()]
                back = [streamed(memoryview(x).cast("I"), tokens) for x in ids]
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["doc_id", "token_ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, token_ids binary, decoded binary")


def token_digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` from what ``encode_and_decode`` returns."""
    return encoded.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
