"""Vectorised text helpers used inside Arrow batches.

Texts are UTF-8 bytes. A word is a maximal run of bytes outside space and
0x09-0x0D, which on UTF-8 equals the same rule on code points. Words are hashed
by a polynomial over their bytes, taken from one running sum per block, and
mixed to 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps; the rest, for longer texts, are made when needed.
_KEPT = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    """``base**i mod 2**64`` for i < n; those of blocks of usual size are kept for the next one."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _KEPT), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= _KEPT:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words(NamedTuple):
    """Words of a block of texts: ``starts``/``ends`` into ``buf``, and where each text's words begin."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(texts) + 1 offsets into starts
    base: np.ndarray  # len(texts) + 1 offsets of the texts in buf


def words(texts: list[bytes]) -> Words:
    blob = b"\n" + b"\n".join(texts) + b"\n"
    buf = np.frombuffer(blob, np.uint8)
    gap = SPACE[buf]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=base[1:])
    base += 1
    return Words(buf, starts, ends, np.searchsorted(starts, base), base)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(buf)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(buf))[starts])


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` values, at the run's start; shorter tails are left out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : j + n]
    return mix(out)


def blocks(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes together, each with its offset; a longer text makes a block of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def slices(batches, rows: int = 512):
    """Arrow batches cut into smaller ones, so that a worker holds the Python texts of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes, null as empty; no decoding."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of ``k``-word shingles of each text, A-Z lower-cased.

    A text of fewer than ``k`` words has its whole sequence as the one shingle;
    a text without words has none.
    """
    for _, part in blocks(texts):
        w = words([t.translate(LOWER) for t in part])
        h = span_hashes(w.buf, w.starts, w.ends)
        runs = window_hashes(h, k)
        for i in range(len(part)):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= k:
                s = np.sort(runs[a : b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield mix(window_hashes(h[a:b], int(b - a)) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
