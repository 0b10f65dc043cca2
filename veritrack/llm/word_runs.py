"""Runs of periodic word sequences by a suffix automaton (operator 13).

A run is a stretch of words with smallest period ``q``, at least ``2 q`` and
``least`` long, that neither neighbour extends. The automaton's states hold the
ordered sets of ends of their strings; they are merged small into large up the
suffix links. Two ends that become neighbours in a state, at a distance of at
most the state's length, are a square; a square that no known run of its period
covers is extended both ways to one.

A run of at least ``least`` words repeats every window of ``least / 2`` words in
it at a distance of its period. Stretches without such repeats hold no run, so
the automaton is built only over the rest, which hashes of windows find for
whole blocks of texts at once; equal hashes of unequal windows only make a
stretch longer.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrack.llm.kernels import blocks, mix, slices, span_hashes, utf8, window_hashes, words

LEAST = 12
#: Ends in one part of an ordered set, at most.
WIDE = 512
#: Texts of more bytes number their words instead of hashing their bytes.
LONG_TEXT = 1 << 20


class Ends:
    """An ordered set of end positions in parts of bounded size."""

    __slots__ = ("parts", "firsts", "size")

    def __init__(self, end: int) -> None:
        self.parts, self.firsts, self.size = [[end]], [end], 1

    def _part(self, end: int) -> int:
        return max(bisect_right(self.firsts, end) - 1, 0) if len(self.firsts) > 1 else 0

    def add(self, end: int) -> None:
        k = self._part(end)
        part = self.parts[k]
        insort(part, end)
        self.firsts[k] = part[0]
        if len(part) > WIDE:
            self.parts[k : k + 1] = [part[: WIDE // 2], part[WIDE // 2 :]]
            self.firsts[k : k + 1] = [part[0], part[WIDE // 2]]
        self.size += 1

    def around(self, end: int) -> tuple[int | None, int | None]:
        """The neighbours of a member."""
        k = self._part(end)
        part = self.parts[k]
        i = bisect_left(part, end)
        before = part[i - 1] if i else self.parts[k - 1][-1] if k else None
        after = part[i + 1] if i + 1 < len(part) else self.parts[k + 1][0] if k + 1 < len(self.parts) else None
        return before, after

    def __iter__(self) -> Iterator[int]:
        for part in self.parts:
            yield from part


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, lengths, and the end of the prefix that a state stands for, -1 for clones, of the suffix automaton."""
    moves: list[dict[int, int]] = [{}]
    link, length, end, last = [-1], [0], [-1], 0
    for i, c in enumerate(ids):
        new = len(moves)
        moves.append({})
        length.append(i + 1)
        end.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                end.append(-1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
        last = new
    return link, length, end


class _Runs:
    """Repetitions found so far, by period; those of one period overlap in less than it."""

    def __init__(self, ids: list[int]) -> None:
        self.ids, self.starts, self.stops = ids, {}, {}

    def square(self, before: int, end: int, size: int) -> None:
        """The words from ``before - size + 1`` to ``end`` have the period ``end - before``."""
        q, low = end - before, before - size + 1
        starts = self.starts.setdefault(q, [])
        k = bisect_right(starts, low) - 1
        if k >= 0 and self.stops[q, starts[k]] > end:
            return
        ids, stop = self.ids, end + 1
        while low and ids[low - 1] == ids[low - 1 + q]:
            low -= 1
        while stop < len(ids) and ids[stop] == ids[stop - q]:
            stop += 1
        insort(starts, low)
        self.stops[q, low] = stop


def repetitions(ids: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``ids``, by start and period."""
    link, length, end = automaton(ids)
    ends: list[Ends | None] = [Ends(e) if e >= 0 else None for e in end]
    fresh: list[list[int]] = [[] for _ in link]
    found = _Runs(ids)
    for state in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        own, size = ends[state], length[state]
        for e in fresh[state]:
            before, after = own.around(e)
            if before is not None and e - before <= size:
                found.square(before, e, size)
            if after is not None and after - e <= size:
                found.square(e, after, size)
        up = link[state]
        if up:
            other = ends[up]
            if other is None:
                ends[up] = own
            elif own.size > other.size:
                fresh[up] = list(other)
                for e in fresh[up]:
                    own.add(e)
                ends[up] = own
            else:
                fresh[up] += own
                for e in own:
                    other.add(e)
        ends[state], fresh[state] = None, []
    return sorted((low, stop - low, q) for (q, low), stop in found.stops.items() if stop - low >= max(least, 2 * q))


def repeating_stretches(windows: np.ndarray, width: int, least: int) -> list[tuple[int, int]]:
    """Stretches ``[low, high)`` of words outside which no run can be.

    ``windows`` has a hash for each window of ``width`` words. A window counts if
    an equal one is within half a stretch of it; what such windows cover is taken
    as new stretches until nothing changes.
    """
    out, todo = [], [(0, len(windows) + width - 1)] if len(windows) else []
    while todo:
        low, high = todo.pop()
        part = windows[low : high - width + 1]
        order = np.argsort(part, kind="stable")
        near = (part[order[1:]] == part[order[:-1]]) & (np.diff(order) <= (high - low) // 2)
        if not near.any():
            continue
        edge = np.zeros(high - low + 1, np.int32)
        for at in (order[1:][near], order[:-1][near]):
            np.add.at(edge, at, 1)
            np.add.at(edge, at + width, -1)
        inside = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + low
        for a, b in zip(turns[0::2].tolist(), turns[1::2].tolist(), strict=True):
            if (a, b) == (low, high):
                out.append((a, b))
            elif b - a >= least:
                todo.append((a, b))
    return out


def _numbered(tokens: list[bytes]) -> list[int]:
    known: dict[bytes, int] = {}
    return [known.setdefault(t, len(known)) for t in tokens]


def text_runs(texts: list[bytes], least: int = LEAST) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words of each text and its runs."""
    width = (least + 1) // 2
    for _, part in blocks(texts):
        if len(part) == 1 and len(part[0]) > LONG_TEXT:
            tokens = part[0].split()
            first, windows = [0, len(tokens)], window_hashes(mix(np.array(_numbered(tokens), np.uint64)), width)
        else:
            w = words(part)
            first, windows = w.first.tolist(), window_hashes(span_hashes(w.buf, w.starts, w.ends), width)
        for i, text in enumerate(part):
            a, b = first[i], first[i + 1]
            tokens, runs = text.split(), []
            if b - a >= least:
                for low, high in repeating_stretches(windows[a : b - width + 1], width, least):
                    runs += [(low + s, n, q) for s, n, q in repetitions(_numbered(tokens[low:high]), least)]
            yield tokens, sorted(runs)


def collapsed(tokens: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if runs:
        keep = np.ones(len(tokens), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        tokens = [tokens[i] for i in np.flatnonzero(keep)]
    return b" ".join(tokens)


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row of ``docs(doc_id, text)``.

    ``runs`` lists ``(start, length, period)`` in words by start and period;
    ``collapsed`` joins the words that stay by one space. A null text, an empty
    one and one without words have no words, no runs and an empty ``collapsed``.
    Rows are judged one by one, so repeated rows and null ids stay; other
    columns are ignored and an empty table gives no rows.
    """
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            counts, offsets, flat, left = [], [0], [], []
            for tokens, runs in text_runs(utf8(batch.column(1)), least):
                counts.append(len(tokens))
                flat += runs
                offsets.append(len(flat))
                left.append(collapsed(tokens, runs))
            columns = np.array(flat, np.int64).reshape(-1, 3)
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(3)], fields=list(kind)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), runs, pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"))


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run of each row (ties: least start, then period) and digests of all its runs and of what is left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("best", best)
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                       F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in which one document in ten repeats its own words from some word on, by a rule over the checksum of its id."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(w):
        n = F.size(w)
        a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
        p = F.floor((n - a) / (3 + g % 8)).cast("int") + 1
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")

    # the array of one array holds the words, so that they are split once
    tokens = F.array(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    text = F.when(F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").isNotNull(), F.transform(tokens, repeat)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))
