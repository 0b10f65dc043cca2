"""Token counts by count-only Viterbi over a unigram vocabulary (operator 6).

An Aho-Corasick automaton lists the vocabulary's matches by their ends, longest
first. Dynamic programming carries the best score and its number of pieces to
each end; nothing else is kept. Ties follow the tokenizer: a later candidate
wins only by a higher score, and candidates come by ascending start, so the
longest last piece wins. A character without a piece of its own may stand as
unknown, at 10 below the least score, and counts as its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MOST_PIECES = 600_000
UNKNOWN_PENALTY = 10.0


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece model with their scores, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class PieceCounter(dict):
    """Segment of text to its number of pieces."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        super().__init__()
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        #: Text may be cut before a mark or around a line feed only if no piece reaches across.
        self.local = not any(MARK in piece.lstrip(MARK) or "\n" in piece for piece, _ in vocabulary)

    def segments(self, text: str) -> list[str]:
        """Parts of a text whose counts add up; none for an empty text."""
        if not text:
            return []
        whole = MARK + text.replace(" ", MARK)
        return _SEGMENT(whole) if self.local else [whole]

    def __missing__(self, segment: str) -> int:
        n = len(segment)
        best: list = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        single, done = self.single, 0

        def lone(upto: int) -> None:
            for i in range(done, upto):
                c = segment[i]
                if c not in single and (best[i + 1] is None or best[i] + self.unknown > best[i + 1]):
                    best[i + 1] = best[i] + self.unknown
                    count[i + 1] = count[i] + len(c.encode())

        for last, (length, score) in self.automaton.iter(segment):
            if last > done:
                lone(last)
                done = last
            start = last + 1 - length
            candidate = best[start] + score
            if best[last + 1] is None or candidate > best[last + 1]:
                best[last + 1] = candidate
                count[last + 1] = count[start] + 1
        lone(n)
        if n <= 48:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[segment] = count[n]
        return count[n]


_SEGMENT = regex.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall
_made: dict[int, PieceCounter] = {}


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """``doc_id, n_tokens`` for every row of ``docs(doc_id, text)``.

    The text is normalised as the tokenizer does it: a mark goes before it and
    every space becomes a mark. Null and empty texts have 0 tokens. Repeated
    rows and null ids are kept, other columns ignored; an empty table gives no
    rows. The vocabulary goes to the executors as a broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(shared.value))
        if key not in _made:
            _made.clear()
            _made[key] = PieceCounter(shared.value)
        counter = _made[key]
        count = counter.__getitem__
        for batch in batches:
            n = [sum(map(count, counter.segments(text or ""))) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
