import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritrack.llm import word_runs
from veritrack.llm.kernels import window_hashes
from veritrack.llm.word_runs import Ends, find_runs, planted, repeating_stretches, repetitions, run_digests, text_runs


def plain_runs(ids, least=12):
    """Every stretch of equal words at each distance, if no smaller distance does for the same stretch."""
    found = {}
    for q in range(1, len(ids) // 2 + 1):
        i = 0
        while i + q < len(ids):
            j = i
            while j + q < len(ids) and ids[j] == ids[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items() if not any(d < q and all(ids[k] == ids[k + d] for k in range(s, s + n - d)) for d in range(1, q)))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([2, 5, 12]))
def test_repetitions_equal_brute_force(ids, least):
    assert repetitions(ids, least) == plain_runs(ids, least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.integers(1, 6)), max_size=6), st.sampled_from([2, 12]))
def test_texts_equal_brute_force(parts, least):
    ids = [x for p, n in parts for x in p * n]
    text = " \n".join(f"w{i}" for i in ids).encode()
    (tokens, runs), (_, again) = text_runs([text, b"x " + text], least)
    assert tokens == text.split() and runs == plain_runs(ids, least)
    assert again == plain_runs([-1, *ids], least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_stretches_hold_every_run(ids):
    stretches = repeating_stretches(window_hashes(np.array(ids, np.uint64), 6), 6, 12)
    for start, length, _ in plain_runs(ids):
        assert any(a <= start and start + length <= b for a, b in stretches)


def test_ends_stay_in_order(monkeypatch):
    monkeypatch.setattr(word_runs, "WIDE", 4)
    rng, ends = np.random.default_rng(5), Ends(500)
    have = {500}
    for e in rng.permutation(1000).tolist():
        if e != 500:
            ends.add(e)
            have.add(e)
        if e % 97 == 0:
            s = sorted(have)
            i = s.index(e)
            assert list(ends) == s and ends.around(e) == (s[i - 1] if i else None, s[i + 1] if i + 1 < len(s) else None)


@pytest.mark.parametrize("text,want", [("a " * 30_000, (0, 30_000, 1)), ("a b " * 20_000 + "c", (0, 40_000, 2)), ("x " + " ".join(f"w{i}" for i in range(5000)) * 1 + " y" + (" " + " ".join(f"v{i}" for i in range(4000))) * 3, (5002, 12_000, 4000))])
def test_long_texts(text, want):
    ((_, runs),) = text_runs([text.encode()])
    assert runs == [want]


def test_very_long_text_numbers_its_words(monkeypatch):
    monkeypatch.setattr(word_runs, "LONG_TEXT", 10)
    text = b"one two three four five six " * 4 + b"end"
    assert [r for _, r in text_runs([text, b"", b"short"])] == [[(0, 24, 6)], [], []]


def plain_row(doc_id, text):
    w = [] if text is None else text.encode().split()
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    ids = {x: i for i, x in enumerate(dict.fromkeys(w))}
    runs = plain_runs([ids[x] for x in w])
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest())


def test_rows_with_nulls_ties_and_clashing_columns(spark):
    loop = "one two three four five six "
    rows = [(i, t) for i, t in enumerate([None, "", " \t\n ", "alone", loop * 2, loop * 2 + "x " + loop * 2, "é漢 " * 9 + "\x1c \x85 \xa0", "a b c d e f g h i j k l m n o p", loop * 7])] + [(4, loop * 2), (None, loop * 3), (10**12, "q " * 40)]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, n_words int, runs string")
    got = run_digests(find_runs(planted(docs))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *plain_row(i, t))) for i, t in rows)
    assert run_digests(find_runs(planted(docs.limit(0)))).count() == 0


def test_registered_query_equals_brute_force(spark):
    import pyarrow.parquet as pq

    from veritrack.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_word_runs"](spark, d).collect()}
    docs = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(docs)
    short = [x for x in docs if len(x["text"] or "") < 3000]
    assert sum(got[x["doc_id"]][0] > 0 for x in short) > 5
    for x in short:
        assert got[x["doc_id"]] == plain_row(x["doc_id"], x["text"]), x["doc_id"]
