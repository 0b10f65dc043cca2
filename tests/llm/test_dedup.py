import random
import re

import numpy as np
import pytest

from veritrack.llm import embedding_dedup
from veritrack.llm.embedding_dedup import embedding_near_duplicates, leaves, plant
from veritrack.llm.near_dup import BINS, agreement_floor, minhash_near_duplicates, open_pairs, sketch

DOCS = "doc_id long, text string, bucket string, component_id string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def groups(ids, linked):
    head = {i: i for i in ids}

    def find(a):
        while head[a] != a:
            a = head[a]
        return a

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[draw.choice(vocabulary) for _ in range(draw.randint(1, 300))] for _ in range(25)]
    out = [" ".join(b) for b in base]
    for b in base:
        for changes in (0, 1, 1, 3, 8):
            c = list(b)
            for _ in range(min(changes, len(c))):
                c[draw.randrange(len(c))] = draw.choice(vocabulary)
            out.append(" ".join(c).upper() if changes == 0 else "\n".join(c))
    shared = " ".join(draw.choice(vocabulary) for _ in range(60))
    out += [f"{shared} " + " ".join(draw.choice(vocabulary) for _ in range(60)) for _ in range(20)]
    return [*out, None, "", " \n\t ", "one two", "ONE two", "one two three", "é x É", "x" * 5000]


def test_minhash_equals_brute_force(spark, texts):
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = groups(list(sets), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame([(i, t, "b", "c") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in minhash_near_duplicates(docs).collect()}
    assert {i: (len(sets[i]), want[i], want[i] == i) for i in sets} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


def test_minhash_of_nothing_and_of_repeats(spark):
    assert minhash_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(3, "a b c d e f", "", ""), (3, "a b c d e f", "", ""), (None, "a b c d e f", "", ""), (2, "A b c d e f", "", "")], DOCS)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash_near_duplicates(docs).collect()) == [(2, 2, True), (3, 2, False), (3, 2, False)]


def test_embeddings_equal_brute_force(spark):
    draw = np.random.default_rng(3)
    base = draw.standard_normal((40, 16))
    near = np.concatenate([base, base + 0.1 * draw.standard_normal(base.shape), base + 0.1 * draw.standard_normal(base.shape), base[:5], base[:1] + 0.02 * draw.standard_normal((700, 16))])
    labels = [int(i) % 3 for i in draw.integers(0, 3, len(near))]
    rows = [(i, [float(x) for x in v], y) for i, (v, y) in enumerate(zip(near, labels, strict=True))]
    odd = [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [1.0, None] + [0.0] * 14, 0), (9005, [1.0], 0), (9006, rows[0][1], None), (9008, [1e200] + [0.0] * 15, 50), (9009, [1e-200] + [0.0] * 15, 50), (9010, [1e300, 1e-300, 0.0], 50), (9011, [2.0, 0.0, 0.0], 50), (9007, [float("inf")] * 16, 0), (None, rows[0][1], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")).collect()}
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(link, False)
    heads = groups(list(range(len(near))), lambda a, b: link[a, b])
    exact = sum(got[i] == (link[i].sum(), heads[i], heads[i] == i) for i in heads)
    assert exact >= 0.98 * len(heads)
    assert all(got[i][0] <= link[i].sum() for i in heads)
    assert all(got[v] == (0, v, True) for v in range(9001, 9008) if v in got) and len(got) == len(rows) + 11
    assert [got[v] for v in range(9008, 9012)] == [(1, 9008, True), (1, 9008, False), (1, 9010, True), (1, 9010, False)]
    assert embedding_near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("depth,pairs", [(10, 1000), (14, 500), (18, 300)])
@pytest.mark.parametrize("size", [16, 64, 384])
def test_forest_finds_close_pairs_at_any_depth(size, depth, pairs):
    """Recall of pairs just over the threshold and leaves a vector and tree, on isotropic vectors."""
    if (size, depth) == (384, 18):
        pytest.skip("as long as the others together")
    draw = np.random.default_rng(8)
    base = embedding_dedup._unit(draw.standard_normal((4000, size)))
    side = draw.standard_normal((pairs, size))
    side -= (side * base[:pairs]).sum(1, keepdims=True) * base[:pairs]
    close = 0.935 * base[:pairs] + (1 - 0.935**2) ** 0.5 * embedding_dedup._unit(side)
    together, copies, trees = np.zeros(pairs, bool), 0, embedding_dedup.trees_for(depth)
    for seed in range(trees):
        tree = plant(base, embedding_dedup.LEAF << depth, seed)
        assert tree.depth == depth
        row, at = leaves(np.concatenate([base[:pairs], close]), tree)
        copies += len(row) / (2 * pairs)
        spots = [set() for _ in range(2 * pairs)]
        for r, leaf in zip(row.tolist(), at.tolist(), strict=True):
            spots[r].add(leaf)
        together |= np.array([bool(spots[i] & spots[i + pairs]) for i in range(pairs)])
    assert together.mean() >= 0.95 and copies < 2.6 * trees, (together.mean(), copies, trees)


def test_trees_follow_the_depth():
    assert [embedding_dedup.trees_for(d) for d in (0, 3, 10, 14, 18)] == [1, 6, 7, 10, 15]
    rng = np.random.default_rng(3)
    x = rng.standard_normal(400_000)
    y = 0.93 * x + (1 - 0.93**2) ** 0.5 * rng.standard_normal(400_000)
    edge = 0.0627068  # of the middle 5 % of a normal
    apart = ((x < -edge) & (y > edge) | (x > edge) & (y < -edge)).mean()
    assert abs(1 - apart - embedding_dedup.kept_at_a_node()) < 0.002


def test_fitting_sample_is_bounded_and_repeats(spark):
    rows = spark.range(30_000).selectExpr("cast(id as string) AS print", "array(cast(id % 7 + 1 as float), cast(id % 11 as float)) AS embedding").repartition(16)
    some = embedding_dedup.fitting_sample(rows, 30_000, 2, 500)
    assert 400 <= len(some) <= 500 and np.allclose(np.linalg.norm(some, axis=1), 1)
    assert (embedding_dedup.fitting_sample(rows.repartition(3), 30_000, 2, 500) == some).all()
    assert len(embedding_dedup.fitting_sample(rows.limit(40), 40, 2, 500)) == 40
    assert embedding_dedup.fitting_sample(rows.limit(0), 0, 2, 500).shape == (0, 2)


def test_forest_loses_no_link_of_deep_trees(spark, monkeypatch):
    """Close pairs at a small leaf size, so that trees are deep; the index is fitted on a part of the rows."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 32)
    draw = np.random.default_rng(9)
    base = draw.standard_normal((1500, 32))
    rows = np.concatenate([base, base[:300] + 0.1 * draw.standard_normal((300, 32))])
    df = spark.createDataFrame([(i, v.tolist(), 1, "clash", True) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int, component_id string, kept boolean")
    got = {r.vec_id: r.component_id for r in embedding_near_duplicates(df.union(df.limit(5)), fit_rows=400).collect()}
    unit = embedding_dedup._unit(rows.astype(np.float32))
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)), strict=True)}
    found = {(i, j) for i, j in want if got[i] == got[j]}
    assert len(found) >= 0.97 * len(want) and len(want) >= 290


def near(a, b):
    return 100 * len(a & b) >= 75 * len(a | b)


def family(name, n):
    return [f"{name}.{i}" for i in range(n)]


def assert_groups(spark, texts):
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = groups(list(sets), lambda a, b: near(sets[a], sets[b]))
    docs = spark.createDataFrame([(i, t, "b", "c") for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id: r.component_id for r in minhash_near_duplicates(docs).collect()} == want
    return sets, want


def test_minhash_finds_links_inside_a_template_family(spark):
    """Documents just under the threshold with each other, with pairs just over it among them."""
    texts = []
    for i in range(500):
        own = family(f"pair{i // 2}", 6) + family(f"own{i}", 62) if i < 24 else family(f"own{i}", 68)
        texts.append(" ".join(family("template", 400) + own))
    sets, want = assert_groups(spark, texts)
    assert [i for i in want if want[i] != i] == list(range(1, 24, 2))


def test_minhash_finds_links_to_single_members_of_a_large_group(spark):
    """Each of the last documents links with one member of a large group only."""
    template, texts = family("template", 400), []
    for i in range(200):
        texts.append(" ".join(template + family(f"own{i}", 30)))
    for x in range(6):
        texts.append(" ".join(template[: 65 * x] + template[65 * (x + 1) :] + family(f"own{x}", 9) + family(f"end{x}", 18)))
    sets, want = assert_groups(spark, texts)
    assert all([i for i in range(206) if i != x and near(sets[i], sets[x])] == [x - 200] for x in range(200, 206))
    assert set(want.values()) == {0}


def test_sketch_floor_loses_no_linked_pair():
    """Pairs at exactly 0.75 of several sizes: none is below the floor of its size."""
    draw = np.random.default_rng(12)
    for n in (3, 6, 15, 60, 300):
        for _ in range(1500):
            s = draw.integers(0, 1 << 63, n + n // 3, dtype=np.uint64) * np.uint64(2)
            a, b = (sketch(np.unique(x)) for x in (s[:n], s))
            assert (a == b).mean() >= agreement_floor(n), n


def test_minhash_compares_all_components_of_a_bucket():
    """Three components that share one bucket only: all three pairs are open, whichever comes first."""
    bands = np.array([[1, 9, 3], [4, 9, 6], [7, 9, 8]], np.int64)
    side = (np.arange(3), np.arange(3), bands, np.zeros((3, BINS), np.uint8), np.full(3, 300))
    p, q = open_pairs(9, side, side)
    assert {frozenset(x) for x in zip(p.tolist(), q.tolist(), strict=True)} == {frozenset(x) for x in ((0, 1), (0, 2), (1, 2))}
