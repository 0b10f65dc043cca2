"""Near-duplicate embeddings by a forest of random-projection trees (operator 10).

Each tree splits recursively: every node has a random direction of its own and
divides its vectors at the median of their projections. A vector in the middle
``SPILL`` of a node's projections goes down both sides. A tree is as deep as
the rows of the largest label need for leaves of about ``LEAF`` vectors; the
medians come from a bounded fitting sample, at nodes that few of the sample
reach from all of it. Deeper trees part more pairs, so the number of trees
follows the depth. Every vector is sent to all its leaves; vectors that
share a leaf and a label are compared in blocks and links are verified in
double precision. A link counts in the first leaf that its two vectors share,
so once over all trees. From a pair of blocks come a count for each vector and
a spanning star for each of its connected groups, never all pairs of a group;
the stars are joined to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrack.plans.components import connected_components
from veritrack.plans.lineage import cut, release

#: ``SPILL`` is a share of a node's vectors, so that the number of copies does not depend on the dimension.
THRESHOLD, LEAF, SPILL = 0.93, 1024, 0.05
#: The share of pairs just at the threshold that share a leaf of some tree, by which the number of trees follows the depth.
RECALL, LEAST_TREES = 0.98, 6
#: Rows of a block of a leaf; a pair of blocks is one unit of comparison.
BLOCK = 512
#: A node that fewer vectors of the sample reach takes its division from the whole sample.
LEAST_FIT = 32
#: Vectors of the sample that go along for nodes without a division of their own.
COMMON = 512


class Tree(NamedTuple):
    """Divisions ``node: (low, middle, high)`` of nodes in heap order, vectors for the nodes without one, and the depth."""

    seed: int
    depth: int
    divisions: dict[int, tuple[float, float, float]]
    common: np.ndarray


def direction(seed: int, node: int, size: int) -> np.ndarray:
    """A node's random direction, the same on every machine."""
    d = np.random.default_rng((seed, node)).standard_normal(size)
    return d / np.linalg.norm(d)


def _division(projected: np.ndarray) -> tuple[float, float, float]:
    return tuple(np.quantile(projected, [0.5 - SPILL / 2, 0.5, 0.5 + SPILL / 2]).tolist())


def plant(sample: np.ndarray, rows: int, seed: int) -> Tree:
    """A tree for a table of ``rows`` unit vectors like those of ``sample``."""
    depth = depth_for(rows) if len(sample) else 0
    divisions: dict[int, tuple[float, float, float]] = {}
    here = {1: np.arange(len(sample))}
    for _ in range(depth):
        below = {}
        for node, members in here.items():
            projected = sample[members] @ direction(seed, node, sample.shape[1])
            divisions[node] = _division(projected)
            right = projected > divisions[node][1]
            below |= {2 * node + side: part for side, part in ((0, members[~right]), (1, members[right])) if len(part) >= LEAST_FIT}
        here = below
    return Tree(seed, depth, divisions, sample[:COMMON])


def leaves(x: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and leaf numbers of unit vectors ``x``, with a row for each leaf that a vector spills into."""
    row, at = np.arange(len(x)), np.ones(len(x), np.int64)
    for _ in range(tree.depth):
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        edges = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        rows, places = [], []
        for begin, end in zip(edges, np.append(edges[1:], len(at)), strict=True):
            node, members = int(at[begin]), row[begin:end]
            d = direction(tree.seed, node, x.shape[1])
            low, middle, high = tree.divisions.get(node) or _division(tree.common @ d)
            projected = x[members] @ d
            both = (projected >= low) & (projected <= high)
            right = projected > middle
            rows += [members[~right | both], members[right | both]]
            places += [np.full(len(rows[-2]), 2 * node), np.full(len(rows[-1]), 2 * node + 1)]
        row, at = np.concatenate(rows), np.concatenate(places)
    return row, at


def kept_at_a_node(threshold: float = THRESHOLD, spill: float = SPILL) -> float:
    """The chance that a node sends two vectors at the threshold down a common side, for directions without preference.

    Their projections are normal with the threshold as correlation. They part
    if one lies below the band that spills and the other above it.
    """
    x = np.linspace(0.0, 9.0, 20_001)
    normal = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    below = np.concatenate(([0.5], 0.5 - np.cumsum((normal[1:] + normal[:-1]) / 2) * (x[1] - x[0])))  # the share under -x
    edge = x[np.searchsorted(-below, -(0.5 - spill / 2))]
    across = np.interp((edge + threshold * x) / math.sqrt(1 - threshold * threshold), x, below, right=0.0)
    return 1 - 2 * float((normal * across)[x >= edge].sum() * (x[1] - x[0]))


def trees_for(depth: int, recall: float = RECALL) -> int:
    """How many trees of a depth bring pairs at the threshold together with the chance ``recall``."""
    one = kept_at_a_node() ** depth
    return 1 if one == 1 else max(LEAST_TREES, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def depth_for(rows: int) -> int:
    return max(0, math.ceil(math.log2(max(rows, 1) / LEAF)))


def _unit(raw) -> np.ndarray:
    """Rows of length 1; the largest component is made 1 first, so no square over- or underflows."""
    x = np.asarray(raw, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Where vectors of a length that no label has many of go: one leaf, compared whole.
PLAIN = [Tree(0, 0, {}, np.zeros((0, 1)))]
TREE_SHIFT = 56


def _router(trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = trees.value
        for batch in batches:
            column = batch.column("embedding")
            starts = column.offsets.to_numpy()
            sizes, flat = np.diff(starts), column.values.to_numpy(zero_copy_only=False)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = _unit(flat[starts[rows][:, None] + np.arange(size)])
                for t, tree in enumerate(forests.get(int(size), PLAIN)):
                    row, leaf = leaves(x, tree)
                    found.append((rows[row], t << TREE_SHIFT | leaf))
            row, place = (np.concatenate(part) for part in zip(*found, strict=True))
            order = np.lexsort((place, row))
            offsets = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place[order]))], [*batch.schema.names, "leaves"])

    return run


def _block(members: pa.Array):
    """Ids, copies, unit vectors, and (row, leaf) of a block's members."""
    flat = members.flatten()
    rows = np.repeat(np.arange(len(members)), np.diff(flat[3].offsets.to_numpy())) if len(members) else np.zeros(0, np.int64)
    x = flat[2].flatten().to_numpy(zero_copy_only=False).reshape(len(members), -1)
    return flat[0].to_numpy(), flat[1].to_numpy(), _unit(x), rows, flat[3].flatten().to_numpy()


def compare(leaf: int, same: bool, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(ids, links, ids, heads)``: links counted here by id, and for linked ids the least id of their group here."""
    near = a[2] @ b[2].T >= THRESHOLD
    if same:
        near &= ~np.eye(len(near), dtype=bool)
    ids = a[0] if same else np.concatenate([a[0], b[0]])
    heads = ids.copy()
    p, q = np.nonzero(near)
    q = q if same else q + len(a[0])
    while True:
        low = heads.copy()
        np.minimum.at(low, p, heads[q])
        np.minimum.at(low, q, heads[p])
        if (low == heads).all():
            break
        heads = low
    before = np.unique(np.concatenate([a[4], b[4]]))
    before = before[before < leaf]
    if len(before) and len(p):
        def holds(side):
            m = np.zeros((len(side[0]), len(before)), np.float32)
            early = side[4] < leaf
            m[side[3][early], np.searchsorted(before, side[4][early])] = 1
            return m

        near &= holds(a) @ holds(b).T == 0
    links = near @ b[1]
    if not same:
        links = np.concatenate([links, near.T @ a[1]])
    return ids, links, ids[heads != ids], heads[heads != ids]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            a, b = (_block(batch[side].slice(i, 1).flatten()) for side in ("a", "b"))
            ids, links, low, heads = compare(batch["leaf"][i].as_py(), batch["same"][i].as_py(), a, b)
            some = links > 0
            none = np.zeros(len(low), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], low])), pa.array(np.concatenate([links[some], none])), pa.array(np.concatenate([ids[some], heads]))], ["vec_id", "links", "head"])


def fitting_sample(classes: DataFrame, rows: int, size: int, most: int, seed: int = 17) -> np.ndarray:
    """About ``most`` unit vectors of ``classes(print, embedding)`` of one ``size``, the same on every run, and never more.

    Each task keeps the vectors whose hash is under a threshold and sends no
    others; a sample that chance made too large is cut in the order of hashes.
    """
    hashed = classes.select(F.xxhash64("print", F.lit(seed)).alias("h"), F.col("embedding").cast("array<float>").alias("embedding"))
    share = min(1.0, most / max(rows, 1))
    kept = hashed.where(F.col("h") < F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).toArrow().sort_by("h").slice(0, most)
    if not kept.num_rows:
        return np.zeros((0, size))
    return _unit(kept["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, size))


def embedding_near_duplicates(vectors: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding, label)``.

    Trees are fitted on a sample of at most ``fit_rows`` vectors of each length that some
    label has more than ``LEAF`` of; every vector is placed. Equal vectors of a
    label are folded before the search and count as links of each other. A null
    label, a null or zero vector and one with null or non-finite components
    link with nothing; vectors of different length do not link. Rows with a
    null ``vec_id`` are left out; rows that repeat a ``vec_id`` are one vector
    if equal, else each is compared. Other columns are ignored; an empty table
    gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf")))
    good = rows.where(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    good = good.withColumn("print", F.sha2(F.to_json(F.struct("label", F.transform("embedding", lambda x: x + F.lit(0.0)))), 256)).withColumn("label", F.concat_ws(":", F.size("embedding"), "label"))
    members = cut(good.select("vec_id", "print").distinct())
    classes = cut(good.groupBy("print").agg(F.min("vec_id").alias("vec_id"), F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.countDistinct("vec_id").alias("copies")))
    by_label = classes.groupBy("label").agg(F.count("*").alias("n"), F.first(F.size("embedding")).alias("size"))
    forests = {}
    for r in by_label.groupBy("size").agg(F.max("n").alias("n"), F.sum("n").alias("all")).where(F.col("n") > LEAF).collect():
        sample = fitting_sample(classes.where(F.size("embedding") == r["size"]), r["all"], r["size"], fit_rows)
        forests[r["size"]] = [plant(sample, r.n, seed) for seed in range(trees_for(depth_for(r.n)))]
    forest = vectors.sparkSession.sparkContext.broadcast(forests)
    placed = cut(classes.select("vec_id", "label", "copies", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
                 .mapInArrow(_router(forest), f"vec_id long, label string, copies long, embedding array<{'float' if single else 'double'}>, leaves array<long>"))
    sent = placed.select(F.explode("leaves").alias("leaf"), "label", F.struct("vec_id", "copies", "embedding", "leaves").alias("member"))
    sizes = placed.select(F.explode("leaves").alias("leaf"), "label").groupBy("leaf", "label").count().where("count > 1").select("leaf", "label", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    part = sent.join(sizes, ["leaf", "label"]).withColumn("block", F.pmod(F.xxhash64("member.vec_id"), F.col("blocks")).cast("int"))
    blocks = part.groupBy("leaf", "label", "block", "blocks").agg(F.collect_list("member").alias("members"))
    alone = blocks.where("blocks = 1").select("leaf", F.lit(True).alias("same"), F.col("members").alias("a"), F.col("members").alias("b"))
    many = cut(blocks.where("blocks > 1"))
    left = many.select("leaf", "label", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("members").alias("a"))
    right = many.select("leaf", "label", F.col("block").alias("j"), F.col("members").alias("b"))
    pairs = left.join(right, ["leaf", "label", "j"]).select("leaf", (F.col("i") == F.col("j")).alias("same"), "a", "b")
    found = cut(alone.union(pairs).mapInArrow(_compare, "vec_id long, links long, head long"))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("linked"))
    release(many)
    components = connected_components(found.where("head <> vec_id").select(F.col("vec_id").alias("a"), F.col("head").alias("b")).distinct())
    named = (classes.select("print", "vec_id", "copies").join(counts, "vec_id", "left").join(components, F.col("vec_id") == F.col("node"), "left")
             .select("print", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    each = members.join(named, "print").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return (rows.select("vec_id").join(each, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("component_id") == F.col("vec_id")))
