"""Near-duplicate documents by one-permutation MinHash (operator 7).

A document's set holds the hashes of its distinct five-word shingles. Sketches
come from one-permutation hashing with optimal densification: the top bits of a
shingle's hash choose one of ``BINS`` bins, the least hash in a bin is its
value, and each empty bin takes the value of a bin that a universal hash picks
by trial, the same trials for every document. ``ROWS`` consecutive bins make a
band. In each bucket of a band the member of least hash is the centre of a star
of candidate edges, so a bucket of n members gives n - 1 pairs. Pairs whose
sketches agree well enough are confirmed on the full sets. The members of each
bucket that then still holds several components are compared in blocks, all
pairs of two components once over all bands, so nothing that shares a bucket is
left out; from two blocks comes a star for each linked group, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrack.llm.kernels import blocks, mix, shingle_sets, slices, utf8
from veritrack.plans.components import connected_components
from veritrack.plans.lineage import cut, release

BINS, ROWS = 128, 4
#: Members of a block of a mixed bucket; a pair of blocks is one unit of comparison.
BLOCK = 512
#: Shingles whose places in the sets of two blocks are counted at once.
SPAN = 4096
#: No pair is asked for more agreement of its sketches than this share of the bins.
SKETCH_FLOOR = 0.5

_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def _trials(n: int = 1024) -> np.ndarray:
    """For each bin the bins that it tries when empty."""
    bins, turn = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(1, n + 1, dtype=np.uint64), indexing="ij")
    return (mix(bins * np.uint64(1_000_003) + turn * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64)


_TRIALS = _trials()


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of a sorted, non-empty set of hashes."""
    bins = (shingles >> _SHIFT).astype(np.int64)
    first = np.concatenate(([True], bins[1:] != bins[:-1]))
    values = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    values[bins[first]] = shingles[first]
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        hit = full[_TRIALS[empty]]
        at = hit.argmax(1)
        source = np.where(hit.any(1), _TRIALS[empty, at], bins[0])
        values[empty] = values[source]
    return values


def agreement_floor(n: np.ndarray) -> np.ndarray:
    """The share of bins on which sketches of linked sets must agree, the smaller of ``n`` shingles.

    Six deviations below 0.75, counting only the bins that ``n`` shingles are
    expected to fill and a quarter more variance for those that densification
    repeats; so small sets are asked for little or nothing, and a linked pair
    falls below with a chance of about 1e-9 at any size.
    """
    filled = BINS * (1 - np.exp(-np.asarray(n, np.float64) / BINS))
    return np.clip(0.75 - 6 * np.sqrt(0.75 * 0.25 * 1.25 / np.maximum(filled, 1e-9)), 0, SKETCH_FLOOR)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1024):
        ids, sizes, prints, bands, sketches = batch.column(0), [], [], [], []
        for s in shingle_sets(utf8(batch.column(1))):
            sizes.append(len(s))
            if not len(s):
                prints.append(None), bands.append(None), sketches.append(None)
                continue
            values = sketch(s)
            keys = np.zeros(BINS // ROWS, np.uint64)
            for j in range(ROWS):
                keys = keys * np.uint64(0xC2B2AE3D27D4EB4F) + values[j::ROWS]
            keys = mix(keys + np.arange(len(keys), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            bands.append(keys.view(np.int64))
            sketches.append((mix(values) & np.uint64(255)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            ["doc_id", "n_shingles", "print", "bands", "sketch"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose one-byte sketches agree on enough bins."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a = np.frombuffer(b"".join(batch.column("sketch_a").to_pylist()), np.uint8).reshape(-1, BINS)
        b = np.frombuffer(b"".join(batch.column("sketch_b").to_pylist()), np.uint8).reshape(-1, BINS)
        keep = (a == b).mean(1) >= agreement_floor(np.minimum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full shingle sets have 100 |A and B| >= 75 |A or B|."""
    for batch in batches:
        left, right = utf8(batch.column("text_a")), utf8(batch.column("text_b"))
        keep = []
        for at, part in blocks(left, 1 << 20):
            other = right[at : at + len(part)]
            for x, y in zip(shingle_sets(part), shingle_sets(other), strict=True):
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same > 0 and 100 * same >= 75 * (len(x) + len(y) - same))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _stars(members: DataFrame) -> DataFrame:
    """``(bucket, doc_id, centre)`` for each bucket's members but its centre, the first in one order for all buckets."""
    centre = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("doc_id"), "doc_id")).alias("c"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("c.doc_id").alias("centre"))
    return members.join(centre.hint("merge"), "bucket").where("doc_id <> centre").select("bucket", "doc_id", "centre")


def _side(members: pa.Array):
    """Ids, components, bands, sketches and set sizes of a block's members."""
    ids, parts, bands, sketches, sizes = members.flatten()
    return ids.to_numpy(), parts.to_numpy(), bands.flatten().to_numpy().reshape(len(ids), -1), np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(len(ids), -1), sizes.to_numpy()


def open_pairs(bucket: int, a, b) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs of two components that share no earlier band and whose sketches agree on enough bins."""
    left = a[1][:, None] != b[1][None, :]
    for k in range(int(np.flatnonzero(a[2][0] == bucket)[0])):
        left &= a[2][:, k][:, None] != b[2][:, k][None, :]
    p, q = np.nonzero(left)
    keep = np.zeros(len(p), bool)
    for at in range(0, len(p), 1 << 16):
        part = slice(at, at + (1 << 16))
        floor = agreement_floor(np.minimum(a[4][p[part]], b[4][q[part]]))
        keep[part] = (a[3][p[part]] == b[3][q[part]]).mean(1) >= floor
    return p[keep], q[keep]


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of open pairs, a tile for each pair of blocks: ``side`` is 1 for the first block, 2 for the second, 3 for both."""
    for batch in batches:
        for n in range(batch.num_rows):
            bucket, i, j = (batch[c][n].as_py() for c in ("bucket", "i", "j"))
            a, b = (_side(batch[side].slice(n, 1).flatten()) for side in ("a", "b"))
            p, q = open_pairs(bucket, a, b)
            ids = np.concatenate([a[0][np.unique(p)], b[0][np.unique(q)]])
            sides = np.repeat(np.array([1, 2], np.int32), [len(np.unique(p)), len(np.unique(q))])
            if i == j:
                ids, sides = np.unique(ids), np.full(len(np.unique(ids)), 3, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), v), t) for v, t in ((bucket, pa.int64()), (i, pa.int32()), (j, pa.int32()))] + [pa.array(sides), pa.array(ids)], ["bucket", "i", "j", "side", "doc_id"])


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets of ``left`` have 100 |A and B| >= 75 |A or B| with which of ``right``; none is empty."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)

    def places(sets):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
        known = common[at] == values if len(common) else np.zeros(len(values), bool)
        order = np.argsort(at[known], kind="stable")
        return rows[known][order], at[known][order]

    def filled(rows, at, low, n):
        part = slice(*np.searchsorted(at, [low, low + SPAN]))
        m = np.zeros((n, SPAN), np.float32)
        m[rows[part], at[part] - low] = 1
        return m

    a, b = places(left), places(right)
    same = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, len(common), SPAN):
        same += (filled(*a, low, len(left)) @ filled(*b, low, len(right)).T).astype(np.int64)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return (same > 0) & (100 * same >= 75 * (sizes - same))


def _tile(rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, heads)``: each linked document of a tile but the least of its group, and that least."""
    sets = list(shingle_sets([text for _, _, text in rows]))
    left, right = ([n for n, r in enumerate(rows) if r[0] & bit] for bit in (1, 2))
    p, q = np.nonzero(linked([sets[n] for n in left], [sets[n] for n in right]))
    p, q = np.array(left)[p], np.array(right)[q]
    ids = np.array([r[1] for r in rows], np.int64)
    heads = ids.copy()
    while True:
        low = heads.copy()
        np.minimum.at(low, p, heads[q])
        np.minimum.at(low, q, heads[p])
        if (low == heads).all():
            return ids[heads != ids], heads[heads != ids]
        heads = low


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``(a, b)`` of the tiles, whose rows come one after another."""
    rows: list[tuple[int, int, bytes]] = []
    now = None

    def done():
        ids, heads = _tile(rows)
        return pa.RecordBatch.from_arrays([pa.array(heads), pa.array(ids)], ["a", "b"])

    for batch in batches:
        keys = zip(*(batch[c].to_pylist() for c in ("bucket", "i", "j")), strict=True)
        for key, *row in zip(keys, batch["side"].to_pylist(), batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
            if key != now and rows:
                yield done()
                rows.clear()
            now = key
            rows.append(tuple(row))
    if rows:
        yield done()


def _within(spots: DataFrame, heads: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that join the components of ``spots(bucket, doc_id, part)`` wherever two members in a bucket are linked.

    The largest component of a bucket has blocks of its own, which are not
    compared with each other, so that a large group costs what meets it.
    """
    parts = spots.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    sizes = cut(parts.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
                .select("bucket", F.col("m.part").alias("largest"), F.when(F.col("n") > BLOCK, F.ceil(F.col("m.n") / BLOCK)).otherwise(0).cast("int").alias("own"),
                        F.when(F.col("n") > BLOCK, F.ceil((F.col("n") - F.col("m.n")) / BLOCK)).otherwise(1).cast("int").alias("other")))
    salt = F.xxhash64("doc_id")
    block = F.when((F.col("part") == F.col("largest")) & (F.col("own") > 0), F.pmod(salt, "own")).otherwise(F.col("own") + F.pmod(salt, "other")).cast("int")
    member = F.struct("doc_id", "part", "bands", "sketch", "n_shingles")
    dealt = spots.join(sizes.hint("merge"), "bucket").select("bucket", "doc_id", "part", "own", "other", block.alias("block"))
    blocks = dealt.join(heads.select("doc_id", "bands", "sketch", "n_shingles"), "doc_id").groupBy("bucket", "block", "own", "other").agg(F.collect_list(member).alias("members"))
    alone = blocks.where("own + other = 1").select("bucket", F.col("block").alias("i"), F.col("block").alias("j"), F.col("members").alias("a"), F.col("members").alias("b"))
    many = cut(blocks.where("own + other > 1"))
    first = many.select("bucket", F.col("block").alias("i"), F.explode(F.sequence(F.greatest("block", "own"), F.col("own") + F.col("other") - 1)).alias("j"), F.col("members").alias("a"))
    pairs = first.join(many.select("bucket", F.col("block").alias("j"), F.col("members").alias("b")), ["bucket", "j"]).select("bucket", "i", "j", "a", "b")
    tiles = cut(alone.union(pairs).mapInArrow(_open, "bucket long, i int, j int, side int, doc_id long"))
    told = tiles.join(texts, "doc_id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = cut(told.select("bucket", "i", "j", "side", "doc_id", "text").mapInArrow(_tiles, "a long, b long").distinct())
    release(sizes, many, tiles)
    return found


def _ends(star: DataFrame) -> DataFrame:
    return star.select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()


def _confirm(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sketches and then whose full sets agree."""
    side = lambda s: sketches.select(F.col("doc_id").alias(s), F.col("sketch").alias(f"sketch_{s}"), F.col("n_shingles").alias(f"n_{s}"))
    text = lambda s: texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}"))
    near = cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(_agreeing, "a long, b long"))
    found = cut(near.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a long, b long"))
    release(near)
    return found


def _named(rows: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """Replaces documents by the least of their component so far."""
    for c in columns:
        known = labels.select(F.col("doc_id").alias(c), F.col("component").alias("_to"))
        rows = rows.join(known, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return rows


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components after ``links`` are added to those of ``labels(doc_id, component)``."""
    joined = connected_components(_named(links, labels, "a", "b").distinct()).select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = labels.join(joined, "component", "left").select("doc_id", F.coalesce("to", "component").alias("component"))
    fresh = joined.select(F.col("component").alias("doc_id"), F.col("to").alias("component")).join(labels, "doc_id", "left_anti")
    return cut(moved.union(fresh))


def minhash_near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text)``.

    Returns ``doc_id, n_shingles, component_id, kept`` with one row for each
    row of ``docs``. Equal sets are folded into their least ``doc_id`` first.
    Null or empty texts and texts without words have no shingles, link with
    nothing and are kept. Rows with a null ``doc_id`` are left out, as they
    cannot be named; rows that repeat a ``doc_id`` keep one row each in the
    result. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sketches = cut(docs.mapInArrow(_sketches, "doc_id long, n_shingles long, print binary, bands array<long>, sketch binary"))
    # one shuffle finds each class of equal sets and its least document; copies fold before it
    heads = cut(sketches.where("n_shingles > 0").groupBy("print").agg(F.min(F.struct("doc_id", "bands", "sketch", "n_shingles")).alias("h")).select("print", "h.*"))
    classes = heads.select("print", F.col("doc_id").alias("class_id"))
    members = heads.select(F.explode("bands").alias("bucket"), "doc_id")
    # the first turn: one star a bucket, and components of what it confirms
    star = cut(_stars(members))
    met = star.select(F.explode(F.array("doc_id", "centre")).alias("doc_id")).distinct()
    texts = cut(docs.join(met.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    ends = cut(_ends(star))
    first = _confirm(ends, heads, texts)
    release(ends)
    labels = cut(connected_components(first).withColumnRenamed("node", "doc_id"))
    # every other pair that shares a bucket and not yet a component; centres have met all of theirs
    spots = cut(_named(star.select("bucket", "doc_id", F.col("doc_id").alias("part")), labels, "part").select("bucket", "doc_id", "part"))
    release(star)
    found = _within(spots, heads, texts)
    release(spots, texts)
    labels = _merge(labels, found)
    named = classes.join(labels, F.col("class_id") == F.col("doc_id"), "left").select("print", F.coalesce("component", "class_id").alias("component"))
    return (sketches.select("doc_id", "n_shingles", "print").join(named, "print", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))
