"""Embedding whitening by exact covariance (operator 12).

Entries become integers, ``floor(SCALE * c) + SHIFT``. Sums over all vectors
centre them without rounding: with ``n`` vectors of sums ``S`` the centred
vector is ``n x - S``, an integer. Its digits of ``DIGIT`` bits are small enough
that float64 matrix products over ``ROWS`` rows are exact; the products of digit
planes are put together as big integers, summed over all tasks, and only then
divided and decomposed into eigenvectors.

The passes over the table are: sums, products, projection. What reaches the
driver is a row for each dimension and one for each pair of dimensions; it
depends on the vectors' length, never on their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrack.plans.lineage import cut

SCALE, SHIFT, COMPONENTS = 1024.0, 100_000, 8
#: ``ROWS`` products of two digits add up to 2**53 at most, where float64 is still exact.
DIGIT, ROWS = 20, 8192
#: Blocks whose products, of up to 2**53 each, add up in 64 bits.
FLUSH = 512
#: Bits of the parts in which big sums travel; 2**22 tasks can be summed in 64 bits.
PART = 40
#: Components whose eigenvalue is a smaller share of the greatest are rounding, not directions.
LEAST_SHARE = 1e-11
#: Larger entries are in no long.
_LARGEST = 2.0**62


class Centre(NamedTuple):
    """How many vectors there are, their sums, and the largest difference within a dimension."""

    n: int
    sums: list[int]
    spread: int


def integer_vectors(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer vectors of ``batch(embedding)`` by length, at most ``rows`` at once.

    Null and empty vectors and those with an entry that is null, not finite or
    in no long are left out.
    """
    column = batch.column("embedding")
    starts = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(starts))
    for size in np.unique(sizes[sizes > 0]):
        of_size = np.flatnonzero(sizes == size)
        for part in (of_size[i : i + rows] for i in range(0, len(of_size), rows)):
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = flat[starts[part][:, None] + np.arange(size)].astype(np.float64) * SCALE
                good = (np.abs(scaled) < _LARGEST).all(1)
            if good.any():
                yield part[good], np.floor(scaled[good]).astype(np.int64) + SHIFT


def centred(x: np.ndarray, centre: Centre) -> np.ndarray:
    """``n x - S``; of Python's integers where 64 bits are too few."""
    if centre.n * centre.spread < 1 << 62:  # products may wrap around, the difference doesn't
        wrap = lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63)
        return x * np.int64(wrap(centre.n)) - np.array([wrap(s) for s in centre.sums], np.int64)
    return x.astype(object) * centre.n - np.array(centre.sums, object)


def digits(y: np.ndarray, bound: int) -> np.ndarray:
    """Digit planes of ``y`` side by side as float64, lowest first, for ``abs(y) <= bound``; the highest carries the sign."""
    planes = bound.bit_length() // DIGIT + 1
    low = [(y >> DIGIT * k) & ((1 << DIGIT) - 1) for k in range(planes - 1)]
    return np.concatenate([p.astype(np.float64) for p in [*low, y >> DIGIT * (planes - 1)]], axis=1)


def recombined(products: np.ndarray, size: int) -> np.ndarray:
    """The big-integer product of vectors from the products of their digit planes."""
    planes, total = len(products) // size, np.zeros((size, size), object)
    for k in range(planes):
        for m in range(planes):
            total += products[k * size : (k + 1) * size, m * size : (m + 1) * size].astype(object) << DIGIT * (k + m)
    return total


def _sum_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, list] = {}
    for batch in batches:
        for _, x in integer_vectors(batch):
            have = seen.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object), x[0].copy(), x[0].copy()])
            have[0] += len(x)
            have[1] += ((x >> 31).sum(0).astype(object) << 31) + (x & (1 << 31) - 1).sum(0).astype(object)
            have[2], have[3] = np.minimum(have[2], x.min(0)), np.maximum(have[3], x.max(0))
    for size, (n, sums, low, high) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(list(map(Decimal, sums)), pa.decimal128(38, 0)), pa.array(low), pa.array(high)], ["size", "i", "n", "total", "low", "high"])


def _product_pass(centres):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact: dict[int, np.ndarray] = {}
        open_: dict[int, list] = {}

        def close(size: int) -> None:
            products, _ = open_.pop(size)
            exact[size] = exact.get(size, 0) + recombined(products, size)

        for batch in batches:
            for _, x in integer_vectors(batch):
                size, centre = x.shape[1], centres.value[x.shape[1]]
                z = digits(centred(x, centre), centre.n * centre.spread)
                have = open_.setdefault(size, [np.zeros((z.shape[1], z.shape[1]), np.int64), 0])
                have[0] += (z.T @ z).astype(np.int64)
                have[1] += 1
                if have[1] == FLUSH:
                    close(size)
        for size in list(open_):
            close(size)
        for size, total in exact.items():
            i, j = np.triu_indices(size)
            rest, part = total[i, j], 0
            while True:
                last = max(map(abs, rest)) < 1 << PART
                value = rest if last else rest & (1 << PART) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), part), pa.int32()), pa.array(value.astype(np.int64))], ["size", "i", "j", "part", "value"])
                if last:
                    break
                rest, part = rest >> PART, part + 1

    return run


class Axes(NamedTuple):
    """Unit eigenvectors as columns, the roots of their eigenvalues and their shares of the trace."""

    vectors: np.ndarray
    roots: np.ndarray
    explained: np.ndarray


def principal_axes(products: dict[tuple[int, int], int], centre: Centre, most: int) -> Axes:
    """Axes by falling eigenvalue of the covariance ``products / n**3``; each entry is rounded once."""
    size = len(centre.sums)
    v = np.zeros((size, size))
    for (i, j), total in products.items():
        v[i, j] = v[j, i] = total / centre.n**3
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > LEAST_SHARE * max(values[-1], 0.0)]
    trace = sum(products[i, i] for i in range(size)) / centre.n**3
    return Axes(np.ascontiguousarray(vectors[:, order]), np.sqrt(values[order]), values[order] / trace if trace else values[order])


def _project_pass(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in integer_vectors(batch):
                centre, axes = plan.value[x.shape[1]]
                y = centred(x, centre)
                bound = centre.n * centre.spread
                square = y * y if bound * bound * x.shape[1] < 1 << 63 else y.astype(object) ** 2
                deviation = [Decimal(d) if d < 10**38 else None for d in square.sum(1).tolist()]
                w = (y.astype(np.float64) / centre.n) @ axes.vectors / axes.roots
                k = w.shape[1]
                offsets = pa.array(np.arange(len(w) + 1) * k, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.ravel())) for v in (w, np.broadcast_to(axes.explained, w.shape))]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(w), x.shape[1]), pa.int32()), pa.array(np.full(len(w), centre.n)), pa.array(deviation, pa.decimal128(38, 0)), *lists], ["vec_id", "size", "n", "deviation", "whitened", "explained"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for ``vectors(vec_id, embedding)``.

    A row for each vector and each of its first ``components`` components, or
    fewer if the vectors span fewer. Vectors that are null or empty, hold null
    or non-finite entries, or entries over 2**62 / 1024, are dropped and are no
    part of the fit. Each length of vectors is a population of its own, with its
    own ``n``. ``deviation`` is a decimal, null beyond 38 digits;
    ``identity_error`` is measured on the whitened rows. Equal vectors of one
    value alone span nothing and give no rows. Null and repeated ids are kept,
    other columns ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    only = rows.select("embedding")
    sums = (only.mapInArrow(_sum_pass, "size int, i int, n long, total decimal(38,0), low long, high long").groupBy("size", "i")
            .agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")))
    centres = {}
    for r in sums.orderBy("size", "i").collect():
        c = centres.get(r["size"]) or Centre(r.n, [], 0)
        centres[r["size"]] = Centre(r.n, [*c.sums, int(r.total)], max(c.spread, r.high - r.low))
    products: dict[int, dict] = {size: {} for size in centres}
    parts = (only.mapInArrow(_product_pass(spark.sparkContext.broadcast(centres)), "size int, i int, j int, part int, value long")
             .groupBy("size", "i", "j", "part").agg(F.sum("value").alias("value")))
    for r in parts.toArrow().to_pylist():
        own = products[r["size"]]
        own[r["i"], r["j"]] = own.get((r["i"], r["j"]), 0) + (r["value"] << PART * r["part"])
    plan = spark.sparkContext.broadcast({size: (c, principal_axes(products[size], c, components)) for size, c in centres.items()})
    held = cut(rows.mapInArrow(_project_pass(plan), "vec_id long, size int, n long, deviation decimal(38,0), whitened array<double>, explained array<double>"))
    w = lambda i: F.get("whitened", F.lit(i))
    most = [F.max(F.size("whitened")).alias("k"), F.count("*").alias("m"), *[F.sum(w(i)).alias(f"s{i}") for i in range(components)]]
    moments = held.groupBy("size").agg(*most, *[F.sum(w(i) * w(j)).alias(f"p{i}_{j}") for i in range(components) for j in range(i + 1)])
    off = lambda i, j: F.abs(F.col(f"p{i}_{j}") / F.col("m") - F.col(f"s{i}") / F.col("m") * F.col(f"s{j}") / F.col("m") - float(i == j))
    # a row for each length of vectors
    errors = moments.select("size", F.array_max(F.array(F.lit(0.0), *[off(i, j) for i in range(components) for j in range(i + 1)])).alias("identity_error"))
    each = held.join(errors, "size").select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error")
