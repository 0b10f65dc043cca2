"""Nearest rows and rows within a radius by cells of time and place.

Some row of a probe's own cell, the smallest cell that holds one, bounds its
distance, and the probe meets the rows of the few cells of that size within the
bound. Probes without such a row, near a pole or the date line, or beside a cell
of over ``CROWD`` rows are searched from large cells to small ones: a cell knows
the box of its rows; for a probe a box has a least and a greatest distance. Cells
whose least distance is over the smallest greatest distance hold no nearest row
and are left; the others open into their eighths. What is left of the smallest
cells meets the probe, so work follows the density about a probe and never the
rows of its hour. All joins are equi joins on the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrack.functions.geo import RADIUS_KM, haversine
from veritrack.plans.lineage import cut
from veritrack.plans.stages import once

#: Degrees of the largest cells, how many lie side by side in one of the next size, and how often cells open.
ROOT_DEGREES, FAN, LEVELS = 32.0, 8, 4
#: Degrees of the cells about a probe, from small to large, and the rows of a cell beyond which it is not met whole.
SIDES, CROWD = (1 / 64, 1 / 16, 1 / 4), 256
_KM_A_DEGREE = RADIUS_KM * 3.141592653589793 / 180


def _h(degrees: Column) -> Column:
    return F.pow(F.sin(F.radians(degrees) / 2), F.lit(2.0))


def box_distances(lat: Column, lon: Column, y0: Column, y1: Column, x0: Column, x1: Column) -> tuple[Column, Column]:
    """Bounds of ``sin(d / 2) ** 2`` of a place to what is in a box, also across the antimeridian."""
    below = F.greatest(y0 - lat, lat - y1, F.lit(0.0))
    above = F.greatest(F.abs(y0 - lat), F.abs(y1 - lat))
    a, b = x0 - lon, x1 - lon
    holds = lambda *turns: F.greatest(*[(a <= t) & (b >= t) for t in turns])
    near = F.when(holds(-360, 0, 360), 0.0).otherwise(F.least(_h(a), _h(b)))
    far = F.when(holds(-180, 180), 1.0).otherwise(F.greatest(_h(a), _h(b)))
    c0, c1, c = F.cos(F.radians(y0)), F.cos(F.radians(y1)), F.cos(F.radians(lat))
    wide = F.when((y0 <= 0) & (y1 >= 0), 1.0).otherwise(F.greatest(c0, c1))
    return _h(below) + c * F.least(c0, c1) * near, _h(above) + c * wide * far


_BOX = ("y0", "y1", "x0", "x1", "m0", "m1", "t0", "t1")


def _boxes(rows: DataFrame, y: Column, x: Column, of: dict[str, str]) -> DataFrame:
    """The boxes of ``rows`` by cell; ``of`` names the columns that the bounds come from."""
    return rows.groupBy("_b", y.alias("_y"), x.alias("_x")).agg(*[(F.min if c[1] == "0" else F.max)(of[c]).alias(c) for c in _BOX])


def nearest_rows(probes: DataFrame, rows: DataFrame, id_col: str, window_us: int | None = None, others: bool = False) -> DataFrame:
    """``(id, km, mmsi, lat, lon)`` of the row nearest to each probe; ties go by (vessel, position).

    Without ``window_us`` a probe meets the rows of its ``hour``, else those
    whose ``t`` is at most so far from its own. ``others`` leaves out rows of the
    probe's vessel; a probe without a vessel then meets none. Probes and rows
    without a place are left out, and a probe that meets no row gives none.
    """
    t = F.col("t") if window_us else F.lit(0).cast("long")
    bucket = F.expr(f"(t - pmod(t, {window_us})) div {window_us}") if window_us else F.col("hour")
    placed = rows.where("lat is not null and lon is not null").select(bucket.alias("_b"), t.alias("rt"), F.col("mmsi").alias("m"), F.col("lat").alias("y"), F.col("lon").alias("x")).where("m is not null").repartition("_b", "rt", "y", "x").distinct()
    # of the vessels at one place and time only the first can be nearest, or the second to the first itself
    first = F.row_number().over(Window.partitionBy("_b", "rt", "y", "x").orderBy("m"))
    placed = cut(placed.withColumn("_r", first).where("_r <= 2").drop("_r"))
    asked = probes.where("lat is not null and lon is not null").select(F.col(id_col).alias("id"), t.alias("t"), F.col("lat"), F.col("lon"), (F.col("mmsi") if others else F.lit(None).cast("long")).alias("own"), bucket.alias("_b"))
    if others:
        asked = asked.where("own is not null")
    bounded = cut(_bounded(asked, placed, others))
    tried = cut(_from_own_cells(bounded.where("k is not null"), placed, window_us, others))
    found = tried.where("n is not null").select("id", "n")
    rest = bounded.join(found.select("id").hint("merge"), "id", "left_anti").select(*asked.columns)
    rest = cut(rest)
    if not rest.isEmpty():
        found = found.unionByName(_from_large_cells(rest, placed, window_us, others))
    return found.select(F.col("id").alias(id_col), "n.km", F.col("n.m").alias("mmsi"), F.col("n.y").alias("lat"), F.col("n.x").alias("lon"))


def _bounded(asked: DataFrame, placed: DataFrame, others: bool) -> DataFrame:
    """``asked`` with ``k``, the smallest of the sizes whose cell of the probe holds a row to meet, and ``km``, no less than the least distance; both null without one.

    Rows and probes share one shuffle by the largest cells.
    """
    none = F.lit(None).cast("long")
    both = asked.withColumn("r", F.lit(None).cast("struct<m:bigint,y:double,x:double>")).unionByName(
        placed.select(none.alias("id"), F.col("rt").alias("t"), F.col("y").alias("lat"), F.col("x").alias("lon"), none.alias("own"), "_b", F.struct(F.col("m").cast("long").alias("m"), "y", "x").alias("r")))
    cell = lambda c, k: F.floor(F.col(c) / SIDES[k])
    both = both.withColumn("_u", cell("lat", -1)).withColumn("_v", cell("lon", -1)).repartition("_b", "_u", "_v")
    picks = []
    for k in range(len(SIDES)):
        w = Window.partitionBy("_b", "_u", "_v", f"_y{k}", f"_x{k}")
        both = both.withColumn(f"_y{k}", cell("lat", k)).withColumn(f"_x{k}", cell("lon", k)).withColumn(f"_a{k}", F.min("r").over(w)).withColumn(f"_z{k}", F.max("r").over(w))
        low, high = F.col(f"_a{k}"), F.col(f"_z{k}")
        picks.append(F.when(low["m"] != F.col("own"), low).when(high["m"] != F.col("own"), high) if others else low)
    tame = F.abs("lat") <= 80
    k = F.coalesce(*[F.when(tame & p.isNotNull(), k) for k, p in enumerate(picks)])
    probes = once(both.where("r is null"), k=k, p=F.coalesce(*[F.when(tame, p) for p in picks]))
    return probes.select(*asked.columns, "k", haversine(F.col("lat"), F.col("lon"), F.col("p.y"), F.col("p.x")).alias("km"))


def _from_own_cells(bounded: DataFrame, placed: DataFrame, window_us: int | None, others: bool) -> DataFrame:
    """``(id, n)`` with the nearest row ``n``, null for a probe that would meet a crowded cell or look across the date line."""
    side = F.element_at(F.array(*map(F.lit, SIDES)), F.col("k") + 1)
    # the slack covers rounding of the bounds
    pad = F.col("km") * (1 + 1e-9) / _KM_A_DEGREE + 1e-9
    spots = once(bounded, pad=pad, wide=pad / F.cos(F.radians(F.abs("lat") + pad)), side=side)
    cells = lambda c, by: F.explode(F.sequence(F.floor((F.col(c) - F.col(by)) / F.col("side")), F.floor((F.col(c) + F.col(by)) / F.col("side"))))
    inside = (F.col("lon") - F.col("wide") >= -180) & (F.col("lon") + F.col("wide") <= 180)
    spots = spots.where(inside).withColumn("_y", cells("lat", "pad")).withColumn("_x", cells("lon", "wide"))
    if window_us:
        spots = spots.withColumn("_b", F.explode(F.sequence(F.col("_b") - 1, F.col("_b") + 1)))
    sized = placed.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col("y") / s).alias("_y"), F.floor(F.col("x") / s).alias("_x")) for k, s in enumerate(SIDES)])).alias("c")).select("_b", "rt", "m", "y", "x", "c.*")
    w = Window.partitionBy("_b", "k", "_y", "_x")
    counted = sized.withColumn("held", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("m"))).where((F.col("held") <= CROWD) | (F.col("_r") == 1)).drop("_r")
    met = spots.select("id", "t", "lat", "lon", "own", "_b", "k", "_y", "_x").join(counted.hint("merge"), ["_b", "k", "_y", "_x"])
    crowded = F.col("held") > CROWD
    good = F.lit(True)
    if window_us:
        good &= F.abs(F.col("t") - F.col("rt")) <= window_us
    if others:
        good &= F.col("m") != F.col("own")
    km = haversine(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))
    best = met.where(crowded | good).groupBy("id").agg(F.bool_or(crowded).alias("crowded"), F.min(F.struct(km.alias("km"), "m", "y", "x")).alias("n"))
    return best.select("id", F.when(~F.col("crowded"), F.col("n")).alias("n"))


def _from_large_cells(asked: DataFrame, placed: DataFrame, window_us: int | None, others: bool) -> DataFrame:
    """``(id, n)`` with the nearest row ``n``, by boxes of cells from the largest to the smallest."""
    side = lambda c, k: F.floor(F.col(c) * (FAN**k / ROOT_DEGREES)).cast("long")
    placed = placed.withColumn("_y", side("y", LEVELS - 1)).withColumn("_x", side("x", LEVELS - 1))
    levels = [_boxes(placed, F.col("_y"), F.col("_x"), {"y0": "y", "y1": "y", "x0": "x", "x1": "x", "m0": "m", "m1": "m", "t0": "rt", "t1": "rt"})]
    for _ in range(LEVELS - 1):
        levels.append(_boxes(levels[-1], F.floor(F.col("_y") / FAN), F.floor(F.col("_x") / FAN), {c: c for c in _BOX}))
    if window_us:
        asked = asked.withColumn("_b", F.explode(F.sequence(F.col("_b") - 1, F.col("_b") + 1)))
    probe = F.struct("t", "lat", "lon", "own")
    pairs = asked.join(levels[-1], "_b")
    for k in range(LEVELS - 2, -2, -1):
        low, high = box_distances(F.col("lat"), F.col("lon"), *[F.col(c) for c in _BOX[:4]])
        reached = (F.col("t1") >= F.col("t") - (window_us or 0)) & (F.col("t0") <= F.col("t") + (window_us or 0))
        whole = (F.col("t0") >= F.col("t") - (window_us or 0)) & (F.col("t1") <= F.col("t") + (window_us or 0))
        if others:
            reached &= (F.col("m0") != F.col("own")) | (F.col("m1") != F.col("own"))
        met = once(pairs.where(reached), low=low, high=F.when(whole, high)).select("id", probe.alias("p"), F.struct("low", "_b", "_y", "_x").alias("cell"), "high")
        best = met.groupBy("id").agg(F.first("p").alias("p"), F.min("high").alias("high"), F.collect_list("cell").alias("cells"))
        # the slack covers rounding of the bounds
        left = F.filter("cells", lambda c: F.col("high").isNull() | (c["low"] <= F.col("high") * (1 + 1e-9) + 1e-18))
        opened = best.select("id", "p.*", F.explode(left).alias("c")).select("id", "t", "lat", "lon", "own", "c._b", "c._y", "c._x")
        if k >= 0:
            inner = levels[k].withColumn("_u", F.floor(F.col("_y") / FAN)).withColumn("_v", F.floor(F.col("_x") / FAN))
            pairs = opened.withColumnsRenamed({"_y": "_u", "_x": "_v"}).join(inner, ["_b", "_u", "_v"])
    ends = opened.join(placed, ["_b", "_y", "_x"])
    if window_us:
        ends = ends.where(F.abs(F.col("t") - F.col("rt")) <= window_us)
    if others:
        ends = ends.where("m <> own")
    return ends.groupBy("id").agg(F.min(F.struct(haversine(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")).alias("km"), "m", "y", "x")).alias("n"))


def count_within(probes: DataFrame, rows: DataFrame, id_col: str, radius_km: float, key: str) -> DataFrame:
    """``(id, n)``: how many rows of a probe's ``key`` are at most ``radius_km`` away; 0 where none is.

    A cell whose box lies within the radius adds the number of its rows, one
    whose box lies beyond it adds nothing, and only the others open; pairs are
    made at the rim alone. Probes and rows without a place count nothing.
    """
    side = lambda c: F.floor(F.col(c) * (FAN ** (LEVELS - 1) / ROOT_DEGREES)).cast("long")
    placed = cut(rows.where("lat is not null and lon is not null").select(F.col(key).alias("_b"), F.col("lat").alias("y"), F.col("lon").alias("x")).withColumn("_y", side("y")).withColumn("_x", side("x")))
    box = lambda df, y, x, of, n: df.groupBy("_b", y.alias("_y"), x.alias("_x")).agg(*[(F.min if c[1] == "0" else F.max)(of[c]).alias(c) for c in _BOX[:4]], n.alias("n"))
    levels = [box(placed, F.col("_y"), F.col("_x"), {"y0": "y", "y1": "y", "x0": "x", "x1": "x"}, F.count("*"))]
    for _ in range(LEVELS - 1):
        levels.append(box(levels[-1], F.floor(F.col("_y") / FAN), F.floor(F.col("_x") / FAN), {c: c for c in _BOX[:4]}, F.sum("n")))
    limit = F.pow(F.sin(F.lit(radius_km / RADIUS_KM / 2)), F.lit(2.0))
    asked = probes.where("lat is not null and lon is not null").select(F.col(id_col).alias("id"), "lat", "lon", F.col(key).alias("_b"))
    pairs, parts = asked.join(levels[-1], "_b"), []
    for k in range(LEVELS - 2, -2, -1):
        low, high = box_distances(F.col("lat"), F.col("lon"), *[F.col(c) for c in _BOX[:4]])
        inside = F.col("high") <= limit * (1 - 1e-9)
        met = cut(once(pairs, low=low, high=high).where(F.col("low") <= limit * (1 + 1e-9) + 1e-18).select("id", "lat", "lon", "_b", "_y", "_x", "n", inside.alias("inside")))
        parts.append(met.where("inside").select("id", "n"))
        opened = met.where("not inside").select("id", "lat", "lon", "_b", "_y", "_x")
        if k >= 0:
            inner = levels[k].withColumn("_u", F.floor(F.col("_y") / FAN)).withColumn("_v", F.floor(F.col("_x") / FAN))
            pairs = opened.withColumnsRenamed({"_y": "_u", "_x": "_v"}).join(inner, ["_b", "_u", "_v"])
    rim = opened.join(placed, ["_b", "_y", "_x"]).where(haversine(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")) <= radius_km).select("id", F.lit(1).cast("long").alias("n"))
    for part in parts:
        rim = rim.unionByName(part)
    counts = rim.groupBy("id").agg(F.sum("n").alias("n"))
    return probes.select(F.col(id_col).alias("id")).join(counts, "id", "left").select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n"))


def rows_within(probes: DataFrame, rows: DataFrame, radius_km: float, window_us: int, columns: tuple[str, ...]) -> DataFrame:
    """Pairs of probes and rows at most ``radius_km`` and ``window_us`` apart: ``columns`` of the probe, ``other, rt, y, x, km``.

    A row goes to the cells that the box about it touches, a probe has one cell.
    """
    degrees = max(radius_km / _KM_A_DEGREE, 0.01)
    pad = F.lit(radius_km / _KM_A_DEGREE + 1e-9)
    wide = pad / F.greatest(F.cos(F.radians(F.least(F.abs("y") + pad, F.lit(89.9)))), F.lit(1e-3))
    cells = lambda c, by: F.sequence(F.floor((F.col(c) - by) / degrees), F.floor((F.col(c) + by) / degrees))
    spread = rows.select(F.col("mmsi").alias("other"), F.col("t").alias("rt"), F.col("lat").alias("y"), F.col("lon").alias("x")).where("y is not null and x is not null")
    spread = spread.withColumn("_b", F.expr(f"rt div {window_us}")).withColumn("_y", F.explode(cells("y", pad))).withColumn("_x", F.explode(cells("x", wide)))
    spots = probes.select(*columns, "t", "lat", "lon").withColumn("_y", F.floor(F.col("lat") / degrees)).withColumn("_x", F.floor(F.col("lon") / degrees))
    spots = spots.withColumn("_b", F.explode(F.sequence(F.expr(f"t div {window_us}") - 1, F.expr(f"t div {window_us}") + 1)))
    km = haversine(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))
    met = spots.join(spread, ["_b", "_y", "_x"]).where(F.abs(F.col("t") - F.col("rt")) <= window_us).withColumn("km", km)
    return met.where(F.col("km") <= radius_km).select(*columns, "other", "rt", "y", "x", "km")


def met_within(probes: DataFrame, rows: DataFrame, radius_km: float, window_us: int, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of the probe, ``other, km``: each vessel with a row at most ``radius_km`` and ``window_us`` from a probe, once and with its least distance.

    A probe has one cell and one stretch of time. A row knows the vessel's other
    rows about it, and of those in reach of a probe only the nearest makes the
    pair, so none is shuffled after the join.
    """
    around, span = int(360 / max(radius_km / _KM_A_DEGREE, 0.01)), 2 * window_us
    degrees, pad = 360 / around, F.lit(radius_km / _KM_A_DEGREE + 1e-9)
    stretch = lambda t: F.expr(f"({t} - pmod({t}, {span})) div {span}")
    wide = F.when(F.abs("y") + pad > 89, 180.0).otherwise(F.least(pad / F.cos(F.radians(F.abs("y") + pad)), F.lit(180.0)))
    cells = lambda c, by: F.sequence(F.floor((F.col(c) - by) / degrees), F.floor((F.col(c) + by) / degrees))
    turned = F.array_distinct(F.transform(cells("x", wide), lambda c: F.pmod(c, F.lit(around))))
    placed = rows.select(F.col("mmsi").alias("other"), F.col("t").alias("rt"), F.col("lat").alias("y"), F.col("lon").alias("x")).where("other is not null and rt is not null and y is not null and x is not null").repartition("other").distinct()
    own, own_rows = F.struct("rt", "y", "x"), Window.partitionBy("other").orderBy("rt").rangeBetween(-span, span)
    placed = placed.withColumn("rest", F.collect_list(own).over(own_rows)).withColumn("rest", F.when(F.size("rest") > 1, F.filter("rest", lambda r: r != own)))
    spread = placed.withColumn("_b", F.explode(F.sequence(stretch(f"(rt - {window_us})"), stretch(f"(rt + {window_us})")))).withColumn("_y", F.explode(cells("y", pad))).withColumn("_x", F.explode(turned))
    spots = probes.select(*columns, "t", "lat", "lon", stretch("t").alias("_b"), F.floor(F.col("lat") / degrees).alias("_y"), F.pmod(F.floor(F.col("lon") / degrees), F.lit(around)).alias("_x"))
    soon = lambda rt: F.abs(F.col("t") - rt) <= window_us
    km = lambda y, x: haversine(F.col("lat"), F.col("lon"), y, x)
    met = once(spots.join(spread.hint("merge"), ["_b", "_y", "_x"]).where(soon(F.col("rt"))), km=km(F.col("y"), F.col("x"))).where(F.col("km") <= radius_km)
    nearer = F.exists("rest", lambda r: soon(r["rt"]) & (F.struct(km(r["y"], r["x"]), r["rt"], r["y"], r["x"]) < F.struct("km", "rt", "y", "x")))
    return met.where(F.col("rest").isNull() | ~nearer).select(*columns, "other", "km")
