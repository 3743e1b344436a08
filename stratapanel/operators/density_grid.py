"""Exact density clustering of many settings, and of many spaces, in one pass over shared structures.

All radii and all least neighbour counts go through one plan, whatever their number: a point gets one grid cell per radius,
a cell with as many points as the largest count asks for is settled for all counts, and the neighbours of a point in a
sparse cell are counted once per radius, up to which every smaller count can be read off. What differs between counts
is only which points are cores; the graphs of all settings are contracted together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from stratapanel.operators.components import connected_components
from stratapanel.operators.dbscan import _SLACK, _box, _gap, _norm, _reach, _side
from stratapanel.operators.ranks import running_counts
from stratapanel.session import materialize

#: A node of the graph of a setting is ``setting * _SETTING + number of the point``.
_SETTING = 1 << 40


class _Radii:
    """The positive radii; the first element of a cell is ``space * number of radii + index of the radius``."""

    def __init__(self, eps: Sequence[float], d: int) -> None:
        self.eps, self.d = [float(e) for e in eps], d
        self.sides = [e / math.sqrt(d) * _SLACK for e in self.eps]

    def _at(self, values: Sequence[float], place: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (place % len(values)).cast("int"))

    def radius(self, cell: str) -> Column:
        return self._at(self.eps, F.col(cell)[0])

    def side(self, cell: str) -> Column:
        return self._at(self.sides, F.col(cell)[0])

    def cells(self, points: DataFrame) -> DataFrame:
        """Each point once per radius, with its cell."""
        n = len(self.eps)
        entries = [F.struct(F.lit(i).alias("i"), F.lit(s).alias("side")) for i, s in enumerate(self.sides)]
        rows = points.withColumn("r", F.explode(F.array(*entries)))
        first = (F.col("space") * n + F.col("r.i")).cast("long")
        cell = F.concat(F.array(first), F.transform("x", lambda v: F.floor(v / F.col("r.side")).cast("long")))
        return rows.select("id", "x", cell.alias("cell"))


def _near(cells: DataFrame, radii: _Radii) -> DataFrame:
    """Pairs ``(a, b)`` of cells of one radius whose boxes come within it, each cell with itself too."""
    d = radii.d
    if d <= 3:
        most = int(math.sqrt(d) / _SLACK) + 1
        reach = (math.sqrt(d) / _SLACK) ** 2
        offsets = [o for o in product(range(-most, most + 1), repeat=d) if sum(max(abs(v) - 1, 0) ** 2 for v in o) <= reach]
        shifts = F.array(*[F.array(*[F.lit(v).cast("long") for v in (0, *o)]) for o in offsets])
        aimed = _side(cells, "a").withColumn("__o", F.explode(shifts))
        aimed = aimed.withColumn("b", F.zip_with("a", "__o", lambda x, y: x + y)).drop("__o")
        return aimed.join(_side(cells, "b"), "b").where(_gap(d) <= radii.radius("a")).select("a", "b")
    return _near_by_descent(cells, radii)


def _near_by_descent(cells: DataFrame, radii: _Radii) -> DataFrame:
    """Same pairs in many dimensions: both boxes of a pair are halved until they are cells."""
    d = radii.d
    edges = cells.agg(*[f(F.col("cell")[i + 1]) for f in (F.min, F.max) for i in range(d)]).first()
    if edges[0] is None:
        return cells.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    low, high = edges[:d], edges[d:]
    levels = max(int(h - l) for l, h in zip(low, high)).bit_length()

    def at(level: int) -> Column:
        return F.array(F.col("cell")[0], *[F.shiftright(F.col("cell")[i + 1] - F.lit(low[i]), levels - level) for i in range(d)])

    pairs = None
    for level in range(levels + 1):
        boxes = cells.groupBy(at(level).alias("box"), at(max(level - 1, 0)).alias("up")).agg(*_box(d, "lo", "hi"))
        a, b = (boxes.select(F.col("box").alias(s), F.col("up").alias(f"u{s}"), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi")) for s in "ab")
        if pairs is None:
            met = a.join(b, a.a == b.b)
        else:
            met = pairs.select(F.col("a").alias("ua"), F.col("b").alias("ub")).join(a, "ua").join(b, "ub")
        pairs = materialize(met.where(_gap(d) <= radii.radius("a")).select("a", "b"), "near")
    back = F.array(F.lit(0).cast("long"), *[F.lit(v).cast("long") for v in low])
    return pairs.select(*[F.zip_with(c, back, lambda x, y: x + y).alias(c) for c in "ab"])


def _touching(points: DataFrame, pairs: DataFrame, radii: _Radii) -> DataFrame:
    """Those pairs ``a``, ``b`` of crowded cells that hold two points within their radius, by splitting both cells."""
    d = radii.d
    links, level = pairs.where("false").select("a", "b"), 0
    open_pairs = pairs.select("a", "b", F.col("a").alias("sa"), F.col("b").alias("sb"))
    wanted = pairs.select(F.col("a").alias("cell")).union(pairs.select("b")).distinct()
    inside = materialize(points.join(wanted, "cell", "left_semi"), "points")
    while not open_pairs.isEmpty():
        level += 2
        finer = F.array(*[F.floor(F.col("x")[i] / radii.side("cell") * float(2**level)).cast("long") for i in range(d)])
        parts = inside.groupBy("cell", finer.alias("sub")).agg(*_box(d))
        above = F.transform("sub", lambda v: F.shiftright(v, 2)) if level > 2 else F.col("cell")
        parts = parts.withColumn("up", above)
        left, right = (parts.select(F.col("cell").alias(s), F.col("up").alias(f"s{s}"), F.col("sub").alias(f"n{s}"), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi")) for s in "ab")
        met = open_pairs.join(left, ["a", "sa"]).join(right, ["b", "sb"]).where(_gap(d) <= radii.radius("a"))
        tested = materialize(met.select("a", "b", F.col("na").alias("sa"), F.col("nb").alias("sb"), (_reach(d) <= radii.radius("a")).alias("sure")), "dense")
        found = tested.where("sure").select("a", "b").distinct()
        links = links.union(found)
        open_pairs = tested.where("NOT sure").join(found, ["a", "b"], "left_anti").select("a", "b", "sa", "sb")
    return links


def _exact_places(points: DataFrame, counts: Sequence[int], place: int, n_radii: int) -> DataFrame:
    """Radius 0: points of equal coordinates are a cluster if there are enough of them."""
    spots = points.groupBy("space", F.transform("x", lambda v: v + F.lit(0.0)).alias("spot")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("component"))
    chosen = F.explode(F.array(*[F.lit(m) for m in counts])).alias("m")
    spots = spots.select("*", chosen).where(F.col("n") >= F.col("m"))
    rows = points.withColumn("spot", F.transform("x", lambda v: v + F.lit(0.0))).join(spots, ["space", "spot"])
    return rows.select((F.col("space") * n_radii + place).alias("j"), "m", "id", "component")


def dbscan_many(points: DataFrame, key: str, dims: Sequence[str], eps: Sequence[float], min_pts: Sequence[int], space: str | None = None) -> DataFrame:
    """``(space, key, eps, min_pts, cluster)`` for every setting, as ``dbscan`` gives it for one.

    ``key`` is a unique whole number in each ``space`` (a column of small whole numbers; without it all points are in space
    0, and the column is left out). Points that lack a coordinate are left out. The clusters of a setting are numbered from 1
    by their smallest core key, 0 is noise; a border point joins the cluster of the smallest core key. The number of jobs
    does not depend on the number of settings, and rows grow with points times settings.
    """
    d, counts = len(dims), sorted({int(m) for m in min_pts})
    all_eps = sorted({float(e) for e in eps})
    positive = [e for e in all_eps if e > 0]
    shift, most = len(all_eps) - len(positive), counts[-1]
    x = F.array(*[F.col(c).cast("double") for c in dims])
    in_space = (F.col(space) if space else F.lit(0)).cast("long").alias("space")
    rows = points.dropna(subset=list(dims)).select(in_space, F.col(key).cast("long").alias("key"), x.alias("x"))
    numbers = running_counts(rows.select("key").distinct(), "key", {"n": F.lit(1)}).select("key", F.col("n_below").alias("id"))
    pts = materialize(rows.join(numbers, "key"), "points")
    found = _exact_places(pts, counts, 0, len(all_eps)) if shift else None
    if positive:
        labels = _positive(pts, _Radii(positive, d), counts, most)
        # From the numbering of positive radii to that of all.
        n = len(positive)
        moved = labels.select((F.floor(F.col("j") / n) * len(all_eps) + F.col("j") % n + shift).cast("long").alias("j"), "m", "id", "component")
        found = moved if found is None else found.unionByName(moved)
    found = materialize(found, "labels")
    clusters = running_counts(found.select("j", "m", "component").distinct(), "component", {"n": F.lit(1)}, ["j", "m"])
    numbered = clusters.select("j", "m", "component", (F.col("n_below") + 1).cast("int").alias("cluster"))
    settings = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("eps"), F.lit(m).alias("m")) for i, e in enumerate(all_eps) for m in counts]))
    wanted = pts.select("space", "key", "id", settings.alias("s")).select("space", "key", "id", F.col("s.eps").alias("eps"), F.col("s.m").alias("m"), (F.col("space") * len(all_eps) + F.col("s.i")).alias("j"))
    labelled = wanted.join(found.join(numbered, ["j", "m", "component"]).select("j", "m", "id", "cluster"), ["j", "m", "id"], "left")
    out = [F.col("key").alias(key), "eps", F.col("m").alias("min_pts"), F.coalesce("cluster", F.lit(0)).alias("cluster")]
    return labelled.select(*([F.col("space").alias(space)] if space else []), *out)


def _positive(pts: DataFrame, radii: _Radii, counts: Sequence[int], most: int) -> DataFrame:
    """``(j, m, id, component)`` of the clustered points of all positive radii."""
    d, n_counts = radii.d, len(counts)
    placed = materialize(radii.cells(pts), "placed")
    cells = materialize(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), *_box(d)), "cells")
    near = materialize(_near(cells, radii), "near")
    dense, sparse = cells.where(F.col("n") >= most), cells.where(F.col("n") < most)
    # Per cell: the points of sparse cells near it, fewer than the largest count from each of them.
    few = placed.join(sparse.select("cell"), "cell").groupBy("cell").agg(F.collect_list(F.struct("id", "x")).alias("few"))
    aims = (
        near.join(few.withColumnRenamed("cell", "a"), "a")
        .groupBy(F.col("b").alias("cell"))
        .agg(F.flatten(F.collect_list("few")).alias("few"))
        .join(cells.select("cell", "first", (F.col("n") >= most).alias("dense")), "cell")
    )
    met = placed.join(aims, "cell").select("cell", "id", "x", "first", "dense", F.explode("few").alias("p"))
    close = met.where(_norm([F.col("x")[i] - F.col("p.x")[i] for i in range(d)]) <= radii.radius("cell"))
    unit = F.when(F.col("dense"), F.col("first")).otherwise(F.col("id"))
    hits = materialize(close.groupBy(F.col("cell")[0].alias("j"), F.col("p.id").alias("p"), unit.alias("unit"), "dense").agg(F.count(F.lit(1)).alias("n")), "hits")
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(counts)])

    def node(point: str) -> Column:
        return F.col("s") * F.lit(_SETTING) + F.col(point)

    # Cores of every setting: the count of neighbours settles all least counts at once.
    totals = hits.groupBy("j", "p").agg(F.sum("n").alias("n"))
    setting = (F.col("j") * n_counts + F.col("e.i")).alias("s")
    cores = materialize(totals.select("j", "p", "n", F.explode(every).alias("e")).where(F.col("n") >= F.col("e.m")).select("j", "p", setting), "cores")
    from_core = hits.join(cores, ["j", "p"])
    to_core = from_core.where("dense").select("s", "p", "unit").unionByName(
        from_core.where("NOT dense").select("s", "p", "unit").join(cores.select("s", F.col("p").alias("unit")), ["s", "unit"], "left_semi")
    )
    edges = to_core.select(node("p").alias("a"), node("unit").alias("b"))
    settled = dense.select(F.col("cell")[0].alias("j"), "cell", "first", F.explode(every).alias("e")).select("j", "cell", "first", setting)
    nodes = settled.select(node("first").alias("node")).union(cores.select(node("p").alias("node")))
    pairs = near.join(_side(dense, "a", "first"), "a").join(_side(dense, "b", "first"), "b").where(F.col("a_first") < F.col("b_first"))
    pairs = materialize(pairs.select("a", "b", "a_first", "b_first", F.col("a")[0].alias("j"), (_reach(d) <= radii.radius("a")).alias("sure")), "dense")

    def linked(cell_pairs: DataFrame) -> DataFrame:
        both = cell_pairs.select("j", "a_first", "b_first", F.explode(every).alias("e")).select("a_first", "b_first", setting)
        return both.select(node("a_first").alias("a"), node("b_first").alias("b"))

    labels = connected_components(nodes, edges.unionByName(linked(pairs.where("sure"))))
    # The largest count links least: what it brings together needs no test of its points at any count.
    last = F.col("j") * n_counts + (n_counts - 1)
    inside = [labels.select(F.col("node").alias(f"{s}_node"), F.col("component").alias(f"{s}_in")) for s in "ab"]
    apart = pairs.where("NOT sure").select("*", *[(last * F.lit(_SETTING) + F.col(f"{s}_first")).alias(f"{s}_node") for s in "ab"])
    apart = materialize(apart.join(inside[0], "a_node").join(inside[1], "b_node").where("a_in <> b_in").select("a", "b", "j", "a_first", "b_first"), "apart")
    if not apart.isEmpty():
        touching = materialize(apart.join(_touching(placed, apart, radii), ["a", "b"], "left_semi"), "touching")
        ends = linked(touching)
        moved = ends.join(inside[0], F.col("a") == F.col("a_node")).join(inside[1], F.col("b") == F.col("b_node"))
        heads = labels.select(F.col("component").alias("node")).distinct()
        merged = connected_components(heads, moved.select(F.col("a_in").alias("a"), F.col("b_in").alias("b")))
        final = merged.select(F.col("node").alias("component"), F.col("component").alias("final"))
        labels = materialize(labels.join(final, "component").select("node", F.col("final").alias("component")), "labels")
    of_point = labels.select(F.floor(F.col("node") / _SETTING).cast("long").alias("s"), (F.col("node") % _SETTING).alias("unit"), (F.col("component") % _SETTING).alias("component"))
    by_cell = settled.join(of_point.withColumnRenamed("unit", "first"), ["s", "first"]).select("s", "cell", "component")
    crowded = placed.join(by_cell, "cell").select("s", "id", "component")
    alone = cores.join(of_point.withColumnRenamed("unit", "p"), ["s", "p"]).select("s", F.col("p").alias("id"), "component")
    # Border points: not cores of the setting, near a unit that is one.
    units = of_point.withColumn("j", F.floor(F.col("s") / n_counts).cast("long"))
    reached = hits.join(units, ["j", "unit"]).join(cores.select("s", "p"), ["s", "p"], "left_anti")
    border = reached.groupBy("s", F.col("p").alias("id")).agg(F.min("component").alias("component"))
    all_labels = crowded.unionByName(alone).unionByName(border)
    m = F.get(F.array(*[F.lit(c) for c in counts]), (F.col("s") % n_counts).cast("int"))
    return all_labels.select(F.floor(F.col("s") / n_counts).cast("long").alias("j"), m.alias("m"), "id", "component")
