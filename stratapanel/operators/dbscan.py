"""Exact density clustering without listing the pairs of a crowded neighbourhood.

The grid side is eps / sqrt(d), so the points of one cell are all neighbours. A cell with at least
``min_pts`` points ("dense") holds only core points of one cluster and none of its pairs is ever
formed. A point is compared only with the fewer than ``min_pts`` points of each sparse cell near
it, which keeps the work linear in the points (Gunawan 2013, Gan & Tao 2015). Two dense cells are
joined by comparing tight boxes of ever smaller parts of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from stratapanel.operators.components import connected_components
from stratapanel.operators.ranks import running_counts
from stratapanel.session import materialize

_SLACK = 1 - 1e-9


def _norm(parts: Sequence[Column]) -> Column:
    return F.sqrt(reduce(Column.__add__, [p * p for p in parts]))


def _gap(d: int) -> Column:
    """Least distance between boxes ``a`` and ``b`` of a row."""
    return _norm(
        [
            F.greatest(F.col("b_lo")[i] - F.col("a_hi")[i], F.col("a_lo")[i] - F.col("b_hi")[i], F.lit(0.0))
            for i in range(d)
        ]
    )


def _reach(d: int) -> Column:
    """Largest distance between boxes ``a`` and ``b`` of a row."""
    return _norm(
        [F.greatest(F.col("b_hi")[i] - F.col("a_lo")[i], F.col("a_hi")[i] - F.col("b_lo")[i]) for i in range(d)]
    )


def _box(d: int, lo: str = "x", hi: str = "x") -> list[Column]:
    return [
        F.array(*[F.min(F.col(lo)[i]) for i in range(d)]).alias("lo"),
        F.array(*[F.max(F.col(hi)[i]) for i in range(d)]).alias("hi"),
    ]


def _side(cells: DataFrame, name: str, *extra: str) -> DataFrame:
    return cells.select(F.col("cell").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("lo", "hi", *extra)])


def near_cells(cells: DataFrame, d: int, side: float, eps: float) -> DataFrame:
    """Pairs ``(a, b)`` of occupied cells whose boxes come within eps, each cell with itself too."""
    if d > 3:
        return _near_cells_by_descent(cells, d, eps)
    most = int(eps / side) + 1
    offsets = [
        o
        for o in product(range(-most, most + 1), repeat=d)
        if sum((max(abs(v) - 1, 0) * side) ** 2 for v in o) <= eps * eps
    ]
    shifts = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in offsets])
    aimed = _side(cells, "a").withColumn("__o", F.explode(shifts))
    aimed = aimed.withColumn("b", F.zip_with("a", "__o", lambda x, y: x + y)).drop("__o")
    return aimed.join(_side(cells, "b"), "b").where(_gap(d) <= eps).select("a", "b")


def _near_cells_by_descent(cells: DataFrame, d: int, eps: float) -> DataFrame:
    """Same pairs in many dimensions: halve both boxes of a pair until they are cells.

    Only occupied boxes meet, and only while they are within reach.
    """
    edges = cells.agg(
        F.array(*[F.min(F.col("cell")[i]) for i in range(d)]), F.array(*[F.max(F.col("cell")[i]) for i in range(d)])
    ).first()
    if edges[0] is None:
        return cells.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    levels = max(int(h - l) for l, h in zip(*edges)).bit_length()

    def at(level: int) -> Column:
        return F.array(*[F.shiftright(F.col("cell")[i] - F.lit(edges[0][i]), levels - level) for i in range(d)])

    pairs = None
    for level in range(levels + 1):
        boxes = cells.groupBy(at(level).alias("box"), at(max(level - 1, 0)).alias("up")).agg(*_box(d, "lo", "hi"))
        a = boxes.select(F.col("box").alias("a"), F.col("up").alias("ua"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
        b = boxes.select(F.col("box").alias("b"), F.col("up").alias("ub"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
        if pairs is None:
            met = a.join(b, a.a == b.b)
        else:
            up = pairs.select(F.col("a").alias("ua"), F.col("b").alias("ub"))
            met = up.join(a, "ua").join(b, "ub")
        pairs = materialize(met.where(_gap(d) <= eps).select("a", "b"), "near")
    back = F.array(*[F.lit(v).cast("long") for v in edges[0]])
    return pairs.select(*[F.zip_with(c, back, lambda x, y: x + y).alias(c) for c in ("a", "b")])


def _dense_pairs(dense: DataFrame, near: DataFrame, d: int, eps: float) -> DataFrame:
    """Near pairs of dense cells; ``sure`` where the boxes lie within eps as a whole."""
    pairs = (
        near.join(_side(dense, "a", "first"), "a")
        .join(_side(dense, "b", "first"), "b")
        .where(F.col("a_first") < F.col("b_first"))
    )
    return pairs.select("a", "b", "a_first", "b_first", (_reach(d) <= eps).alias("sure"))


def _open_links(points: DataFrame, pairs: DataFrame, d: int, side: float, eps: float) -> DataFrame:
    """Those of the pairs of dense cells that hold two points within eps of each other.

    Both cells are split in quarters per dimension: parts entirely within eps settle a pair, parts
    further apart drop out, the rest is split again. A part of one distinct point is always
    settled, so the splitting ends.
    """
    names = pairs.select("a", "b", "a_first", "b_first")
    links, level = names.where("false").select("a", "b"), 0
    open_pairs = pairs.select("a", "b", F.col("a").alias("sa"), F.col("b").alias("sb"))
    wanted = pairs.select(F.col("a").alias("cell")).union(pairs.select("b")).distinct()
    inside = materialize(points.join(wanted, "cell", "left_semi"), "points")
    while not open_pairs.isEmpty():
        level += 2
        finer = F.array(*[F.floor(F.col("x")[i] / side * float(2**level)).cast("long") for i in range(d)])
        parts = (
            inside.groupBy("cell", finer.alias("sub"))
            .agg(*_box(d))
            .withColumn("up", F.transform("sub", lambda v: F.shiftright(v, 2)))
        )
        left = parts.select(*[F.col(c).alias(n) for c, n in (("cell", "a"), ("up", "sa"), ("sub", "na"), ("lo", "a_lo"), ("hi", "a_hi"))])
        right = parts.select(*[F.col(c).alias(n) for c, n in (("cell", "b"), ("up", "sb"), ("sub", "nb"), ("lo", "b_lo"), ("hi", "b_hi"))])
        met = open_pairs.join(left, ["a", "sa"]).join(right, ["b", "sb"]).where(_gap(d) <= eps)
        tested = materialize(
            met.select("a", "b", F.col("na").alias("sa"), F.col("nb").alias("sb"), (_reach(d) <= eps).alias("sure")), "dense"
        )
        found = tested.where("sure").select("a", "b").distinct()
        links = links.union(found)
        open_pairs = tested.where("NOT sure").join(found, ["a", "b"], "left_anti").select("a", "b", "sa", "sb")
    return names.join(links, ["a", "b"], "left_semi").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))


def _core_components(
    points: DataFrame, nodes: DataFrame, edges: DataFrame, pairs: DataFrame, d: int, side: float, eps: float
) -> DataFrame:
    """Components of core units. Sure links come first; a pair of dense cells they have not yet
    brought together is then tested in detail."""
    sure = pairs.where("sure").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    labels = connected_components(nodes, edges.unionByName(sure))
    ends = [labels.select(F.col("node").alias(f"{s}_first"), F.col("component").alias(f"{s}_in")) for s in "ab"]
    apart = pairs.where("NOT sure").join(ends[0], "a_first").join(ends[1], "b_first").where("a_in <> b_in")
    apart = materialize(apart, "apart")
    if apart.isEmpty():
        return labels
    # One detailed test is enough for two components, but which cells meet is not known: test all.
    extra = _open_links(points, apart.select("a", "b", "a_first", "b_first"), d, side, eps)
    heads = labels.select(F.col("component").alias("node")).distinct()
    renamed = extra.withColumnsRenamed({"a": "a_first", "b": "b_first"}).join(ends[0], "a_first").join(ends[1], "b_first")
    merged = connected_components(heads, renamed.select(F.col("a_in").alias("a"), F.col("b_in").alias("b")))
    final = merged.select(F.col("node").alias("component"), F.col("component").alias("final"))
    return materialize(labels.join(final, "component").select("node", F.col("final").alias("component")), "labels")


def _numbered(components: DataFrame) -> DataFrame:
    """``(component, cluster)`` with clusters numbered from 1 by their smallest core key."""
    ranked = running_counts(components.select("component").distinct(), "component", {"n": F.lit(1)})
    return ranked.select("component", (F.col("n_below") + 1).cast("int").alias("cluster"))


def dbscan(points: DataFrame, key: str, dims: Sequence[str], eps: float, min_pts: int, out: str = "cluster") -> DataFrame:
    """``(key, cluster)`` for points complete in ``dims``; 0 is noise.

    ``key`` is a unique whole number. A point counts as its own neighbour. A border point within
    reach of several clusters joins the one with the smallest core key.
    """
    d = len(dims)
    x = F.array(*[F.col(c).cast("double") for c in dims])
    side = eps / math.sqrt(d) * _SLACK
    if eps > 0:
        cell = F.array(*[F.floor(F.col("x")[i] / side).cast("long") for i in range(d)])
    else:
        cell = F.transform("x", lambda v: v + F.lit(0.0))
    rows = points.dropna(subset=list(dims)).select(F.col(key).cast("long").alias("id"), x.alias("x"))
    pts = materialize(rows.withColumn("cell", cell), "points")
    cells = materialize(
        pts.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), *_box(d)), "cells"
    )
    dense, sparse = cells.where(F.col("n") >= min_pts), cells.where(F.col("n") < min_pts)
    if eps > 0:
        near = materialize(near_cells(cells, d, side, eps), "near")
        few = (
            pts.join(sparse.select("cell"), "cell")
            .groupBy("cell")
            .agg(F.collect_list(F.struct("id", "x")).alias("few"))
        )
        # Per cell: the points of sparse cells near it, at most min_pts - 1 from each of them.
        aims = (
            near.join(few.withColumnRenamed("cell", "a"), "a")
            .groupBy(F.col("b").alias("cell"))
            .agg(F.flatten(F.collect_list("few")).alias("few"))
            .join(cells.select("cell", "first", (F.col("n") >= min_pts).alias("dense")), "cell")
        )
        met = pts.join(aims, "cell").select("id", "x", "first", "dense", F.explode("few").alias("p"))
        close = met.where(_norm([F.col("x")[i] - F.col("p.x")[i] for i in range(d)]) <= eps)
        unit = F.when(F.col("dense"), F.col("first")).otherwise(F.col("id"))
        hits = materialize(
            close.groupBy(F.col("p.id").alias("p"), unit.alias("unit"), "dense").agg(F.count(F.lit(1)).alias("n")), "hits"
        )
        totals = hits.groupBy("p").agg(F.sum("n").alias("n"))
        cores = materialize(totals.where(F.col("n") >= min_pts).select("p"), "cores")
        from_core = hits.join(cores, "p", "left_semi")
        to_core = from_core.where("dense").unionByName(
            from_core.where("NOT dense").join(cores.select(F.col("p").alias("unit")), "unit", "left_semi")
        )
        edges = to_core.select(F.col("p").alias("a"), F.col("unit").alias("b"))
        nodes = dense.select(F.col("first").alias("node")).union(cores.select(F.col("p").alias("node")))
        pairs = materialize(_dense_pairs(dense, near, d, eps), "dense")
        components = _core_components(pts, nodes, edges, pairs, d, side, eps)
        border = (
            hits.join(cores, "p", "left_anti")
            .join(components.withColumnRenamed("node", "unit"), "unit")
            .groupBy("p")
            .agg(F.min("component").alias("component"))
        )
        singles = cores.join(components.withColumnRenamed("node", "p"), "p").unionByName(border)
    else:
        components = dense.select(F.col("first").alias("node"), F.col("first").alias("component"))
        singles = components.where("false").withColumnRenamed("node", "p")
    numbers = _numbered(components)
    by_cell = (
        dense.select("cell", F.col("first").alias("node")).join(components, "node").join(numbers, "component")
        .select("cell", F.col("cluster").alias("__c"))
    )
    by_point = singles.join(numbers, "component").select(F.col("p").alias("id"), F.col("cluster").alias("__p"))
    labelled = pts.select("id", "cell").join(by_cell, "cell", "left").join(by_point, "id", "left")
    return labelled.select(F.col("id").alias(key), F.coalesce("__c", "__p", F.lit(0)).alias(out))
