"""Score maps (map_id, h, w, scores as an array in raster order): cells over a threshold, their components, boxes around these."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmill.functions.dialect import let
from slipmill.operators.graph import components as components_of
from slipmill.operators.graph import kept
from slipmill.operators.images import Room

#: Score over which a cell counts, least cells and least mean score of a component, growth of its box.
CELL, LEAST_CELLS, LEAST_MEAN, GROWTH = 0.3, 3, 0.5, 1.5
#: For what does not leave the functions of this module.
_ROOM = Room()


def cells(maps: DataFrame, threshold: float = CELL) -> DataFrame:
    """map_id, y, x and p of every cell whose score is over the threshold."""
    at = maps.select("map_id", "w", F.posexplode("scores").alias("at", "p")).where(F.col("p") > threshold)
    return at.select("map_id", F.floor(F.col("at") / F.col("w")).cast("int").alias("y"), (F.col("at") % F.col("w")).cast("int").alias("x"), "p")


def nearest(scores: Column, h: Column, w: Column, to_h: int, to_w: int) -> Column:
    """A map resampled to another size by its nearest cell; the same cells if the size is the same."""
    place = lambda i: F.least(F.floor(F.floor(i / to_w) * h / to_h), h - 1) * w + F.least(F.floor((i % to_w) * w / to_w), w - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(to_h * to_w - 1)), lambda i: F.get(scores, place(i).cast("int")))


def runs(mask: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and end (one past the last column) of every run of at least so many true cells in a row, in raster order."""
    h, w = mask.shape
    wide = _ROOM("wide", bool)(h, w + 2)
    wide[:, 0] = wide[:, -1] = False
    wide[:, 1:-1] = mask
    flat = wide.reshape(-1)
    turn = np.flatnonzero(np.not_equal(flat[1:], flat[:-1], out=_ROOM("turn", bool)(max(flat.size - 1, 0))))  # into a run and out of it by turns, as rows begin and end outside
    start, end = turn[::2], turn[1::2]
    if least > 1:
        long = end - start >= least
        start, end = start[long], end[long]
    row = start // (w + 2)
    return row, start - row * (w + 2), end - row * (w + 2)


def _rooted_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """runs() of a map and, for each, the raster index of the first cell of its 8-neighbour component. Runs are joined with those that touch them in the row above;
    a run's root is the earliest of its component."""
    w = mask.shape[1]
    row, start, end = runs(mask)
    above, touch = row * (w + 2) + start, row * (w + 2) + end
    low = np.searchsorted(touch, (row - 1) * (w + 2) + start, side="left")
    high = np.searchsorted(above, (row - 1) * (w + 2) + end, side="right")
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(row)), many)
    b = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    root = np.arange(len(row))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(step := root[root], root):
            root = step
    return row, start, end, (row * w + start)[root]


def _labels(mask: np.ndarray) -> np.ndarray:
    """For each cell the raster index of the first cell of its 8-neighbour component, -1 outside."""
    out = np.full(mask.shape, -1)
    _, start, end, first = _rooted_runs(mask)
    out[mask] = np.repeat(first, end - start)
    return out


def component_cells(scores: np.ndarray, h: int, w: int, threshold: float = CELL) -> list[dict]:
    """n, mean and cells (raster indices) of every component of one map, by first cell. Runs are sorted by component, not cells."""
    if not h or not w or len(scores) < h * w:
        return []
    row, start, end, first = _rooted_runs(np.greater(scores[: h * w].reshape(h, w), np.float32(threshold), out=_ROOM("over", bool)(h, w)))
    order = np.argsort(first, kind="stable")
    first, size = first[order], (end - start)[order]
    upto = np.cumsum(size)
    at = (np.repeat((row * w + start)[order] - (upto - size), size) + np.arange(size.sum())).astype(np.int32)
    found, end = scores[at].astype(np.float64), [*upto[np.flatnonzero(np.diff(first))].tolist(), len(at)]
    return [{"n": e - s, "mean": float(found[s:e].mean()), "cells": at[s:e]} for s, e in zip([0, *end[:-1]], end, strict=True) if e > s]


def hull(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corners of the convex hull of cells, by monotone chains over the outermost cells of each row: they have the same extents in every direction."""
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    ends = np.append(np.flatnonzero(np.diff(y)), len(y) - 1)
    starts = np.append(0, ends[:-1] + 1)
    rows = y[starts].tolist()

    def chain(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    left = chain([(-a, b) for a, b in zip(x[starts].tolist(), rows, strict=True)])
    right = chain(list(zip(x[ends].tolist(), rows, strict=True)))
    corners = {(-a, b) for a, b in left} | set(right)
    found = np.array(sorted(corners, key=lambda c: (c[1], c[0])), np.float64)
    return found[:, 0], found[:, 1]


#: Up to so many rows, finding the hull takes longer than it saves.
FEW_ROWS = 64
_DEGREES = np.arange(180)
_COS, _SIN = np.cos(np.radians(_DEGREES))[:, None], np.sin(np.radians(_DEGREES))[:, None]


def least_box(cells: np.ndarray, width: int) -> dict:
    """smallest_box() of one component's cells (in raster order), with NumPy over the outermost cells of few rows, or the corners of the hull of many: both have the
    extents of all cells in every direction."""
    counted = cells[:: max(len(cells) // 500, 1)]
    y, x = np.divmod(counted, width)
    first = np.flatnonzero(np.diff(y, prepend=-1))  # cells stand row by row
    if len(first) <= FEW_ROWS:
        ends = np.concatenate([first, np.append(first[1:], len(y)) - 1])
        x, y = x[ends], y[ends]
    else:
        x, y = hull(x, y)
    u, v = x * _COS + y * _SIN, y * _COS - x * _SIN
    left, right, top, bottom = u.min(axis=1), u.max(axis=1), v.min(axis=1), v.max(axis=1)
    w, h = right - left, bottom - top
    area = np.round(w * h, 9)
    a = int(np.argmin(area))
    mx, my, c, s = (left[a] + right[a]) / 2, (top[a] + bottom[a]) / 2, _COS[a, 0], _SIN[a, 0]
    return {"area": float(area[a]), "a": a, "w": float(w[a]), "h": float(h[a]), "cx": float(mx * c - my * s), "cy": float(mx * s + my * c)}


def kept_boxes(maps: DataFrame, threshold: float = CELL, least_mean: float = LEAST_MEAN) -> DataFrame:
    """map_id, label, n, mean and box (least_box) of components of enough cells and a high enough mean. A map is one row, so nothing is shuffled, and
    cells do not leave the task."""
    box = pa.struct([("area", pa.float64()), ("a", pa.int32()), *((c, pa.float64()) for c in ("w", "h", "cx", "cy"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, heights, widths, scores = batch.columns
            out: list[tuple] = []
            for k in range(batch.num_rows):
                h, w = heights[k].as_py(), widths[k].as_py()
                found = component_cells(np.asarray(scores[k].values, np.float32), h, w, threshold) if scores[k].is_valid else []
                out += [(ids[k].as_py(), label, c["n"], c["mean"], least_box(c["cells"], w)) for label, c in enumerate(found, 1) if c["n"] >= LEAST_CELLS and c["mean"] >= least_mean]
            columns = zip(*out, strict=True) if out else ((),) * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), box)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["map_id", "label", "n", "mean", "box"])

    return maps.select("map_id", "h", "w", "scores").mapInArrow(run, "map_id long, label int, n long, mean double, box struct<area:double,a:int,w:double,h:double,cx:double,cy:double>")


def components(maps: DataFrame, threshold: float = CELL) -> DataFrame:
    """map_id, label (number of the component in raster order of first cells, from 1), at (raster index) and p. A map is one row and stays where it is."""
    schema = "map_id long, label int, at int, p float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, heights, widths, scores = batch.columns
            for k in range(batch.num_rows):
                map_id, h, w = ids[k].as_py(), heights[k].as_py(), widths[k].as_py()
                p = np.asarray(scores[k].values, np.float32) if scores[k].is_valid else np.zeros(0, np.float32)
                if not h or not w or len(p) < h * w:
                    continue
                first = _labels(p[: h * w].reshape(h, w) > np.float32(threshold)).reshape(-1)
                at = np.flatnonzero(first >= 0)
                if len(at):
                    label = np.unique(first[at], return_inverse=True)[1] + 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), map_id), pa.int64()), pa.array(label, pa.int32()), pa.array(at, pa.int32()), pa.array(p[at])],
                                                     names=["map_id", "label", "at", "p"])

    return maps.select("map_id", "h", "w", "scores").mapInArrow(run, schema)


def tiles(maps: DataFrame, size: int) -> DataFrame:
    """map_id, y, x (of the tile's first cell), h and w (of the tile), mw (width of the map) and scores of every tile of size x size cells, those at the lower and right ends smaller."""
    corner = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.col("h") - 1, F.lit(0)), F.lit(size)), lambda y: F.transform(F.sequence(F.lit(0), F.greatest(F.col("w") - 1, F.lit(0)), F.lit(size)), lambda x: F.struct(y.alias("y"), x.alias("x"))))))
    whole = maps.where((F.col("h") > 0) & (F.col("w") > 0) & (F.size("scores") >= F.col("h") * F.col("w")))
    at = whole.select("map_id", F.col("h").alias("mh"), F.col("w").alias("mw"), "scores", corner.alias("c"))
    h, w = F.least(F.lit(size), F.col("mh") - F.col("c.y")), F.least(F.lit(size), F.col("mw") - F.col("c.x"))
    rows = F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda r: F.slice("scores", (F.col("c.y") + r) * F.col("mw") + F.col("c.x") + 1, w)))
    return at.select("map_id", F.col("c.y").alias("y"), F.col("c.x").alias("x"), h.alias("h"), w.alias("w"), "mw", rows.alias("scores"))


def tiled_components(parts: DataFrame, threshold: float = CELL) -> DataFrame:
    """components() of maps that are cut to tiles (the columns of tiles()), for maps that are too large for a task. A tile's components are labelled in one task by the place of their
    first cell in the map; those that touch over the tiles' edges are joined by their edge cells, so only runs on edges are shuffled and joined; ``graph.components`` makes
    them one. Labels are those of the map as one piece. Empty and null tiles have no cells."""
    found = kept(_in_tiles(parts, threshold))
    edge = found.where("edge").select("map_id", "first", "y", "x")
    near = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    right = edge.select(F.col("map_id").alias("m2"), F.col("first").alias("f2"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    reach = edge.select("map_id", "first", "y", "x", near.alias("d")).select("map_id", "first", (F.col("y") + F.col("d.dy")).alias("y2"), (F.col("x") + F.col("d.dx")).alias("x2"))
    touch = reach.join(right, [reach["map_id"] == right["m2"], reach["y2"] == right["y2"], reach["x2"] == right["x2"]]).where("first <> f2")
    node = lambda c: F.struct("map_id", F.col(c).alias("first"))
    joined = components_of(touch.select(node("first").alias("a"), node("f2").alias("b"))).select(F.col("node.map_id").alias("map_id"), F.col("node.first").alias("first"), F.col("least.first").alias("root"))
    rooted = found.join(joined, ["map_id", "first"], "left").select("map_id", F.coalesce("root", "first").alias("root"), "at", "p")
    numbered = rooted.select("map_id", "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy("map_id").orderBy("root")))
    return rooted.join(numbered, ["map_id", "root"]).select("map_id", "label", "at", "p")


def _in_tiles(parts: DataFrame, threshold: float) -> DataFrame:
    """map_id, first (place of the first cell of the tile's component in the map), at (place in the map), y, x, p and edge (whether it lies on the tile's edge) of every cell over the threshold."""
    names = ["map_id", "first", "at", "y", "x", "p", "edge"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ys, xs, heights, widths, across, scores = batch.columns
            for k in range(batch.num_rows):
                h, w, width = heights[k].as_py(), widths[k].as_py(), across[k].as_py()
                if not scores[k].is_valid or not h or not w:
                    continue
                p = np.asarray(scores[k].values, np.float32)[: h * w]
                first = _labels(p.reshape(h, w) > np.float32(threshold)).reshape(-1)
                at = np.flatnonzero(first >= 0)
                y, x, fy, fx = at // w, at % w, first[at] // w, first[at] % w
                edge = (y == 0) | (x == 0) | (y == h - 1) | (x == w - 1)
                y0, x0 = ys[k].as_py(), xs[k].as_py()
                place = lambda a, b: pa.array((a + y0).astype(np.int64) * width + b + x0)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids[k].as_py()), pa.int64()), place(fy, fx), place(y, x), pa.array(y + y0), pa.array(x + x0), pa.array(p[at]), pa.array(edge)], names=names)

    return parts.select("map_id", "y", "x", "h", "w", "mw", "scores").mapInArrow(run, "map_id long, first long, at long, y long, x long, p float, edge boolean")


def kept_components(maps: DataFrame, threshold: float = CELL, least_mean: float = LEAST_MEAN) -> DataFrame:
    """map_id, label, n, mean and cells (raster indices in order) of components of enough cells and a high enough mean."""
    grouped = components(maps, threshold).groupBy("map_id", "label").agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.array_sort(F.collect_list("at")).alias("cells"))
    return grouped.where((F.col("n") >= LEAST_CELLS) & (F.col("mean") >= least_mean))


def smallest_box(cells: Column, width: Column) -> Column:
    """struct(area, a, w, h, cx, cy): the least box around the cells at whole degrees a from 0 to 179; of equal ones the first. Every k-th cell
    counts, k one for each 500 cells."""
    step = F.greatest(F.floor(F.size(cells) / 500), F.lit(1))
    points = F.transform(F.filter(cells, lambda _, i: i % step == 0), lambda c: F.struct((c % width).cast("double").alias("x"), F.floor(c / width).cast("double").alias("y")))
    return let(points, _around)


def _around(points: Column) -> Column:
    def ends(a: Column) -> Column:
        turn = F.struct(a.alias("a"), F.cos(F.radians(a.cast("double"))).alias("c"), F.sin(F.radians(a.cast("double"))).alias("s"))

        def spans(k: Column) -> Column:
            both = F.struct(F.transform(points, lambda p: p["x"] * k["c"] + p["y"] * k["s"]).alias("u"), F.transform(points, lambda p: p["y"] * k["c"] - p["x"] * k["s"]).alias("v"))
            return let(both, lambda z: F.struct(k.alias("k"), F.array_min(z["u"]).alias("l"), F.array_max(z["u"]).alias("r"), F.array_min(z["v"]).alias("t"), F.array_max(z["v"]).alias("b")))

        return let(turn, spans)

    def box(e: Column) -> Column:
        w, h, mx, my, c, s = e["r"] - e["l"], e["b"] - e["t"], (e["l"] + e["r"]) / 2, (e["t"] + e["b"]) / 2, e["k"]["c"], e["k"]["s"]
        return F.struct(F.round(w * h, 9).alias("area"), e["k"]["a"].alias("a"), w.alias("w"), h.alias("h"), (mx * c - my * s).alias("cx"), (mx * s + my * c).alias("cy"))

    return F.array_min(F.transform(F.transform(F.sequence(F.lit(0), F.lit(179)), ends), box))


def summary(maps: DataFrame, threshold: float = CELL, least_mean: float = LEAST_MEAN) -> DataFrame:
    """A row a size of map: h, w, maps, cells, boxes (components that are kept), least, largest and mean score. Each map becomes one small row in its task, and these add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heights, widths, scores = batch.columns
            out = []
            for k in range(batch.num_rows):
                p = np.asarray(scores[k].values, np.float32) if scores[k].is_valid else np.zeros(0, np.float32)
                found = component_cells(p, heights[k].as_py() or 0, widths[k].as_py() or 0, threshold)
                boxes_ = sum(c["n"] >= LEAST_CELLS and c["mean"] >= least_mean for c in found)
                out.append((heights[k].as_py(), widths[k].as_py(), len(p), boxes_, *((float(p.min()), float(p.max()), float(p.sum(dtype=np.float64))) if len(p) else (None, None, 0.0))))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 7, kinds, strict=True)], names=["h", "w", "cells", "boxes", "least", "largest", "total"])

    each = maps.select("h", "w", "scores").mapInArrow(run, "h int, w int, cells long, boxes long, least double, largest double, total double")
    return each.groupBy("h", "w").agg(F.count("*").alias("maps"), F.sum("cells").alias("cells"), F.sum("boxes").alias("boxes"), F.min("least").alias("least"), F.max("largest").alias("largest"),
                                      F.try_divide(F.sum("total"), F.sum("cells")).alias("mean"))


def boxes(maps: DataFrame, threshold: float = CELL, least_mean: float = LEAST_MEAN, scale_x: float = 1.0, scale_y: float = 1.0,
          offset_x: float = 0.0, offset_y: float = 0.0) -> DataFrame:
    """map_id, label and quad (four corners in the image's pixels: less the offset, times the scale) of every kept component, its box grown about the
    centre."""
    from slipmill.operators.geometry import corners

    box = kept_boxes(maps, threshold, least_mean).withColumnRenamed("box", "b")
    quad = corners(F.col("b.cx"), F.col("b.cy"), F.col("b.w") * GROWTH, F.col("b.h") * GROWTH, F.radians(F.col("b.a").cast("double")))
    return box.select("map_id", "label", F.transform(quad, lambda p: F.struct(((p["x"] - offset_x) * scale_x).alias("x"), ((p["y"] - offset_y) * scale_y).alias("y"))).alias("quad"))
