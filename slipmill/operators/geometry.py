"""Quads (arrays of four points x, y) as native columns: measures, reading order, regions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipmill.functions.patterns import REGION_ASPECT, REGIONS


def corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """The quad of a turned box, from its upper left corner clockwise."""
    def point(sx: int, sy: int) -> Column:
        x, y = w / 2 * sx, h / 2 * sy
        return F.struct((cx + x * F.cos(angle) - y * F.sin(angle)).alias("x"), (cy + x * F.sin(angle) + y * F.cos(angle)).alias("y"))

    return F.array(point(-1, -1), point(1, -1), point(1, 1), point(-1, 1))


def centre(quad: Column) -> Column:
    mean = lambda k: F.aggregate(quad, F.lit(0.0), lambda a, p: a + p[k]) / 4
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def _edge(quad: Column, a: int, b: int) -> tuple[Column, Column]:
    p, q = F.get(quad, a), F.get(quad, b)
    return q["x"] - p["x"], q["y"] - p["y"]


def size(quad: Column) -> Column:
    """struct(w, h): the longer and the shorter of two neighbouring edges."""
    e, f = F.hypot(*_edge(quad, 0, 1)), F.hypot(*_edge(quad, 1, 2))
    return F.struct(F.greatest(e, f).alias("w"), F.least(e, f).alias("h"))


def angle(quad: Column) -> Column:
    """Direction of the more level of two neighbouring edges, folded to a half turn."""
    (ax, ay), (bx, by) = _edge(quad, 0, 1), _edge(quad, 1, 2)
    a, b = F.atan2(ay, ax), F.atan2(by, bx)
    level = F.when(F.abs(a) <= F.abs(b), a).otherwise(b)
    return F.when(level > math.pi / 2, level - math.pi).when(level < -math.pi / 2, level + math.pi).otherwise(level)


def reading_order(quads: Column) -> Column:
    """Indices of quads in reading order. By centre height, a quad joins the last row if it is closer to the row's mean height than half the sum of
    its own height and the row's mean x (the long-standing rule, kept as it is); rows are read by centre x; ties by index."""
    items = F.array_sort(F.transform(quads, lambda q, i: F.struct(centre(q)["y"].alias("cy"), i.alias("i"), centre(q)["x"].alias("cx"), size(q)["h"].alias("h"))))
    state = F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sy"), F.lit(0.0).alias("sx"), F.array().cast("array<struct<row:int,cx:double,i:int>>").alias("out"))

    def step(s: Column, q: Column) -> Column:
        joins = (s["n"] > 0) & (F.abs(q["cy"] - s["sy"] / F.greatest(s["n"], F.lit(1.0))) < (q["h"] + s["sx"] / F.greatest(s["n"], F.lit(1.0))) / 2)
        row = F.when(joins, s["row"]).otherwise(s["row"] + 1)
        kept = lambda x, new: F.when(joins, x + new).otherwise(new)
        return F.struct(row.alias("row"), kept(s["n"], F.lit(1.0)).alias("n"), kept(s["sy"], q["cy"]).alias("sy"), kept(s["sx"], q["cx"]).alias("sx"),
                        F.concat(s["out"], F.array(F.struct(row.alias("row"), q["cx"].alias("cx"), q["i"].alias("i")))).alias("out"))

    ordered = F.transform(F.array_sort(F.aggregate(items, state, step, lambda s: s["out"])), lambda o: o["i"])
    return F.when(F.size(quads) <= 1, F.transform(quads, lambda _, i: i)).otherwise(ordered)


def in_regions(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Whether a centre lies in a region that holds fields; upright images have no regions and keep all."""
    inside = F.lit(False)
    for rx, ry, rw, rh in REGIONS:
        inside = inside | ((x / width).between(rx, rx + rw) & (y / height).between(ry, ry + rh))
    return (width / height <= REGION_ASPECT) | inside
