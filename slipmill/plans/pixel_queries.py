"""Registered queries of pixels and tensors over the embeddings as 8 x 8 gray images, and of boxes in an image's pixels, with SQL in the same arithmetic."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipmill.operators import geometry, images, lines, maps
from slipmill.plans.render import table
from slipmill.plans.vision_queries import _COMPONENTS, MEAN, THRESHOLD

#: Sizes and places that the queries ask for.
WIDTH, HEIGHT, LIMIT, FIXED, TURNED = 13, 5, 6, (4, 40), (16, 24)
CENTRE_X, CENTRE_Y, CUT_W, CUT_H, ANGLE = 3.25, 4.5, 6, 5, 0.5
SCALE_X, SCALE_Y, OFFSET_X, OFFSET_Y = 2.0, 3.0, 0.5, 0.25


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and image: a byte of 0 to 200 for each value of an embedding."""
    bytes_ = F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(F.floor((v.cast("double") + 1) * 100).cast("int")), 2, "0")), ""))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.lit(8).alias("width"), F.lit(8).alias("height"), bytes_.alias("pixels")).alias("image"))


def resized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("vec_id", F.lower(F.hex(images.resize(F.col("image"), F.lit(WIDTH), F.lit(HEIGHT))["pixels"])).alias("pixels"))


def rotated_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut of every image around a place between pixels, level for even ids and turned for odd ones."""
    angle = F.when(F.col("vec_id") % 2 == 0, 0.0).otherwise(ANGLE)
    part = images.rotated_crop(F.col("image"), F.lit(CENTRE_X), F.lit(CENTRE_Y), F.lit(CUT_W), F.lit(CUT_H), angle)
    return _images(spark, sf_dir).select("vec_id", F.lower(F.hex(part["pixels"])).alias("pixels"))


def _sums(make) -> Column:
    """kind, h, w, and for each channel the sum of a tensor, of the tensors that make gives of an image as (kind, tensor)."""

    @F.pandas_udf("array<struct<kind:string,n:int,h:int,w:int,c0:double,c1:double,c2:double>>")
    def run(image: pd.DataFrame) -> pd.Series:
        out = []
        for i in image.to_dict("records"):
            found = []
            for kind, t in make(images.pixels(i)):
                t = t if t.ndim == 4 else t[None]
                found.append((kind, t.shape[0], *t.shape[2:], *t.astype("float64").sum(axis=(0, 2, 3)).tolist()))
            out.append([dict(zip(("kind", "n", "h", "w", "c0", "c1", "c2"), f, strict=True)) for f in found])
        return pd.Series(out)

    return run("image")


def image_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and sums of the tensors of every image: detection, shrunk and padded or of a fixed size; recognition, as wide as asked or of a fixed width; orientation; a batch of two lines of
    different width."""

    def make(a):
        line = images.resized(a, 20, lines.HEIGHT)
        yield "detection", images.detection_tensor(a, LIMIT)[0]
        yield "detection fixed", images.detection_tensor(a, LIMIT, FIXED)[0]
        yield "recognition", images.recognition_tensor(a, lines.HEIGHT, lines.MAX_WIDTH)
        yield "recognition fixed", images.recognition_tensor(a, lines.HEIGHT, 64, fixed=True)
        yield "orientation", images.orientation_tensor(a, *TURNED)
        yield "batch", images.stacked([images.resized(a, 48, lines.HEIGHT), line], lines.HEIGHT)

    each = _images(spark, sf_dir).select("vec_id", _sums(make).alias("t")).select("vec_id", F.explode("t").alias("t"))
    return each.select("vec_id", "t.kind", "t.n", "t.h", "t.w", *(F.round(f"t.c{k}", 2).alias(f"c{k}") for k in range(3)))


def map_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and sides of the grown boxes of every map, in the image's pixels."""
    m = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("map_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("scores"))
    found = maps.boxes(m, THRESHOLD, MEAN, SCALE_X, SCALE_Y, OFFSET_X, OFFSET_Y)
    centre, side = geometry.centre(F.col("quad")), lambda a, b, c: F.abs(F.get("quad", a)[c] - F.get("quad", b)[c])
    return found.select("map_id", "label", F.round(centre["x"], 3).alias("x"), F.round(centre["y"], 3).alias("y"), F.round(side(0, 2, "x"), 3).alias("across"), F.round(side(0, 2, "y"), 3).alias("down"))


QUERIES = {f.__name__: f for f in (resized_images, rotated_crops, image_tensors, map_boxes)}

_PIXELS = "e as (select vec_id, i // 8 as y, i % 8 as x, cast(floor((embedding[i + 1]::double + 1) * 100) as int) as v from embeddings, range(0, 64) r(i))"


def _scaled(name: str, of: str, size: int, n: int, axis: str) -> str:
    """A table like of (vec_id, y, x, v) with n places along an axis in place of size, in single precision."""
    other = "y" if axis == "x" else "x"
    if n == size:
        return f"{name} as (select * from {of})"
    at = lambda k: f"l[1 + greatest(0, least({size - 1}, low + {k}))]::real * w{k}"
    return f"""{name}_l as (select vec_id, {other}, list(v order by {axis}) as l from {of} group by 1, 2),
        {name}_c as (select i, (i::real + 0.5::real) * {size / n!r}::double::real - 0.5::real as c from range(0, {n}) r(i)),
        {name}_w as (select i, low, {', '.join(f"greatest(0::real, 1::real - abs(c - (low + {k})::real)) as w{k}" for k in range(3))} from (select *, cast(floor(c) as int) as low from {name}_c)),
        {name} as (select vec_id, {other}, i as {axis}, cast(floor((({at(0)} + {at(1)}) + {at(2)}) / ((w0 + w1) + w2)) as int) as v from {name}_l, {name}_w)"""


def _resized(name: str, w: int, h: int) -> str:
    return _scaled(f"{name}_x", "e", 8, w, "x") + ", " + _scaled(name, f"{name}_x", 8, h, "y")


def _tensor(kind: str, of: str, h: int, w: int, mean: tuple = (0.5,) * 3, deviation: tuple = (0.5,) * 3, n: int = 1) -> str:
    sums = ", ".join(f"round(sum(((v::real / 255::real - {m!r}::real) / {d!r}::real)::double), 2) as c{k}" for k, (m, d) in enumerate(zip(mean, deviation, strict=True)))
    return f"select vec_id, '{kind}' as kind, {n} as n, {h} as h, {w} as w, {sums} from {of} where y < {h} and x < {w} group by vec_id"


ORACLE_SQL = {
    "resized_images": f"with {_PIXELS}, {_resized('r', WIDTH, HEIGHT)} select vec_id, string_agg(lpad(lower(to_hex(v)), 2, '0'), '' order by y, x) as pixels from r group by vec_id",
    "rotated_crops": f"""with {_PIXELS}, d as (select i % {CUT_W} - {CUT_W / 2}::real as dx, i // {CUT_W} - {CUT_H / 2}::real as dy, i from range(0, {CUT_W * CUT_H}) r(i)),
        a as (select vec_id, cos(case when vec_id % 2 = 0 then 0 else {ANGLE} end::double)::real as c, sin(case when vec_id % 2 = 0 then 0 else {ANGLE} end::double)::real as s, list(v order by y, x) as l from e group by vec_id),
        p as (select vec_id, i, l, ({CENTRE_X}::real + dx::real * c) + dy::real * s as sx, ({CENTRE_Y}::real - dx::real * s) + dy::real * c as sy from a, d),
        q as (select vec_id, i, l, sx >= 0 and sy >= 0 and sx <= 7 and sy <= 7 as inside, cast(floor(sx) as int) as x0, cast(floor(sy) as int) as y0, sx::double - floor(sx) as dx, sy::double - floor(sy) as dy from p),
        v as (select vec_id, i, case when inside then cast(floor(((l[1 + y0 * 8 + x0] * (1 - dx) * (1 - dy) + l[1 + y0 * 8 + least(7, x0 + 1)] * dx * (1 - dy)) + l[1 + least(7, y0 + 1) * 8 + x0] * (1 - dx) * dy)
              + l[1 + least(7, y0 + 1) * 8 + least(7, x0 + 1)] * dx * dy) as int) else 0 end as v from q)
        select vec_id, string_agg(lpad(lower(to_hex(v)), 2, '0'), '' order by i) as pixels from v group by vec_id""",
    "image_tensors": f"with {_PIXELS}, {_resized('small', LIMIT, LIMIT)}, {_resized('cut', LIMIT, FIXED[0])}, {_resized('line', 48, 48)}, {_resized('turned', TURNED[1], TURNED[0])}, {_resized('narrow', 20, 48)}, "
        + "both_ as (select * from line union all select * from narrow), t as ("
        + " union all ".join((_tensor("detection", "small", 32, 32, images.MEAN, images.DEVIATION), _tensor("detection fixed", "cut", *FIXED, images.MEAN, images.DEVIATION), _tensor("recognition", "line", 48, 48),
                              _tensor("recognition fixed", "line", 48, 64), _tensor("orientation", "turned", *TURNED), _tensor("batch", "both_", 48, 48, n=2))) + ") select * from t",
    "map_boxes": _COMPONENTS + f""", k as (select * from s where n >= 3 and mean >= {MEAN}),
        t as (select k.vec_id, k.label, a, c.x * cos(radians(a)) + c.y * sin(radians(a)) as u, c.y * cos(radians(a)) - c.x * sin(radians(a)) as v
              from k join l on l.vec_id = k.vec_id and l.first = k.first join c on c.vec_id = l.vec_id and c.i = l.i, range(0, 180) r(a)),
        z as (select vec_id, label, a, min(u) as l, max(u) as r, min(v) as t, max(v) as b, round((max(u) - min(u)) * (max(v) - min(v)), 9) as area from t group by 1, 2, 3),
        f as (select *, row_number() over (partition by vec_id, label order by area, a) as k from z),
        g as (select vec_id, label, cos(radians(a)) as c, sin(radians(a)) as s, (l + r) / 2 as mx, (t + b) / 2 as my, (r - l) * {maps.GROWTH} as w, (b - t) * {maps.GROWTH} as h from f where k = 1)
        select vec_id as map_id, cast(label as int) as label, round((mx * c - my * s - {OFFSET_X}) * {SCALE_X}, 3) as x, round((mx * s + my * c - {OFFSET_Y}) * {SCALE_Y}, 3) as y,
          round(abs(w * c - h * s) * {SCALE_X}, 3) as across, round(abs(w * s + h * c) * {SCALE_Y}, 3) as down from g""",
}
