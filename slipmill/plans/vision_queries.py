"""Registered queries of the map, geometry, sequence and line operators over the embeddings (8 x 8 maps) and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipmill.functions.patterns import REGION_ASPECT, REGIONS
from slipmill.operators import geometry, images, lines, maps, sequences
from slipmill.plans.render import table

THRESHOLD, MEAN = 0.1, 0.15
CHARACTERS = ["a", "b", "", "d", "e", "f"]


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("map_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("scores"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", sequences.steps(F.col("embedding"), 8, 8).alias("s"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box a line item: centre, sides and place on a 1000 x 700 page."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("doc_id"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("box_id"), c("l_linenumber").alias("idx"), (c("l_partkey") % 97 * 10 + 5).cast("double").alias("cx"),
        (c("l_suppkey") % 83 * 8 + 3).cast("double").alias("cy"), (c("l_quantity") * 2 + 1).cast("int").alias("w"), (c("l_linenumber") * 3 + 2).cast("int").alias("h"))


def score_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.cells(_maps(spark, sf_dir), THRESHOLD).select("map_id", "y", "x", F.round(F.col("p").cast("double"), 6).alias("p"))


def score_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = maps.nearest(F.col("scores"), F.col("h"), F.col("w"), 4, 3)
    return _maps(spark, sf_dir).select("map_id", F.posexplode(small).alias("at", "p")).select("map_id", "at", F.round(F.col("p").cast("double"), 6).alias("p"))


def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.components(_maps(spark, sf_dir), THRESHOLD).groupBy("map_id", "label").agg(
        F.min("at").alias("first"), F.count("*").alias("n"), F.round(F.avg(F.col("p").cast("double")), 5).alias("mean"))


def tiled_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_components of maps that are cut to tiles of 3 x 3 cells."""
    found = maps.tiled_components(maps.tiles(_maps(spark, sf_dir), 3), THRESHOLD)
    return found.groupBy("map_id", "label").agg(F.min("at").cast("int").alias("first"), F.count("*").alias("n"), F.round(F.avg(F.col("p").cast("double")), 5).alias("mean"))


def map_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a size of map: maps, cells, boxes that are kept, least, largest and mean score."""
    return maps.summary(_maps(spark, sf_dir), THRESHOLD, MEAN).select("h", "w", "maps", "cells", "boxes", *(F.round(c, 5).alias(c) for c in ("least", "largest", "mean")))


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p").cast("double")
    return _maps(spark, sf_dir).select(F.explode("scores").alias("p")).agg(F.count("*").alias("n"), F.round(F.min(p), 6).alias("least"), F.round(F.max(p), 6).alias("largest"), F.round(F.avg(p), 5).alias("mean"))


def component_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.kept_boxes(_maps(spark, sf_dir), THRESHOLD, MEAN).select("map_id", "label", "n", F.round("box.area", 2).alias("area"))


def quad_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).withColumn("t", F.radians((F.col("doc_id") % 60 * 2 - 60).cast("double")))
    q = b.withColumn("q", geometry.corners(F.col("cx"), F.col("cy"), F.col("w").cast("double"), F.col("h").cast("double"), F.col("t")))
    size, centre = geometry.size(F.col("q")), geometry.centre(F.col("q"))
    return q.select("doc_id", "idx", *(F.round(x, 4).alias(n) for n, x in (("centre_x", centre["x"]), ("centre_y", centre["y"]), ("longer", size["w"]), ("shorter", size["h"]))),
                    F.round(F.degrees(geometry.angle(F.col("q"))), 3).alias("degrees"))


def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return b.where(geometry.in_regions(F.col("cx"), F.col("cy"), F.lit(1000.0), F.lit(700.0))).groupBy("doc_id").agg(F.count("*").alias("n"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of each order's boxes in reading order."""
    b = _boxes(spark, sf_dir)
    quad = geometry.corners(F.col("cx"), F.col("cy"), F.col("w").cast("double"), F.col("h").cast("double"), F.lit(0.0))
    rows = b.select("doc_id", F.struct("idx", "cx", "cy", quad.alias("q")).alias("r")).groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    order = geometry.reading_order(F.transform("r", lambda r: r["q"]))
    return rows.select("doc_id", F.array_join(F.transform(order, lambda i: F.get(F.col("r"), i)["idx"].cast("string")), ",").alias("line_numbers"))


def sequence_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("vec_id", F.posexplode("s").alias("t", "step")).select("vec_id", "t", sequences.best(F.col("step")).alias("best"))


def sequence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = sequences.decoded(F.col("s"), CHARACTERS)
    return _steps(spark, sf_dir).select("vec_id", read.alias("r")).select("vec_id", F.col("r.text").alias("text"), F.round("r.confidence", 5).alias("confidence"))


def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.transform(F.slice("embedding", 1, 2), lambda x: x * 10)
    return table(spark, sf_dir, "embeddings").select("vec_id", sequences.upside_down(scores).alias("upside_down"))


def tensor_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 97, F.col("p_partkey") % 60 + 1
    d = lines.detection_size(w, h * 40, 1280)
    line = F.least(lines.scaled_width(w, h), F.lit(lines.MAX_WIDTH))
    return table(spark, sf_dir, "part").select("p_partkey", d["w"].alias("w"), d["h"].alias("h"), d["padded_w"].alias("padded_w"), d["padded_h"].alias("padded_h"),
                                               line.alias("line_w"), lines.padded(line, 8).alias("line_padded"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return at.select(F.col("vec_id").alias("line_id"), F.floor(F.col("i") / 32).cast("int").alias("y"), (F.col("i") % 32).cast("int").alias("x"), F.when(F.col("v") > 0.1, 0).otherwise(255).alias("p"))


def ink_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.gaps(lines.ink(_pixels(spark, sf_dir)))


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of segments of lines 32 wide, at most 10 wide each, cut in the gaps."""
    centres = ink_gaps(spark, sf_dir).groupBy("line_id").agg(F.array_sort(F.collect_list("centre")).alias("g"))
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line_id"))
    joined = ids.join(centres, "line_id", "left")
    ends = lines.segments(F.lit(32), F.lit(10), F.coalesce("g", F.array().cast("array<int>")))
    return joined.select("line_id", F.array_join(F.transform(ends, lambda e: e.cast("string")), ",").alias("ends"))


def width_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).select(F.floor(F.col("doc_id") / 50).alias("doc_id"), (F.col("box_id") % 400).alias("idx"), "w").groupBy("doc_id", "idx").agg(F.max("w").alias("width"))
    return lines.width_buckets(b)


def joined_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("line_id"), F.col("turn").alias("segment"), "text")
    return lines.joined_text(s)


def box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.statistics(_boxes(spark, sf_dir))


def side_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.order_statistics(_boxes(spark, sf_dir))


def side_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the widths of each order's boxes are apart."""
    return _boxes(spark, sf_dir).groupBy("doc_id").agg(lines.spread(F.col("w")).alias("spread"))


def narrowest_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.narrowest(_boxes(spark, sf_dir).select("w", "box_id").distinct())


def half_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    bytes_ = F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(F.floor((v.cast("double") + 1) * 100).cast("int")), 2, "0")), ""))
    image = F.struct(F.lit(8).alias("width"), F.lit(8).alias("height"), bytes_.alias("pixels"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", image.alias("image"))
    part = images.cut(F.col("image"), F.lit(2), F.lit(1), F.lit(3), F.lit(20))
    return e.select("vec_id", F.lower(F.hex(images.half_turn(F.col("image"))["pixels"])).alias("turned"), F.lower(F.hex(part["pixels"])).alias("part"))


def code_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 31, F.col("p_partkey") % 400 + 1
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(images.code_regions(w, h)))


QUERIES = {f.__name__: f for f in (
    score_cells, score_nearest, score_components, score_summary, component_boxes, quad_measures, region_boxes, reading_order, sequence_best, sequence_text, orientation, tensor_sizes,
    ink_gaps, line_segments, width_buckets, joined_segments, box_statistics, narrowest_boxes, half_turned, code_regions, tiled_components, map_summary, side_statistics, side_spread)}

_CELLS = "with e as (select vec_id, unnest(embedding) as p, unnest(range(0, 64)) as i from embeddings)"
_BOXES = """with b as (select l_orderkey as doc_id, l_orderkey * 8 + l_linenumber as box_id, l_linenumber as idx, l_partkey % 97 * 10 + 5.0::double as cx, l_suppkey % 83 * 8 + 3.0::double as cy,
  cast(l_quantity * 2 + 1 as int) as w, l_linenumber * 3 + 2 as h from lineitem)"""
_COMPONENTS = f"""with recursive e as materialized (select vec_id, unnest(embedding) as p, unnest(range(0, 64)) as i from embeddings),
c as materialized (select vec_id, i, i // 8 as y, i % 8 as x, p from e where p > {THRESHOLD}::float),
n as materialized (select a.vec_id, a.i as i, b.i as j from c a join c b on a.vec_id = b.vec_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1),
w as (select vec_id, i as root, i from c union select w.vec_id, w.root, n.j from w join n on w.vec_id = n.vec_id and w.i = n.i),
l as (select vec_id, i, min(root) as first from w group by 1, 2),
s as (select l.vec_id, l.first, count(*) as n, avg(c.p::double) as mean, dense_rank() over (partition by l.vec_id order by l.first) as label from l join c using (vec_id, i) group by 1, 2)"""
_STEPS = """with s as (select vec_id, t, embedding[8 * t + 1 : 8 * t + 8] as a from embeddings, range(0, 8) r(t)),
b as (select vec_id, t, list_position(a, list_max(a)) - 1 as best, list_max(a) as score from s)"""
_INK = _CELLS + """, c as (select vec_id, i % 32 as x, count(*) filter (where p > 0.1::float) as ink from e group by 1, 2),
g as (select vec_id, x, x - row_number() over (partition by vec_id order by x) as island from c where ink = 0),
r as (select vec_id, min(x) as s, max(x) as e from g group by vec_id, island)"""
_DICT = "[" + ", ".join(f"'{c}'" for c in CHARACTERS) + "]"

ORACLE_SQL = {
    "score_cells": _CELLS + f" select vec_id as map_id, cast(i // 8 as int) as y, cast(i % 8 as int) as x, round(p::double, 6) as p from e where p > {THRESHOLD}::float",
    "score_nearest": "select vec_id as map_id, cast(j as int) as at, round(embedding[1 + (j // 3 * 8 // 4) * 8 + (j % 3 * 8 // 3)]::double, 6) as p from embeddings, range(0, 12) r(j)",
    "score_components": _COMPONENTS + " select vec_id as map_id, cast(label as int) as label, cast(first as int) as first, n, round(mean, 5) as mean from s",
    "tiled_components": _COMPONENTS + " select vec_id as map_id, cast(label as int) as label, cast(first as int) as first, n, round(mean, 5) as mean from s",
    "map_summary": _COMPONENTS + f""", t as (select count(*) as cells, min(p::double) as least, max(p::double) as largest, avg(p::double) as mean from e)
        select 8 as h, 8 as w, (select count(*) from embeddings) as maps, cells, (select count(*) from s where n >= 3 and mean >= {MEAN}) as boxes, round(least, 5) as least, round(largest, 5) as largest, round(mean, 5) as mean from t""",
    "side_statistics": _BOXES + ", s as (select unnest(['w', 'h']) as side, unnest([w, h])::bigint as v from b), r as (select side, v, row_number() over (partition by side order by v) - 1 as k, count(*) over (partition by side) as n from s) "
        "select side, count(*) as n, min(v) as least, max(v) as largest, " + ", ".join(f"(max(v) filter (where k = (n - 1) * {p} // 100) + max(v) filter (where k = ((n - 1) * {p} + 99) // 100)) // 2 as p{p}" for p in (25, 50, 75, 90))
        + ", " + ", ".join(f"count(*) filter (where v < {t}) as under_{t}" for t in (2, 5, 10, 20, 40)) + " from r group by side",
    "side_spread": _BOXES + " select doc_id, cast(cast(max(w) / greatest(min(w), 1) as decimal(18,2)) as varchar) || 'x' as spread from b group by doc_id",
    "score_summary": _CELLS + " select count(*) as n, round(min(p::double), 6) as least, round(max(p::double), 6) as largest, round(avg(p::double), 5) as mean from e",
    "component_boxes": _COMPONENTS + f""", k as (select * from s where n >= 3 and mean >= {MEAN}),
        t as (select k.vec_id, k.label, k.n, a, c.x * cos(radians(a)) + c.y * sin(radians(a)) as u, c.y * cos(radians(a)) - c.x * sin(radians(a)) as v
              from k join l on l.vec_id = k.vec_id and l.first = k.first join c on c.vec_id = l.vec_id and c.i = l.i, range(0, 180) r(a)),
        z as (select vec_id, label, n, a, round((max(u) - min(u)) * (max(v) - min(v)), 9) as area from t group by 1, 2, 3, 4)
        select vec_id as map_id, cast(label as int) as label, n, round(min(area), 2) as area from z group by 1, 2, 3""",
    "quad_measures": _BOXES + """ select doc_id, idx, round(cx, 4) as centre_x, round(cy, 4) as centre_y, round(greatest(w, h)::double, 4) as longer, round(least(w, h)::double, 4) as shorter,
        round(case when doc_id % 60 * 2 - 60 >= -45 then doc_id % 60 * 2 - 60 else doc_id % 60 * 2 + 30 end::double, 3) as degrees from b""",
    "region_boxes": _BOXES + " select doc_id, count(*) as n from b where " + " or ".join(
        f"(cx / 1000.0 between {x}::double and {x}::double + {w}::double and cy / 700.0 between {y}::double and {y}::double + {h}::double)" for x, y, w, h in REGIONS) + " group by doc_id",
    "sequence_best": _STEPS + " select vec_id, cast(t as int) as t, cast(best as int) as best from b",
    "sequence_text": _STEPS + f""", p as (select *, lag(best, 1, 0) over (partition by vec_id order by t) as before from b),
        k as (select vec_id, t, score, coalesce({_DICT}[best], ' ') as ch from p where best <> 0 and best <> before),
        d as (select vec_id, string_agg(ch, '' order by t) as text, avg(score::double) as confidence from k where ch <> '' group by 1)
        select e.vec_id, coalesce(text, '') as text, round(coalesce(confidence, 0), 5) as confidence from embeddings e left join d on d.vec_id = e.vec_id""",
    "orientation": """with s as (select vec_id, exp(greatest((embedding[1] * 10::float)::double, 0)) as a, exp(greatest((embedding[2] * 10::float)::double, 0)) as b from embeddings)
        select vec_id, b / (a + b) > 0.9 as upside_down from s""",
    "tensor_sizes": """with d as (select p_partkey, p_size * 97 as w, (p_partkey % 60 + 1) as h from part),
        r as (select *, case when greatest(w, h * 40) > 1280 then 1280.0::double / greatest(w, h * 40) else 1 end as ratio from d),
        n as (select *, greatest(cast(round_even(w * ratio, 0) as int), 1) as nw, greatest(cast(round_even(h * 40 * ratio, 0) as int), 1) as nh,
              least(greatest(cast(round_even(w / (h / 48.0::double), 0) as int), 1), 640) as lw from r)
        select p_partkey, nw as w, nh as h, (nw + 31) // 32 * 32 as padded_w, (nh + 31) // 32 * 32 as padded_h, lw as line_w, (lw + 7) // 8 * 8 as line_padded from n""",
    "ink_gaps": _INK + " select vec_id as line_id, cast((s + e) // 2 as int) as centre from r where e > s",
    "line_segments": _INK.replace("with e as", "with recursive e as", 1) + """, k as (select vec_id, cast((s + e) // 2 as int) as centre from r where e > s),
        l as (select vec_id, list(centre order by centre) as g from k group by 1),
        t as (select e.vec_id, coalesce(g, []) as g from embeddings e left join l on l.vec_id = e.vec_id),
        w as (select vec_id, g, 0 as pos, '' as ends from t
              union all select vec_id, g, stop, ends || case when ends = '' then '' else ',' end || stop from (
                select *, case when pos + 10 >= 32 then 32 else coalesce(list_max(list_filter(g, lambda x: x > pos and x <= pos + 10)), pos + 10) end as stop from w where pos < 32))
        select vec_id as line_id, ends from w where pos = 32""",
    "reading_order": _BOXES.replace("with b", "with recursive b", 1) + """, i as (select doc_id, idx, cx, cy, least(w, h) as h, row_number() over (partition by doc_id order by idx, cx, cy) as i from b),
        o as (select *, row_number() over (partition by doc_id order by cy, i) as k from i),
        r as (select doc_id, k, idx, i, cx, 1 as line, 1::double as n, cy as sy, cx as sx from o where k = 1
              union all select doc_id, k, idx, i, cx, case when near then line else line + 1 end, case when near then n + 1 else 1 end,
                case when near then sy + cy else cy end, case when near then sx + cx else cx end from (
                select o.*, r.line, r.n, r.sy, r.sx, abs(o.cy - r.sy / r.n) < (o.h + r.sx / r.n) / 2 as near from r join o on o.doc_id = r.doc_id and o.k = r.k + 1))
        select doc_id, string_agg(idx::varchar, ',' order by line, cx, i) as line_numbers from r group by doc_id""",
    "width_buckets": _BOXES.replace("with b", "with recursive b", 1) + f""", g as (select doc_id // 50 as doc_id, cast(box_id % 400 as int) as idx, max(w) as width from b group by 1, 2),
        o as (select *, row_number() over (partition by doc_id order by width, idx) as k from g),
        r as (select doc_id, idx, width, k, 0 as bucket, 1 as n from o where k = 1
              union all select doc_id, idx, width, k, case when fits then bucket else bucket + 1 end, case when fits then n + 1 else 1 end from (
                select o.*, r.bucket, r.n, r.n < {lines.BUCKET_ROWS} and o.width - r.width <= {lines.BUCKET_SPREAD} as fits from r join o on o.doc_id = r.doc_id and o.k = r.k + 1))
        select doc_id, idx, width, bucket from r""",
    "joined_segments": "select conv_id as line_id, coalesce(string_agg(coalesce(text, ''), '' order by turn, text), '') as text from conversations group by 1",
    "box_statistics": _BOXES + " select count(*) as n, min(w) as least, cast(floor(quantile_cont(w, 0.5)) as bigint) as median, max(w) as largest, "
        + ", ".join(f"count(*) filter (where w < {t}) as under_{t}" for t in (2, 5, 10, 20, 40)) + " from b",
    "narrowest_boxes": _BOXES + " select distinct w, box_id from b order by w, box_id limit 20",
    "half_turned": """with e as (select vec_id, list_transform(embedding, lambda v: lpad(lower(to_hex(cast(floor((v::double + 1) * 100) as bigint))), 2, '0')) as p from embeddings)
        select vec_id, array_to_string(list_reverse(p), '') as turned, array_to_string(list_transform(range(0, 7), lambda r: array_to_string(p[(r + 1) * 8 + 3 : (r + 1) * 8 + 5], '')), '') as part from e""",
    "code_regions": """with p as (select p_partkey, p_size * 31 as w, greatest(64, cast(ceil(p_size * 31 * 0.5) as int)) as rw, greatest(64, cast(ceil((p_partkey % 400 + 1) * 0.35) as int)) as rh from part)
        select p_partkey, w - rw as x, 0 as y, rw as w, rh as h from p union all select p_partkey, 0, 0, rw, rh from p""",
}
assert REGION_ASPECT < 1000 / 700
