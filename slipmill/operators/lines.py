"""Text lines: widths after scaling, gaps between characters, segments of over-long lines, buckets of like width, and their statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmill.operators.folds import joined

#: Height and largest width of recognised lines; members and spread of a bucket; ink is darker than this.
HEIGHT, MAX_WIDTH, BUCKET_ROWS, BUCKET_SPREAD, INK = 48, 640, 24, 16, 128


def scaled_width(w: Column, h: Column, height: int = HEIGHT) -> Column:
    """Width at the recognition height, halves to even, at least 1."""
    return F.greatest(F.bround(w / (F.greatest(h, F.lit(1)) / F.lit(height)), 0).cast("int"), F.lit(1))


def padded(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int")


def detection_size(w: Column, h: Column, limit: int = 1280) -> Column:
    """struct(ratio, w, h, padded_w, padded_h): shrunk so that the longer side is at most limit, never grown; padded to 32."""
    ratio = F.when(F.greatest(w, h) > limit, limit / F.greatest(w, h)).otherwise(F.lit(1.0))
    nw, nh = (F.greatest(F.bround(x * ratio, 0).cast("int"), F.lit(1)) for x in (w, h))
    return F.struct(ratio.alias("ratio"), nw.alias("w"), nh.alias("h"), padded(nw, 32).alias("padded_w"), padded(nh, 32).alias("padded_h"))


def ink(pixels: DataFrame) -> DataFrame:
    """line_id, x and ink (how many pixels of the column are dark) of pixels (line_id, y, x, p)."""
    return pixels.groupBy("line_id", "x").agg(F.count_if(F.col("p") < INK).alias("ink"))


def gaps(columns: DataFrame) -> DataFrame:
    """line_id and centre of every run of at least two columns without ink."""
    empty = columns.where("ink = 0")
    island = F.col("x") - F.row_number().over(Window.partitionBy("line_id").orderBy("x"))
    runs = empty.withColumn("island", island).groupBy("line_id", "island").agg(F.min("x").alias("s"), F.max("x").alias("e"))
    return runs.where("e > s").select("line_id", F.floor((F.col("s") + F.col("e")) / 2).cast("int").alias("centre"))


def segments(width: Column, most: Column, centres: Column) -> Column:
    """Ends of the segments of a line: greedily, each at the last gap within reach, else at the reach, the last at the line's end."""
    state = F.struct(F.lit(0).alias("start"), F.array().cast("array<int>").alias("ends"))

    def step(s: Column, _: Column) -> Column:
        reach = F.least(s["start"] + most, width)
        within = F.filter(centres, lambda g: (g > s["start"]) & (g <= reach))
        end = F.when(reach >= width, width).otherwise(F.coalesce(F.try_element_at(within, F.lit(-1)), reach)).cast("int")
        return F.when(s["start"] >= width, s).otherwise(F.struct(end.alias("start"), F.concat(s["ends"], F.array(end)).alias("ends")))

    # A segment ends at a gap, each of which ends one at most, or is as wide as the reach.
    steps = F.ceil(width / F.greatest(most, F.lit(1))).cast("int") + F.size(centres) + 1
    return F.aggregate(F.sequence(F.lit(1), steps), state, step, lambda s: s["ends"])


def gap_centres(a: np.ndarray) -> list[int]:
    """gaps() of one line's pixels."""
    empty = np.pad(((a < INK).sum(axis=0) == 0).astype(np.int8), 1)
    edge = np.diff(empty)
    return [(s + e - 1) // 2 for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) if e - s > 1]


def segment_ends(width: int, most: int, centres: list[int]) -> list[int]:
    """segments() of one line."""
    ends = [0]
    while ends[-1] < width:
        reach = min(ends[-1] + most, width)
        ends.append(reach if reach >= width else max((g for g in centres if ends[-1] < g <= reach), default=reach))
    return ends[1:]


def bucketed(rows: Iterable) -> Iterator[list]:
    """Buckets of a stream of rows of ascending width: at most BUCKET_ROWS, each at most BUCKET_SPREAD wider than the one before. Widths ascend, so a row that does not
    fit the last bucket fits no earlier one that is full, and none that is too narrow: only the last is held."""
    bucket: list = []
    for row in rows:
        if bucket and (len(bucket) == BUCKET_ROWS or row.width - bucket[-1].width > BUCKET_SPREAD):
            yield bucket
            bucket = []
        bucket.append(row)
    if bucket:
        yield bucket


def width_buckets(widths: DataFrame) -> DataFrame:
    """doc_id, idx, width and bucket of a document's lines (doc_id, idx, width): by width, into the first bucket with room whose widest member
    is near, which is always the last one, as widths ascend. So a bucket starts where the width jumps, and after each BUCKET_ROWS lines from there: windows over
    the sorted lines."""
    order = ["width", "idx"]
    by_doc = Window.partitionBy("doc_id").orderBy(*order)
    jump = F.coalesce(F.col("width") - F.lag("width").over(by_doc) > BUCKET_SPREAD, F.lit(True))
    stretch = widths.select("doc_id", F.col("idx").cast("int").alias("idx"), F.col("width").cast("int").alias("width")).withColumn("jump", jump).withColumn("stretch", F.sum(F.col("jump").cast("int")).over(by_doc))
    place = F.row_number().over(Window.partitionBy("doc_id", "stretch").orderBy(*order)) - 1
    starts = stretch.withColumn("starts", (place % BUCKET_ROWS == 0).cast("int"))
    return starts.select("doc_id", "idx", "width", (F.sum("starts").over(by_doc) - 1).cast("int").alias("bucket"))


def joined_text(segments: DataFrame) -> DataFrame:
    """line_id and text of recognised segments (line_id, segment, text) put together in order, in a stream."""
    return joined(segments, "line_id", [F.col("segment")], F.col("text"), "")


def statistics(boxes: DataFrame, thresholds: tuple[int, ...] = (2, 5, 10, 20, 40)) -> DataFrame:
    """One row: count, least, median (the mean of the middle two cut to an integer) and largest w, and how many are under each threshold."""
    median = F.floor(F.expr("percentile(w, 0.5)")).cast("long")
    return boxes.agg(F.count("*").alias("n"), F.min("w").alias("least"), median.alias("median"), F.max("w").alias("largest"),
                     *(F.count_if(F.col("w") < t).alias(f"under_{t}") for t in thresholds))


def order_statistics(boxes: DataFrame, sides: tuple[str, ...] = ("w", "h"), percents: tuple[int, ...] = (25, 50, 75, 90), thresholds: tuple[int, ...] = (2, 5, 10, 20, 40)) -> DataFrame:
    """A row a side: side, n, least, largest, p25 and so on (the mean of the two values around the rank, cut to an integer; of an even count's 50 that is the median), and how many are
    under each threshold. One pass counts boxes by side and pixels, whatever is asked; partial counts merge. Ranks come from the running sums of these counts, a row for each different
    number of pixels, which the size of images bounds. Nulls do not count; without boxes there is no row."""
    each = boxes.select(F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).cast("long").alias("v")) for s in sides))).alias("b")).select("b.*").where("v is not null")
    counts = each.groupBy("side", "v").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("side")
    ranks = counts.select("side", "v", "c", (F.sum("c").over(whole.orderBy("v")) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("n"))
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("c")), F.col("v")))
    value = lambda p: F.floor((at(F.expr(f"(n - 1) * {p} div 100")) + at(F.expr(f"((n - 1) * {p} + 99) div 100"))) / 2)
    return ranks.groupBy("side").agg(F.max("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("largest"), *(value(p).alias(f"p{p}") for p in percents),
                                     *(F.sum(F.when(F.col("v") < t, F.col("c")).otherwise(0)).alias(f"under_{t}") for t in thresholds))


def spread(values: Column) -> Column:
    """The largest of values over the least, the latter at least 1, as text with two decimals and an x; n/a without any."""
    return F.coalesce(F.concat((F.max(values) / F.greatest(F.min(values), F.lit(1))).cast("decimal(18,2)").cast("string"), F.lit("x")), F.lit("n/a"))


def narrowest(boxes: DataFrame, n: int = 20) -> DataFrame:
    """The n narrowest boxes, ties by id."""
    return boxes.orderBy("w", "box_id").limit(n)
