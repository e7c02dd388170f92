"""Components over tiles, texts folded in order, order statistics, sums of maps: against plain readings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipmill.operators import folds, lines, maps
from slipmill.plans import pipeline


def map_table(spark, arrays):
    rows = [(k, *a.shape, a.reshape(-1).tolist()) for k, a in enumerate(arrays)]
    return spark.createDataFrame([*rows, (100, 0, 0, []), (101, 3, 3, None), (102, 5, 5, [1.0])], "map_id long, h int, w int, scores array<float>")


def snake(n):
    """One component that crosses every tile again and again."""
    a = np.zeros((n, n), np.float32)
    a[::2] = 1
    a[1::4, -1] = a[3::4, 0] = 1
    return a


@pytest.mark.parametrize("size", [1, 3, 4, 50])
def test_tiles_give_the_labels_of_the_whole(spark, size):
    rng = np.random.default_rng(size)
    arrays = [(rng.random((h, w)) < 0.45).astype(np.float32) for h, w in ((7, 9), (12, 5), (1, 11), (6, 6))] + [snake(11), np.ones((9, 9), np.float32), np.zeros((4, 4), np.float32)]
    table = map_table(spark, arrays)
    want = {tuple(r) for r in maps.components(table, 0.5).select("map_id", "label", "at", "p").collect()}
    got = [tuple(r) for r in maps.tiled_components(maps.tiles(table, size), 0.5).select("map_id", "label", "at", "p").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_texts_are_folded_in_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.randrange(20), rng.choice(["x", "y ", None, "", "  "]), k) for k in range(300)] + [("blank", 1, " ", 0), ("big", 5, "z" * 10_000, 0)]
    df = spark.createDataFrame(rows, "doc_id string, line_no int, text string, text_ int").repartition(7)
    want = {}
    for key in {r[0] for r in rows}:
        want[key] = "\n".join(t.strip() for _, t in sorted((n, (t or "").strip()) for d, n, t, _ in rows if d == key) if t)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {r.doc_id: r.raw_text for r in pipeline.box_text(df).collect()} == want
        many = spark.range(0, 200_000, 1, 4).select(F.lit("d").alias("doc_id"), (199_999 - F.col("id")).alias("line_no"), F.col("id").cast("string").alias("text"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pipeline.box_text(many).first().raw_text == "\n".join(map(str, range(199_999, -1, -1)))
    assert pipeline.box_text(df.limit(0)).collect() == []
    assert folds.joined(df.where("doc_id = 'big'"), "doc_id", [F.col("line_no")], F.lit(None).cast("string"), ",").first().text == ""


def test_order_statistics(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(1, 60) if rng.random() < 0.9 else None, rng.choice([1, 3, 500])) for _ in range(501)]
    got = {r.side: r for r in lines.order_statistics(spark.createDataFrame(rows, "w int, h int"), percents=(0, 10, 50, 100)).collect()}
    for k, side in enumerate("wh"):
        v = sorted(r[k] for r in rows if r[k] is not None)
        at = lambda p: (v[(len(v) - 1) * p // 100] + v[((len(v) - 1) * p + 99) // 100]) // 2  # noqa: B023, E731
        r = got[side]
        assert (r.n, r.least, r.largest, r.p0, r.p10, r.p50, r.p100, r.under_5, r.under_40) == (len(v), v[0], v[-1], at(0), at(10), at(50), at(100), sum(x < 5 for x in v), sum(x < 40 for x in v))
    assert lines.order_statistics(spark.createDataFrame([], "w int, h int")).collect() == []


def test_map_summary(spark):
    two = np.zeros((4, 4), np.float32)
    two[0, :3] = two[3, 1:] = 0.75
    got = {(r.h, r.w): r for r in maps.summary(map_table(spark, [two, two, np.full((2, 3), 0.5, np.float32)])).collect()}
    assert (got[4, 4].maps, got[4, 4].boxes, got[4, 4].cells, got[4, 4].mean) == (2, 4, 32, 4.5 * 2 / 32) and got[2, 3].boxes == 1 and got[0, 0].mean is None and got[3, 3].cells == 0
