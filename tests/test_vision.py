"""Kernels and folds against naive loops."""

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slipmill.operators import geometry, images, lines, maps, sequences


def naive_resize(rows, n):
    out = []
    size = len(rows[0])
    for row in rows:
        new = []
        for x in range(n):
            centre = np.float32(np.float32(x + np.float32(0.5)) * np.float32(size / n)) - np.float32(0.5)
            left, total, mass = math.floor(centre), np.float32(0), np.float32(0)
            for i in range(left, left + 3):
                weight = max(np.float32(0), np.float32(1) - abs(np.float32(centre - np.float32(i))))
                total += np.float32(row[min(max(i, 0), size - 1)]) * weight
                mass += weight
            new.append(int(total / mass))
        out.append(new)
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 12), st.integers(1, 12), st.integers(0, 99))
def test_resize(w, h, nw, nh, seed):
    a = np.random.default_rng(seed).integers(0, 256, (h, w), dtype=np.uint8)
    wide = naive_resize(a.tolist(), nw) if nw != w else a.tolist()
    tall = np.array(naive_resize(np.array(wide).T.tolist(), nh)).T if nh != h else np.array(wide)
    assert np.abs(images.resized(a, nw, nh).astype(int) - tall).max() <= 1


def test_turned_cut_and_tensors():
    a = np.arange(30, dtype=np.uint8).reshape(5, 6)
    assert (images.turned_cut(a, 2, 2, 4, 4, 0.0) == a[0:4, 0:4]).all()
    assert images.turned_cut(a, 0, 0, 4, 4, 0.0)[0, 0] == 0 and images.turned_cut(a, 0, 0, 0, 0, 0.0).shape == (1, 1)
    t = images.normalised(a, 8, 6)
    assert t.shape == (3, 6, 8) and t[0, 0, 0] == -1 and t[0, 5, 7] == 0
    assert images.stacked([a, a[:, :3]], 5).shape == (2, 3, 5, 8)


def test_image_columns(spark):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    df = spark.createDataFrame([((4, 3, bytearray(a.tobytes())),)], f"image {images.GRAY}")
    row = df.select(images.half_turn(F.col("image")).alias("t"), images.cut(F.col("image"), F.lit(1), F.lit(1), F.lit(9), F.lit(1)).alias("c"), images.cut(F.col("image"), F.lit(9), F.lit(0), F.lit(1), F.lit(1)).alias("e"),
                    images.resize(F.col("image"), F.lit(2), F.lit(3)).alias("r"), images.rotated_crop(F.col("image"), F.lit(1.0), F.lit(1.0), F.lit(2), F.lit(2), F.lit(0.0)).alias("x")).first()
    assert bytes(row.t.pixels) == a[::-1, ::-1].tobytes() and bytes(row.c.pixels) == a[1:2, 1:4].tobytes() and bytes(row.e.pixels) == a.tobytes()
    assert bytes(row.r.pixels) == images.resized(a, 2, 3).tobytes() and bytes(row.x.pixels) == a[0:2, 0:2].tobytes()


def naive_labels(mask):
    h, w = mask.shape
    label, n = -np.ones((h, w), int), 0
    for y in range(h):
        for x in range(w):
            if mask[y, x] and label[y, x] < 0:
                stack = [(y, x)]
                while stack:
                    b, a = stack.pop()
                    if 0 <= b < h and 0 <= a < w and mask[b, a] and label[b, a] < 0:
                        label[b, a] = y * w + x
                        stack += [(b + i, a + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return label


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 8), st.integers(1, 8), st.integers(0, 999))
def test_components(h, w, seed):
    mask = np.random.default_rng(seed).random((h, w)) < 0.45
    assert (maps._labels(mask) == naive_labels(mask)).all()


def test_boxes(spark):
    p = np.zeros((6, 8), np.float32)
    p[1:4, 2:6] = 0.9
    p[5, 0:2] = 0.9
    df = spark.createDataFrame([(1, 6, 8, p.reshape(-1).tolist()), (2, 6, 8, [0.9]), (3, 6, 8, [0.0] * 48)], "map_id long, h int, w int, scores array<float>")
    rows = maps.boxes(df, scale_x=2.0).collect()
    assert len(rows) == 1 and [(round(q.x, 3), round(q.y, 3)) for q in rows[0].quad] == [(2.5, 0.5), (11.5, 0.5), (11.5, 3.5), (2.5, 3.5)]


def naive_order(quads):
    items = sorted((sum(p[1] for p in q) / 4, i, sum(p[0] for p in q) / 4, min(math.dist(q[0], q[1]), math.dist(q[1], q[2]))) for i, q in enumerate(quads))
    rows = []
    for cy, i, cx, h in items:
        if rows and abs(cy - sum(r[0] for r in rows[-1]) / len(rows[-1])) < (h + sum(r[1] for r in rows[-1]) / len(rows[-1])) / 2:
            rows[-1].append((cy, cx, i))
        else:
            rows.append([(cy, cx, i)])
    return [i for row in rows for _, _, i in sorted(row, key=lambda r: (r[1], r[2]))]


def test_reading_order(spark):
    rng, cases = random.Random(4), [[]]
    for _ in range(60):
        quads = []
        for _ in range(rng.randrange(1, 9)):
            x, y, w, h = rng.randrange(0, 60), rng.randrange(0, 400), rng.randrange(1, 30), rng.randrange(1, 12)
            quads.append([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
        cases.append(quads)
    df = spark.createDataFrame([(i, [[(float(a), float(b)) for a, b in q] for q in c]) for i, c in enumerate(cases)], "i int, q array<array<struct<x:double,y:double>>>")
    for r in df.select("i", geometry.reading_order(F.col("q")).alias("o")).collect():
        assert r.o == (naive_order(cases[r.i]) if len(cases[r.i]) > 1 else list(range(len(cases[r.i]))))


def test_sequences(spark):
    one = lambda *cs: [[1.0 if k == c else 0.0 for k in range(4)] for c in cs]
    df = spark.createDataFrame([(0, one(1, 1, 0, 1, 2)), (1, one(0, 0)), (2, []), (3, one(3, 3, 2))], "i int, s array<array<double>>")
    got = {r.i: (r.d.text, r.d.confidence) for r in df.select("i", sequences.decoded(F.col("s"), ["a", "b"]).alias("d")).collect()}
    assert got == {0: ("aab", 1.0), 1: ("", 0.0), 2: ("", 0.0), 3: (" b", 1.0)}
    flat = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "v array<double>").select(sequences.steps(F.col("v"), 9, 2)).first()[0]
    assert flat == [[1.0, 2.0], [3.0, 4.0]]


def naive_segments(w, most, gaps):
    start, ends = 0, []
    while True:
        reach = min(start + most, w)
        if reach >= w:
            return [*ends, w]
        within = [g for g in gaps if start < g <= reach]
        start = within[-1] if within else reach
        ends.append(start)


def test_segments(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(1, 90), rng.randrange(5, 40), sorted(rng.sample(range(90), rng.randrange(8)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "w int, m int, g array<int>")
    for r in df.select("w", "m", "g", lines.segments(F.col("w"), F.col("m"), F.col("g")).alias("e")).collect():
        assert r.e == naive_segments(r.w, r.m, [g for g in r.g])


def test_width_buckets(spark):
    rng = random.Random(3)
    rows = [(d, i, rng.randrange(1, 300)) for d in range(4) for i in range(80)]
    got = {(r.doc_id, r.idx): r.bucket for r in lines.width_buckets(spark.createDataFrame(rows, "doc_id long, idx int, width int")).collect()}
    for d in range(4):
        buckets = []
        for w, i in sorted((w, i) for x, i, w in rows if x == d):
            k = next((k for k, b in enumerate(buckets) if len(b) < 24 and abs(w - max(b)) <= 16), len(buckets))
            buckets[k:] = buckets[k:] or [[]]
            buckets[k].append(w)
            assert got[d, i] == k
