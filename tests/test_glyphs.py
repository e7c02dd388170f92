"""Forms printed with our own font: drawn, found, straightened, read alone and in batches over documents; broken images; boxes by hulls; best paths."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slipmill.operators import glyphs, images, lines, maps, recognition, sequences
from slipmill.operators.engine import Settings
from slipmill.plans import pipeline

TEXTS = [["发票代码：011002200111", "名称：abc#123"], ["A1", "价税合计（小写）¥12345.67", "00001111"], ["x" * 30 + "0123456789" * 3], ["一"], []]
MODELS = (lambda: glyphs.detector(), glyphs.reader([*glyphs.ALPHABET, "一"]), [*glyphs.ALPHABET, "一"], lambda: glyphs.orienter())


def table(spark, texts, turned=()):
    rows = [(f"d{k}", (p.shape[1], p.shape[0], bytearray(p.tobytes()))) for k, p in enumerate(glyphs.page(t, None, turned) for t in texts)]
    return spark.createDataFrame(rows, f"doc_id string, image {images.GRAY}")


def read(df, **settings):
    rows = recognition.recognise(df, *MODELS, settings=Settings(line_width=2600, **settings)).collect()
    return {d: sorted(r.text for r in rows if r.doc_id == d) for d in {r.doc_id for r in rows}}


def test_every_character_is_read():
    load = glyphs.reader()()
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(glyphs.ALPHABET) for _ in range(rng.randrange(1, 25)))
        a = np.where(np.pad(glyphs.line(text), ((3, 4), (50, 51))), 0, 255).astype(np.uint8)
        path = sequences.best_path(load(images.recognition_tensor(a, lines.HEIGHT, 1280)[None])[0])
        assert "".join(glyphs.ALPHABET[c - 1] for c, _, _ in path if c) == text


@pytest.mark.parametrize("turned", [(), (0, 2)])
def test_pages(spark, turned):
    want = {f"d{k}": sorted(t) for k, t in enumerate(TEXTS) if t}
    assert read(table(spark, TEXTS, turned)) == want


@pytest.mark.parametrize("partitions", [1, 3])
def test_batches_over_documents_read_the_same(spark, partitions):
    df = table(spark, TEXTS, (1,)).repartition(partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert read(df, batched=True) == {f"d{k}": sorted(t) for k, t in enumerate(TEXTS) if t}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_batches_are_full_and_of_like_width():
    rng = random.Random(5)
    rows = sorted((pd.Series({"width": min(640, int(rng.expovariate(1 / 150)) + 5), "id": k}) for k in range(5000)), key=lambda r: r.width)
    found = list(lines.bucketed(iter(rows)))
    assert [r.id for b in found for r in b] == [r.id for r in rows]
    assert all(len(b) <= lines.BUCKET_ROWS and all(y.width - x.width <= lines.BUCKET_SPREAD for x, y in zip(b, b[1:])) for b in found)
    assert len(rows) / (len(found) * lines.BUCKET_ROWS) > 0.9


def test_broken_images_are_error_rows(spark):
    good = table(spark, [["发票代码：011002200111 x"]]).withColumn("error_kind", F.lit(None).cast("string"))
    bad = spark.createDataFrame([("n", None, None), ("e", (0, 0, bytearray()), None), ("c", (None, None, None), "Stated")], f"doc_id string, image {images.GRAY}, error_kind string")
    codes = lambda df: recognition.codes(df, lambda: glyphs.decoder())
    for df in (good.union(bad).coalesce(1), good.union(bad).drop("error_kind").coalesce(1)):
        out = {r.doc_id: r for r in pipeline.image_documents(df, recognition.recogniser(*MODELS[:3]), codes).collect()}
        assert out["d0"].kind == "vat_invoice" and out["d0"].error_kind is None
        assert [out[k].error_kind for k in "nec"] == ["Decode", "Decode", "Stated" if "error_kind" in df.columns else "Decode"] and out["n"].kind is None
        assert {r.verification.status for r in out.values()} == {"NotScanned"}
    turned = good.union(bad).coalesce(1).select("doc_id", images.half_turn(F.col("image")).alias("i")).collect()
    assert [r.doc_id for r in turned if r.i is None or r.i.pixels is None] == ["n", "c"] or {r.doc_id for r in turned if not (r.i and r.i.pixels)} == {"n", "e", "c"}


def test_codes(spark):
    decode = glyphs.decoder()
    for payload in ("01,10,011002200111,00000001,1.50,20240102,1", "", "发票代码：1", "x" * (glyphs.SIDE**2 // 8 - 6)):
        page = glyphs.page(["发票号码：00000001"], payload)
        assert decode(images.luminance(page)) == payload
    assert decode(images.luminance(glyphs.page(["发票号码：00000001"]))) is None
    with pytest.raises(ValueError):
        glyphs.code("x" * 100)
    page[30:40, -60:-50] ^= 255  # a spot
    assert decode(images.luminance(page)) is None


def test_located_is_detected_and_boxed(spark):
    df = table(spark, TEXTS[:3])
    one = recognition.located(df, MODELS[0]).select("doc_id", "quads").orderBy("doc_id").collect()
    two = recognition.boxed(recognition.detected(df, MODELS[0])).select("doc_id", "quads").orderBy("doc_id").collect()
    assert one == two and [len(r.quads) for r in one] == [2, 3, 1]


def test_least_boxes_by_hulls(spark):
    rng = np.random.default_rng(6)
    components = []
    for _ in range(30):
        h, w = rng.integers(1, 40, 2)
        mask = rng.random((h, w)) < rng.choice([0.1, 0.5, 1.0])
        if mask.any():
            components.append((np.flatnonzero(mask).astype(np.int32).tolist(), int(w)))
    components.append((list(range(40 * 60)), 60))
    df = spark.createDataFrame(components, "cells array<int>, w int").coalesce(1)
    native = [r.b for r in df.select(maps.smallest_box(F.col("cells"), F.col("w")).alias("b")).collect()]
    for (cells, w), b in zip(components, native, strict=True):
        got = maps.least_box(np.array(cells), w)
        assert all(abs(got[k] - b[k]) < 1e-6 for k in ("area", "a", "w", "h", "cx", "cy"))


def test_best_paths(spark):
    rng = np.random.default_rng(7)
    marks = ["a", "", "c"]
    scores = [rng.integers(0, 3, (n, 5)).astype(np.float32) for n in (0, 1, 2, 30, 60)]
    df = spark.createDataFrame([(k, s.tolist(), [(int(c), float(p), int(n)) for c, p, n in sequences.best_path(s)]) for k, s in enumerate(scores)], f"k int, s array<array<float>>, p {sequences.PATH}")
    for r in df.select(sequences.decoded(F.col("s"), marks).alias("a"), sequences.decoded_path(F.col("p"), marks).alias("b")).collect():
        assert r.a == r.b
    line = glyphs.reader()()(images.recognition_tensor(np.where(np.pad(glyphs.line("发票代码：011002200111"), 20), 0, 255).astype(np.uint8), 48, 1280)[None])[0]
    assert len(sequences.best_path(line)) * 12 < line.nbytes / 100


def test_drawn_pages_are_handed_on_in_small_batches(spark):
    text = pd.Series(["发票号码：00000001", None, "", "名称：ABC\n价税合计（小写）¥1.00"] * 50)
    columns = (text, pd.Series([None, None, "x", "y"] * 50), pd.Series([None, None, [], [1]] * 50))
    whole = [row for f in glyphs._pages(iter([columns, columns]), 1 << 40) for row in f.to_dict("records")]
    parts = list(glyphs._pages(iter([columns, columns]), 100_000))
    assert len(parts) >= 50 and [row["pixels"] for f in parts for row in f.to_dict("records")] == [row["pixels"] for row in whole]
    assert max(sum(len(p) for p in f["pixels"] if p is not None) for f in parts) < 100_000 + 200_000
    df = spark.createDataFrame(list(zip(range(200), text, strict=True)), "k int, t string").coalesce(1)
    image = glyphs.drawn(F.col("t"), F.lit(None).cast("string"), F.array().cast("array<bigint>"))
    assert df.select("k", image.alias("i")).where("(t is null) <> (i.pixels is null)").count() == 0


@pytest.mark.parametrize(("stated", "left"), [("64m", "4194304"), ("67108864b", "4194304"), ("1m", "1m"), ("100000", "100000b")])
def test_batches_of_images_are_bounded(spark, stated, left):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, stated)
    try:
        df = table(spark, TEXTS[:3])
        rows = recognition.recognise(df, *MODELS).collect()
        assert spark.conf.get(key).removesuffix("b") == left.removesuffix("b")
        assert sorted(r.text for r in rows) == sorted(recognition.read(recognition.straightened(recognition.located(df, MODELS[0]), MODELS[3]), *MODELS[1:3]).where("text <> ''").toPandas()["text"])
    finally:
        spark.conf.unset(key)


def test_batched_reading_finds_each_image_once_and_moves_no_pixels(spark, capfd):
    found = spark.sparkContext.accumulator(0)

    def detect():
        model = glyphs.detector()

        def run(tensor):
            found.add(1)
            return model(tensor)

        return run

    texts = [t for t in TEXTS if t] * 5
    df = recognition.recognise(table(spark, texts).repartition(3), detect, *MODELS[1:], settings=Settings(line_width=2600, batched=True))
    assert sorted(r.text for r in df.collect()) == sorted(t for page in texts for t in page)
    assert found.value == len(texts)
    capfd.readouterr()
    recognition.recognise(table(spark, texts), *MODELS, settings=Settings(batched=True)).explain()
    plan = capfd.readouterr().out
    assert "MapInPandas" in plan and "Exchange" not in plan


def test_segments_wait_in_a_pool_of_bounded_size(monkeypatch):
    rng = random.Random(9)
    pages = [["".join(rng.choice(glyphs.ALPHABET) for _ in range(rng.randrange(1, 40)))] for _ in range(120)]
    rows = [(f"d{k}", 0, 0.5, 0.5, 1.0, 1.0, images.gray(np.where(np.pad(glyphs.line(t), ((3, 4), (30, 31))), 0, 255).astype(np.uint8))) for k, [t] in enumerate(pages)]
    taken, sizes = [], []

    def frames():
        for k in range(0, 120, 4):
            taken.append(k)
            yield pd.DataFrame(rows[k : k + 4], columns=[*recognition._KEEP, "line"])

    def load():
        model = glyphs.reader()()
        return lambda tensor: sizes.append(len(tensor)) or model(tensor)

    def read(pool):
        monkeypatch.setattr(recognition, "POOL", pool)
        taken.clear()
        sizes.clear()
        out, seen = [], []
        for pdf in recognition._reading_together(load, 640)(frames()):
            out += [(r.doc_id, "".join(glyphs.ALPHABET[c - 1] for p in r.paths for c, _, _ in p if c)) for r in pdf.itertuples()]
            seen.append(len(taken))
        return out, seen

    want = [(f"d{k}", t) for k, [t] in enumerate(pages)]
    small, seen = read(200_000)
    assert small == want and len(seen) > 10 and seen[0] <= 4 and max(b - a for a, b in zip(seen, seen[1:])) <= 4
    whole, seen = read(1 << 40)
    assert whole == want and len(seen) == 1 and max(sizes) > 4


@pytest.mark.parametrize("batched", [False, True])
def test_tasks_without_lines(spark, batched):
    assert read(table(spark, [[], [], ["A1"], []]), batched=batched) == {"d2": ["A1"]}


def test_image_fields_makes_each_image_once(spark, capfd):
    from slipmill.plans import image_queries

    image_queries.image_fields(spark, "/root/testdata/sf0.001").explain()
    plan = capfd.readouterr().out
    assert plan.count("BatchEvalPython") == 0 and plan.count("ArrowEvalPython") == 2 and plan.count("MapInPandas") == 1  # drawn; boxes and code; read
    assert "Join" not in plan and plan.count("Exchange") == plan.count("Exchange RoundRobinPartitioning") == 1


@pytest.mark.parametrize(("batched", "coded"), [(False, True), (True, False)])
def test_one_pass_reads_what_two_and_a_join_read(spark, batched, coded):
    pages = [glyphs.page(t, p, (1,)) for t, p in ((["发票代码：011002200111", "名称：abc#123"], "发票号码：00000001"), ([], "发票代码：1"), (["A1"], None), (["x" * 30], "receipt 1"))]
    rows = [(f"d{k}", (a.shape[1], a.shape[0], bytearray(a.tobytes())), None) for k, a in enumerate(pages)]
    rows += [("n", None, None), ("e", (0, 0, bytearray()), None), ("c", (None, None, None), "Stated")]
    df = spark.createDataFrame(rows, f"doc_id string, image {images.GRAY}, error_kind string").repartition(3)
    settings, decode = Settings(line_width=1280, batched=batched), (lambda: glyphs.decoder()) if coded else None
    for images_ in (df, df.drop("error_kind").where("doc_id > 'e'")):
        two = pipeline.image_documents(images_, recognition.recogniser(*MODELS, settings=settings), (lambda i: recognition.codes(i, decode)) if coded else None)
        one = pipeline.read_documents(images_, recognition.page_reader(*MODELS[:3], orient=MODELS[3], decode=decode, settings=settings))
        assert one.columns == two.columns and sorted(one.collect(), key=lambda r: r.doc_id) == sorted(two.collect(), key=lambda r: r.doc_id)
    assert images_.count() == 1


def test_best_classes_spell_what_best_paths_read(spark):
    rng = np.random.default_rng(8)
    scores = [rng.integers(0, 3, (n, 5)).astype(np.float32) for n in (0, 1, 2, 30, 60)]
    df = spark.createDataFrame([(s.tolist(), sequences.best_classes(s)) for s in scores], "s array<array<float>>, c array<int>")
    for marks in (["a", "", "c"], []):
        assert all(r.a == r.b for r in df.select(sequences.decoded(F.col("s"), marks)["text"].alias("a"), sequences.spelled(F.col("c"), marks).alias("b")).collect())


def test_tensors_of_lines_are_one_channel_seen_three_times():
    rng = np.random.default_rng(10)
    parts = [rng.integers(0, 256, (48, w)).astype(np.uint8) for w in (30, 41, 8)]
    together = images.stacked(parts, 48)
    assert together.shape == (3, 3, 48, 48) and together.strides[1] == 0
    for part, t in zip(parts, together, strict=True):
        want = np.zeros((48, 48), np.float32)
        want[:, : part.shape[1]] = (part.astype(np.float32) / np.float32(255) - np.float32(0.5)) / np.float32(0.5)
        assert (t == want).all() and (images.recognition_tensor(part, 48, 640)[:, :, : part.shape[1]] == want[:, : part.shape[1]]).all()


@pytest.mark.parametrize("shift", [0.0, 0.5, 0.3])
def test_level_cuts_are_turned_cuts(shift):
    rng = np.random.default_rng(11)
    a = rng.integers(0, 256, (40, 60)).astype(np.uint8)
    y, x = np.mgrid[:20, :31].astype(np.float32)
    sx, sy = np.float32(40 + shift) + (x - np.float32(15.5)), np.float32(25 + shift) + (y - np.float32(10))
    x0, y0 = sx.astype(int), sy.astype(int)
    inside = (sx <= 59) & (sy <= 39)
    x0, y0, x1, y1, dx, dy = x0.clip(0, 59), y0.clip(0, 39), (x0 + 1).clip(0, 59), (y0 + 1).clip(0, 39), sx - x0, sy - y0
    value = a[y0, x0] * (1 - dx) * (1 - dy) + a[y0, x1] * dx * (1 - dy) + a[y1, x0] * (1 - dx) * dy + a[y1, x1] * dx * dy
    assert (images.turned_cut(a, 40 + shift, 25 + shift, 31, 20, 0.0) == np.where(inside, value, 0).astype(np.uint8)).all()
