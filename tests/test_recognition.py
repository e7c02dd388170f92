"""Images to boxes with stub models: places, order, turning, batches, codes; faults become rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipmill.operators import images, lines, recognition
from slipmill.operators.engine import Settings, cached, stated_characters
from slipmill.plans import pipeline

CHARACTERS = list("abcd")


def detect():
    """Dark pixels of the tensor are text."""
    return lambda t: (t[:, :1] < 0).astype(np.float32)


def recogniser():
    """A step for each 16 columns: its class is the column's darkness in quarters, 0 for white."""

    def run(t):
        n, _, _, w = t.shape
        out = np.zeros((n, max(1, w // 16), 5), np.float32)
        for k in range(n):
            for s in range(out.shape[1]):
                dark = (1 - t[k, 0, :, 16 * s : 16 * s + 16].mean()) / 2
                out[k, s, 0 if dark < 0.1 else min(4, 1 + int(dark * 4))] = 1
        return out

    return run


def page(*boxes, h=200, w=400):
    a = np.full((h, w), 255, np.uint8)
    for x, y, bw, bh, value in boxes:
        a[y : y + bh, x : x + bw] = value
    return a


def table(spark, *pages):
    rows = [(f"d{i}", (a.shape[1], a.shape[0], bytearray(a.tobytes()))) for i, a in enumerate(pages)]
    return spark.createDataFrame(rows, f"doc_id string, image {images.GRAY}")


def test_boxes_in_order_and_in_shares(spark):
    pages = page((220, 20, 100, 20, 0), (20, 22, 120, 20, 0), (40, 420, 200, 24, 90), (390, 190, 1, 1, 0), h=600), page()
    rows = recognition.recognise(table(spark, *pages), detect, recogniser, CHARACTERS).orderBy("line_no").collect()
    assert [r.doc_id for r in rows] == ["d0"] * 3 and [r.line_no for r in rows] == [0, 1, 2] and all(r.text for r in rows)
    for r, (x, y, w, h) in zip(rows, ((20, 22, 120, 20), (220, 20, 100, 20), (40, 420, 200, 24)), strict=True):
        assert abs(r.x - (x + w / 2 - 0.5) / 400) < 0.01 and abs(r.y - (y + h / 2 - 0.5) / 600) < 0.01
        assert abs(r.w - (w - 1) * 1.5 / 400) < 0.02 and 0 < r.confidence <= 1


def test_settings_act(spark):
    big = page((100, 100, 600, 60, 0), h=1400, w=2000)
    one = recognition.detected(table(spark, big), detect, Settings(detection_limit=320)).first()
    assert (one.w, one.h) == (320, 224) and one.scale_x == 2000 / 320
    two = table(spark, page((300, 150, 60, 20, 0), (300, 70, 60, 12, 0), h=200, w=400))
    count = lambda **s: recognition.boxed(recognition.detected(two, detect), Settings(**s)).select(F.size("quads")).first()[0]
    assert count() == 2 and count(cell_threshold=1.0) == 0 and count(component_mean=1.1) == 0 and count(regions=True) == 1
    quads = recognition.boxed(recognition.detected(two, detect), Settings(), offset_x=8.0).first().quads
    assert quads[0][0].x == recognition.boxed(recognition.detected(two, detect)).first().quads[0][0].x - 8


def test_lines_are_turned(spark):
    a = page((40, 60, 200, 30, 0))
    a[60:90, 40:140] = 100
    turn = lambda: lambda t: np.array([[0.0, 9.0]] * len(t), np.float32)
    boxes = recognition.boxed(recognition.detected(table(spark, a), detect))
    straight, turned = (images.pixels(recognition.straightened(boxes, o).first().line.asDict()) for o in (None, turn))
    assert (turned == straight[::-1, ::-1]).all() and not (turned == straight).all()


def test_batches_read_the_same_text(spark):
    pages = [page((20, 20, 90, 20, 0)), page((20, 20, 120, 20, 0), (20, 80, 200, 20, 60), (20, 140, 60, 20, 60))]
    alone, together = (recognition.recognise(table(spark, *pages), detect, recogniser, CHARACTERS, settings=Settings(batched=b)).orderBy("doc_id", "line_no").collect() for b in (False, True))
    assert [(r.doc_id, r.line_no, r.text) for r in alone] == [(r.doc_id, r.line_no, r.text) for r in together] and {round(r.confidence, 3) for r in together} == {0.8}
    wide = np.zeros((10, 400), np.uint8)
    wide[:, 195:205] = 255
    parts = list(recognition._parts(wide, 640))
    assert len(parts) > 1 and lines.segment_ends(400, 133, lines.gap_centres(wide)) == [133, 199, 332, 400]


def test_codes(spark):
    def decoder():
        def run(rgb):
            assert rgb.shape[2] == 3
            if (rgb == 7).any():
                raise ValueError("broken")
            return "in region" if rgb.shape[0] < 200 and (rgb == 0).any() else " " if rgb.shape[0] < 200 else "whole" if (rgb == 0).any() else None

        return run

    pages = page((300, 10, 30, 30, 0)), page((20, 150, 30, 30, 0)), page(), page((300, 10, 5, 5, 7)), page((1, 1, 2, 2, 0), h=200, w=20)
    got = [r.raw for r in recognition.codes(table(spark, *pages), decoder).orderBy("doc_id").collect()]
    assert got[:4] == ["in region", "whole", None, None]


def test_documents_from_images(spark):
    read = lambda: lambda t: recogniser()(t)
    out = pipeline.image_documents(table(spark, page((20, 20, 90, 20, 0)), page()), recognition.recogniser(detect, read, CHARACTERS)).orderBy("doc_id").collect()
    assert out[0].kind == "unknown" and out[0].error_kind is None and out[1].error_kind == pipeline.EMPTY


def test_models_are_loaded_once(spark):
    calls = []
    get = cached(lambda: calls.append(1) or object())
    assert get() is get()
    assert stated_characters(lambda: {"character": "a\nb"}) == "a\nb" and stated_characters(lambda: {}) is None and stated_characters(lambda: 1 / 0) is None


def test_broken_pdfs_are_rows(spark):
    def extract(content):
        if content == b"bad":
            raise OSError("no trailer")
        return content.decode()

    df = spark.createDataFrame([("a", bytearray(b"bad")), ("b", bytearray(b"short")), ("c", bytearray("发票代码：011002200111 and more words".encode()))], "doc_id string, content binary")
    got = {r.doc_id: (r.kind, r.error_kind) for r in pipeline.pdf_documents(df, pipeline.guarded(lambda c: extract(bytes(c)))).collect()}
    assert got == {"a": (None, "Pdf"), "b": (None, "RasterNotAvailable"), "c": ("vat_invoice", None)}


@pytest.mark.parametrize("values, want", [([3, 9], "3.00x"), ([0, 5], "5.00x"), ([], "n/a")])
def test_spread(spark, values, want):
    assert spark.createDataFrame([(v,) for v in values], "v long").agg(lines.spread(F.col("v"))).first()[0] == want


def test_tensors():
    a = np.arange(40 * 90, dtype=np.uint8).reshape(40, 90)
    t, x, y = images.detection_tensor(a, 45)
    assert t.shape == (3, 32, 64) and (x, y) == (2.0, 2.0) and t[0, 31, 63] == 0
    assert images.detection_tensor(a, 200, fixed=(64, 64))[0].shape == (3, 64, 64) and images.detection_tensor(a, 200)[1:] == (1.0, 1.0)
    assert images.recognition_tensor(a, 48, 640).shape == (3, 48, 112) and images.recognition_tensor(a, 48, 64).shape == (3, 48, 64)
    assert images.recognition_tensor(a, 48, 640, fixed=True).shape == (3, 48, 640) and images.orientation_tensor(a, 48, 192).shape == (3, 48, 192)
    assert (images.luminance(a)[..., 2] == a).all()


def test_repeated_fields_count_once(spark):
    from slipmill.operators import verify

    fields = spark.createDataFrame([("d", 1, "invoice_no", "2"), ("d", 0, "invoice_no", "1")], "doc_id string, ord int, key string, value string")
    qr = spark.createDataFrame([("d", 0, "invoice_no", "1")], "doc_id string, ord int, key string, value string")
    assert [(r.ocr_value, r.same) for r in verify.compare(fields, qr).collect()] == [("1", True)]
