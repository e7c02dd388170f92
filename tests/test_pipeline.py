"""Records from text, boxes, images and PDFs; readers; streams; settings."""

import base64

import pytest
from pyspark.sql import functions as F

from slipmill.operators import engine
from slipmill.plans import pipeline
from slipmill.sources import readers
from slipmill.streaming import documents as streams

PIXEL = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg==")


def test_blank_text_is_an_error_row(spark):
    df = spark.createDataFrame([("a", " 　\n"), ("b", "发票号码：12345678"), ("c", None)], "doc_id string, text string")
    got = {r.doc_id: r for r in pipeline.text_documents(df).collect()}
    assert got["a"].error_kind == got["c"].error_kind == "EmptyInput" and got["a"].kind is None and got["b"].error_kind is None
    with pytest.raises(Exception, match="EmptyInput"):
        pipeline.text_documents(df, on_error="fail").collect()
    assert [(r.doc_id, r.key, r.value, round(r.confidence, 2)) for r in pipeline.long_fields(pipeline.text_documents(df)).collect()] == [("b", "invoice_no", "12345678", 0.8)]


def test_boxes_are_put_together_in_order(spark):
    boxes = spark.createDataFrame([("a", 2, "b"), ("a", 1, " a "), ("a", 3, " "), ("a", 10, "c"), ("b", 1, None)], "doc_id string, line_no int, text string")
    assert sorted(map(tuple, pipeline.box_text(boxes).collect())) == [("a", "a\nb\nc"), ("b", "")]


def test_images_through_a_recogniser(spark):
    images = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    codes = lambda df: df.select("doc_id", F.lit("发票号码：12345678").alias("raw"))
    got = {r.doc_id: r for r in pipeline.image_documents(images, engine.fixed_text({"a": "发票号码：12345678"}), codes).collect()}
    assert got["a"].verification.status == "Verified" and got["b"].error_kind == "EmptyInput"
    assert pipeline.image_documents(images, engine.nothing).where("verification is null").count() == 2


def test_pdfs(spark):
    pdfs = spark.createDataFrame([("a", bytearray(b"x" * 30)), ("b", bytearray(b"short"))], "doc_id string, content binary")
    got = {r.doc_id: r.error_kind for r in pipeline.pdf_documents(pdfs, lambda c: c.cast("string")).collect()}
    assert got == {"a": None, "b": "RasterNotAvailable"}


def test_readers(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "i/a.png").write_bytes(PIXEL)
    (tmp_path / "i/b.png").write_bytes(b"not an image")
    rows = {r.doc_id.rsplit("/", 1)[1]: r for r in readers.images(spark, str(tmp_path / "i")).collect()}
    assert rows["a.png"].image.width == 1 and rows["a.png"].error_kind is None and rows["b.png"].error_kind == "Decode"
    assert {r.doc_id.rsplit("/", 1)[1]: r.error_kind for r in readers.binaries(spark, str(tmp_path / "i")).collect()} == {"a.png": None, "b.png": None}
    empty = spark.createDataFrame([("x", bytearray(b"")), ("y", None), ("z", bytearray(b"1"))], "doc_id string, content binary")
    assert [r.error_kind for r in readers.checked(empty).orderBy("doc_id").collect()] == ["EmptyInput", "EmptyInput", None]
    with pytest.raises(ValueError):
        readers.images(spark, " ")


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", "发票号码：12345678"), ("b", "车次 G12")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    df.repartition(2).write.json(str(tmp_path / "in"))
    query = streams.write_fields(streams.text_stream(spark, str(tmp_path / "in"), files=1), str(tmp_path / "out"), str(tmp_path / "at"))
    query.awaitTermination(60)
    want = pipeline.long_fields(pipeline.text_documents(df))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_settings(tmp_path):
    assert engine.Settings(threads=99).threads == 16 and engine.Settings().line_width == 640
    with pytest.raises(engine.NotConfigured, match="未指定"):
        engine.model_files(engine.Settings(), " ")
    with pytest.raises(engine.NotConfigured, match=str(tmp_path)):
        engine.model_files(engine.Settings(model_dir=str(tmp_path)))
    for name in ("det", "rec"):
        (tmp_path / f"{name}.onnx").write_bytes(b"x")
    assert engine.model_files(engine.Settings(), str(tmp_path))["cls"] is None
    assert engine.dictionary(None, ["a", " ", "b"]) == ["", "a", "b"] and engine.dictionary("x\ny", ["a"]) == ["x", "y"] and engine.dictionary(None, ["a"], False) == ["a"]
