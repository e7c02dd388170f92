"""Documents to records: from text, text boxes, images or PDF text layers, with faulty rows kept as error rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slipmill.functions.dialect import blank, settled, trim_u
from slipmill.functions.qr import qr_fields
from slipmill.functions.receipts import FIELD, fields_of, kind_of
from slipmill.operators.folds import joined
from slipmill.operators.verify import verification

#: Least length of a PDF's trimmed text layer; below it the page is a picture and needs recognition.
PDF_LEAST = 20
EMPTY, NO_RASTER, BROKEN_PDF, BROKEN_IMAGE = "EmptyInput", "RasterNotAvailable", "Pdf", "Decode"


def text_documents(df: DataFrame, text: str = "text", id_col: str = "doc_id", on_error: str = "quarantine", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, kind, fields, raw_text and error_kind of every row. on_error: 'quarantine' keeps blank rows with their error_kind
    and no kind or fields, 'fail' raises. kinds: only documents of these kinds get fields."""
    t = F.col(text)
    empty = blank(t)
    error = F.when(empty, F.raise_error(F.lit("EmptyInput: no text"))) if on_error == "fail" else F.when(empty, EMPTY)
    out = df.select(F.col(id_col).alias("doc_id"), F.when(~empty, kind_of(t)).alias("kind"), t.alias("raw_text"), error.cast("string").alias("error_kind"))
    return out.select("doc_id", "kind", F.when(F.col("error_kind").isNull(), fields_of(F.col("kind"), F.col("raw_text"), kinds)).alias("fields"), "raw_text", "error_kind")


def long_fields(documents: DataFrame) -> DataFrame:
    """doc_id, ord, key, label, value and confidence: one row a field."""
    return inlined(documents, F.col("fields"))


def inlined(df: DataFrame, rows: Column) -> DataFrame:
    """doc_id and the structs of a list column. The outer form, then a filter: the plain form makes the optimizer compute the
    list a second time to drop empty ones."""
    return df.select("doc_id", F.inline_outer(rows)).where("ord is not null")


def wide_fields(documents: DataFrame, kind: str) -> DataFrame:
    """One column a key, null where a document has no such field; only documents of the kind. No shuffle: each key is looked up in the row's own list."""
    from slipmill.functions.patterns import FIELDS

    value = lambda key: F.get("fields.value", F.array_position("fields.key", key).cast("int") - 1).alias(key)
    return documents.where(F.col("kind") == kind).select("doc_id", *(value(k) for k, _ in FIELDS[kind]))


def box_text(boxes: DataFrame) -> DataFrame:
    """doc_id and raw_text: the trimmed, non-blank texts of a document's boxes (doc_id, line_no, text), a line each, in order. Boxes are sorted in their partitions and folded in a
    stream, so a document of any number of boxes takes no more memory than its text."""
    text = trim_u(F.coalesce("text", F.lit("")))
    return joined(boxes, "doc_id", [F.col("line_no")], F.when(text != "", text), "\n", "raw_text")


def verified(documents: DataFrame, payloads: DataFrame | None) -> DataFrame:
    """documents with a verification column. payloads: doc_id, raw (null: no code was read); None: no decoder, verification is null.
    Documents without a row in payloads are not scanned."""
    if payloads is None:
        return documents.withColumn("verification", F.lit(None).cast("struct<status:string,raw_content:string,matched:array<struct<key:string,qr_value:string,ocr_value:string>>,"
                                                                  "conflicts:array<struct<key:string,qr_value:string,ocr_value:string>>>"))
    known = documents.join(payloads.select("doc_id", F.col("raw").alias("_raw")), "doc_id", "left")
    return with_verification(known, "_raw")


def with_verification(documents: DataFrame, raw: str) -> DataFrame:
    """documents with a verification column instead of the column raw, their payload (null: not scanned). For text and payload that are in one row: nothing is joined."""
    read = documents.withColumns({"_qr": qr_fields(F.col(raw)), raw: trim_u(F.col(raw))})
    return read.withColumn("verification", verification(F.coalesce("fields", F.array().cast(FIELD)), F.col("_qr"), F.col(raw))).drop(raw, "_qr")


def _faults(images: DataFrame) -> Column:
    """The error_kind that images came with, or that of those without pixels."""
    broken = F.coalesce(F.length("image.pixels"), F.lit(0)) == 0 if "image" in images.columns else F.lit(False)
    stated = F.col("error_kind") if "error_kind" in images.columns else F.lit(None).cast("string")
    return F.coalesce(stated, F.when(broken, BROKEN_IMAGE))


def image_documents(images: DataFrame, recognize: Callable[[DataFrame], DataFrame], decode: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Records of images (doc_id, image and, as readers give it, error_kind). recognize: images -> boxes (doc_id, line_no, text ...), a DataFrame operator such as
    ``operators.recognition.recogniser(...)``; decode: images -> payloads (doc_id, raw). Images without pixels are rows with the error_kind that they came with, or Decode.
    Images are read once by each of the two and joined; ``read_documents`` reads them once."""
    known = images.select("doc_id", _faults(images).alias("_fault"))
    read = known.join(box_text(recognize(images)), "doc_id", "left").select(F.struct("doc_id", "_fault").alias("row"), "raw_text")
    out = text_documents(read, "raw_text", id_col="row")
    out = out.select("doc_id.doc_id", "kind", "fields", "raw_text", F.coalesce("doc_id._fault", "error_kind").alias("error_kind"))
    return verified(out, decode(images) if decode else None)


def read_documents(images: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """image_documents() with one operator for texts and codes, in one pass without a join. read: images -> their columns but the image, texts (a list; null or empty:
    none) and, if it decodes, raw; such as ``operators.recognition.page_reader(...)``. A row stays a row, so repeated and null doc_ids do too."""
    rows = read(images.select("doc_id", "image", _faults(images).alias("_fault")))
    lines = F.filter(F.transform("texts", trim_u), lambda t: t != "")
    scanned = "raw" in rows.columns
    kept = rows.select(F.struct("doc_id", "_fault", *(["raw"] if scanned else [])).alias("row"), settled(F.when(F.size("texts") > 0, F.array_join(lines, "\n"))).alias("raw_text"))
    out = text_documents(kept, "raw_text", id_col="row")
    out = out.select("doc_id.doc_id", "kind", "fields", "raw_text", F.coalesce("doc_id._fault", "error_kind").alias("error_kind"), *(["doc_id.raw"] if scanned else []))
    return with_verification(out, "raw") if scanned else verified(out, None)


def guarded(extract: Callable[[bytes], str]) -> Callable[[Column], Column]:
    """A column function struct(text, fault) from a Python function of one document's bytes; what it raises becomes the fault."""

    @F.pandas_udf("text string, fault string")
    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                rows.append((extract(c), None))
            except Exception as e:  # noqa: BLE001  a broken document is a row with an error
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "fault"])

    return run


def pdf_documents(pdfs: DataFrame, extract: Callable[[Column], Column]) -> DataFrame:
    """Records of PDFs (doc_id, content). extract: column of bytes -> column of text, or struct(text, fault) as guarded() gives it (from the user's
    PDF library); rows with a fault have the error_kind Pdf."""
    t = pdfs.select("doc_id", extract(F.col("content")).alias("t"))
    t = t.select("doc_id", "t.text", "t.fault") if isinstance(t.schema["t"].dataType, StructType) else t.select("doc_id", F.col("t").alias("text"), F.lit(None).cast("string").alias("fault"))
    short = F.length(trim_u(F.coalesce("text", F.lit("")))) < PDF_LEAST
    read = t.select(F.struct("doc_id", "fault").alias("row"), F.when(~short, F.col("text")).alias("text"))
    out = text_documents(read, id_col="row")
    kind = F.when(F.col("doc_id.fault").isNotNull(), BROKEN_PDF).when(F.col("error_kind") == EMPTY, NO_RASTER).otherwise(F.col("error_kind"))
    return out.select("doc_id.doc_id", "kind", "fields", "raw_text", kind.alias("error_kind"))
