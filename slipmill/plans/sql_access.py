"""Receipts from SQL: views of records over any table, and user parsers as table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from slipmill.plans import pipeline

PARSED = "ord int, key string, label string, value string"


def fields_view(spark: SparkSession, source: str, view: str, text: str = "text", id_col: str = "doc_id") -> None:
    """A temporary view of the fields (doc_id, ord, key, label, value, confidence) of the receipts in a table or view: the native columns, so what SQL asks of it is pushed down."""
    pipeline.long_fields(pipeline.text_documents(spark.table(source), text, id_col)).createOrReplaceTempView(view)


def records_view(spark: SparkSession, source: str, view: str, text: str = "text", id_col: str = "doc_id") -> None:
    """A temporary view of the records (doc_id, kind, fields, raw_text, error_kind) of the receipts in a table or view."""
    pipeline.text_documents(spark.table(source), text, id_col).createOrReplaceTempView(view)


def parser_function(spark: SparkSession, name: str, parse: Callable[[str], Iterable[tuple[str, str, str]]]) -> None:
    """A table function of a user's parser: ``SELECT d.doc_id, f.* FROM docs d, LATERAL name(d.text) f``. parse: text -> (key, label, value) in order; blank values are left out, as in the
    parsers of the library, and so are null texts. A text that the parser raises on gives one row with the key error."""

    @F.udtf(returnType=PARSED)
    class Parser:
        def eval(self, text: str | None):
            if text is None:
                return
            try:
                found = list(parse(text))
            except Exception as e:  # noqa: BLE001  a faulty text must not stop the documents
                yield 0, "error", type(e).__name__, str(e)
                return
            for k, (key, label, value) in enumerate(row for row in found if row[2] and row[2].strip()):
                yield k, key, label, value

    spark.udtf.register(name, Parser)
