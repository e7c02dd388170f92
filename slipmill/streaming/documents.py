"""The text pipeline over streams: a stream of documents becomes a stream of records without state; its join with a stream of payloads keeps those of a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slipmill.plans.pipeline import long_fields, text_documents, with_verification


def text_stream(spark: SparkSession, path: str, schema: str = "doc_id string, text string", files: int | None = None) -> DataFrame:
    """Records of JSON documents that arrive under path; files: at most so many of them in a batch."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return text_documents(reader.json(path))


def write_fields(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends the stream's fields, one row each, to Parquet files, each document exactly once."""
    return long_fields(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def timed_records(stream: DataFrame, at: str = "at", delay: str = "10 minutes") -> DataFrame:
    """Records (as text_documents gives them) of a stream of texts (doc_id, text and an event time), with the time as `at` and a watermark on it."""
    read = text_documents(stream.select(F.struct("doc_id", F.col(at).alias("at")).alias("row"), "text"), id_col="row")
    return read.select("doc_id.doc_id", "doc_id.at", *read.columns[1:]).withWatermark("at", delay)


def verified_stream(texts: DataFrame, payloads: DataFrame, early: str = "1 hour", late: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Verified records of a stream of texts (doc_id, text, at) and a stream of payloads (doc_id, raw, at) that come before or after them.

    A payload counts if its time is at most `early` before and at most `late` after that of its text; of those that repeat a doc_id the one that arrives first counts for as long as
    the watermark remembers it. A text waits for its payload in the join's state until the watermarks of both streams have passed its time and `late`; then it is
    a row with the status NotScanned. Rows that are `delay` behind their stream's watermark may be dropped, as in any stream. State: texts and payloads of the window only,
    kept by doc_id; it does not grow with the stream.
    """
    known = timed_records(texts, delay=delay)
    codes = payloads.select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"), F.col("at").alias("_at")).withWatermark("_at", delay).dropDuplicatesWithinWatermark(["_id"])
    near = (F.col("doc_id") == F.col("_id")) & (F.col("_at") >= F.col("at") - F.expr(f"interval {early}")) & (F.col("_at") <= F.col("at") + F.expr(f"interval {late}"))
    return with_verification(known.join(codes, near, "left").drop("_id", "_at"), "_raw")
