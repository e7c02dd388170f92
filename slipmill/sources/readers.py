"""Readers of documents: images, PDFs and plain texts as rows; and decoding to gray, with faulty rows marked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipmill.operators.images import GRAY

EMPTY, UNDECODED = "EmptyInput", "Decode"


def _guard(path: str | None) -> str:
    if path is None or not path.strip():
        raise ValueError("path is required")
    return path


def checked(df: DataFrame) -> DataFrame:
    """doc_id, content and error_kind of byte documents; those without bytes are errors."""
    return df.select("doc_id", "content", F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, EMPTY).alias("error_kind"))


def binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """doc_id (the path), content and error_kind of every file. Spark's reader passes over files of no bytes."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(_guard(path))
    return checked(df.select(F.col("path").alias("doc_id"), "content"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and text of every file, whole."""
    return spark.read.option("wholetext", True).text(_guard(path)).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, image (gray) and error_kind of every image file that the platform decodes; others are Decode errors."""
    raw = spark.read.format("image").option("dropInvalid", False).load(_guard(path))
    return decoded(raw.select(F.col("image.origin").alias("doc_id"), "image"))


def decoded(df: DataFrame) -> DataFrame:
    """Gray images of Spark's image structs (doc_id, image): luma of blue, green, red (and alpha, not used)."""
    @F.pandas_udf(GRAY)
    def luma(image: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in image.to_dict("records"):
            if r["width"] is None or not r["width"] > 0 or not r["height"] > 0:
                out.append({"width": None, "height": None, "pixels": None})
                continue
            a = np.frombuffer(r["data"], np.uint8).reshape(int(r["height"]), int(r["width"]), int(r["nChannels"]))
            g = a[..., 0] if a.shape[2] == 1 else np.rint(a[..., :3].astype(np.float64) @ [0.114, 0.587, 0.299]).astype(np.uint8)
            out.append({"width": int(r["width"]), "height": int(r["height"]), "pixels": g.tobytes()})
        return pd.DataFrame(out, columns=["width", "height", "pixels"])

    return df.select("doc_id", luma("image").alias("image")).withColumn("error_kind", F.when(F.col("image.width").isNull(), UNDECODED))


def dictionary_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a recognition dictionary: some thousand characters at most, so they may reach the driver."""
    return [r.value for r in spark.read.text(_guard(path)).coalesce(1).collect()]
