"""The corpus pipeline: toxic documents go, near copies go, benchmark leaks go, secrets are masked, the rest is packed.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next stage's docs. All but the last return the columns of ``documents``; masking counts n_chars anew.

Defined cases, in every stage: null and empty texts are not toxic, hold no leak and no secret, and have no tokens; of all of them
one document stays after near_dedup. Repeated rows are judged alike, and one of them stays after near_dedup; ties between copies go to
the smallest doc_id, a null doc_id stays only if no numbered copy does. Other columns are carried along, whatever their names. Empty
tables give empty results; without labels nothing is toxic, without a benchmark nothing leaks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipmill.llm import decontamination, near_copies, packing, secrets, toxicity
from slipmill.llm._shared import shared_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half. The field learns from labelled documents of the training folds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return toxicity.keep_clean(docs, toxicity.train(docs, labels, fold != 0))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each component of texts whose five-word shingles are similar to 0.8 or more: copies
    within 4 bits by SimHash and vantage-point trees, the others by MinHash buckets, every link verified."""
    return near_copies.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mask."""
    return secrets.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and place of every document."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("decontamination", without_leaks),
    ("secrets", masked_secrets),
    ("packing", packed),
]

#: Not expressible in SQL (a trained field, SimHash, dynamic programming); tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
