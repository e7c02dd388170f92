"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, as spark.checkpoint.dir names it. Only a session that is one process
    (local[...]) may leave it out: it gets a folder of its own. A cluster without the setting is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


#: Most rows of two longs that are broadcast (16 MB); beyond it the join shuffles.
SMALL = 500_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, cut, and marked for broadcast if it has no more than so many rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def map_rows(df: DataFrame, rows: Callable[[list[dict]], dict[str, list]], schema: str, columns: list[str]) -> DataFrame:
    """mapInArrow over the named columns. rows gets a dict of column lists for a bounded slice and returns column lists.

    Slices hold at most 512 rows, so a task's Python memory is bounded by Spark's Arrow batch size, not by its partition.
    """
    spark = df.sparkSession
    target = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = rows({name: part.column(i).to_pylist() for i, name in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, target)


def words_of(text):
    """Native: the array of words `[^\\x20\\x09-\\x0D]+` of a text column; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def keep_rows(df: DataFrame, keep: Callable[[list], list[bool]], column: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, for whose value of one column keep says so; no shuffle."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def settled(column):
    """column, in a projection that filters stay above: pushed below, they would compute long chains of expressions anew for each name
    they mention."""
    return F.when(F.monotonically_increasing_id() >= 0, column)
