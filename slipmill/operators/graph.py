"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, computed once, in the folder that spark.checkpoint.dir names; they survive lost executors. Only a session that is one process may leave the setting out."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """node and least (the smallest node that it reaches) of every node of edges (a, b) but the least ones themselves. Nodes are of any type that has an order.

    In a round every node's larger neighbours are joined to its least one, then its smaller ones; chains of n edges take about log n rounds. The least neighbour is found by a
    grouping that adds up in the tasks first, so a node with very many edges is no hot row; the join back is one that AQE splits."""
    pairs = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(most):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
        links = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))
        pairs = kept(large.join(down, F.col("a") == F.col("c")).select(F.explode(links).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
