"""Packing documents into token-budget batches inside optimal length buckets.

A global histogram of lengths (one row a length, whatever the corpus) is all the driver sees. Dynamic programming over it
picks the ``buckets`` upper bounds that minimise the padding, exactly; a document is padded to its bucket's bound. A
bucket's batches hold as many documents as fit ``budget`` padded tokens, at least one.

A document's batch is its rank in the bucket divided by the batch's capacity. Ranks come from two levels: rows are numbered
within a bucket and one of its slices (by hash of the row, so a bucket with a third of all rows is many slices), and slices
are offset by the counts before them. Rows that are equal have one hash; if they fill a slice beyond four times ``slice_rows``,
rows are dealt by their place in the table instead. Only ids and lengths are shuffled.

The histogram is exact, one row a length. For corpora with more lengths than a driver should hold, ``fine`` counts those over
it in steps of 1/256 of a power of two; the bounds are then the longest true lengths in their step.

Defined cases: null and empty texts have no tokens and go to the first bucket; a document longer than the budget has a
batch of its own; repeated rows are packed each; null doc_ids are packed first in their slice; other columns do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmill.llm._shared import cut, map_rows, words_of

#: Number of buckets, padded tokens in a batch, rows of a slice.
BUCKETS, BUDGET, SLICE = 16, 65_536, 50_000


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, ascending, at most ``buckets``, the last the largest length: least sum of (bound - length) * count.

    The cost of a bucket over a stretch of lengths fulfils the quadrangle inequality, so the best split of each prefix moves
    to the right only: divide and conquer, O(buckets * n * log n).
    """
    order = np.argsort(lengths)
    x, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    if not len(x):
        return []
    rows, mass = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * x)))

    def cost(a: np.ndarray, b: int) -> np.ndarray:
        """Padding of lengths a to b - 1 in one bucket."""
        return x[b - 1] * (rows[b] - rows[a]) - (mass[b] - mass[a])

    best, choice = np.array([0, *(int(cost(np.array(0), b)) for b in range(1, len(x) + 1))]), []
    for _ in range(min(buckets, len(x)) - 1):
        after, took = best.copy(), np.zeros(len(x) + 1, np.int64)
        stack = [(1, len(x), 0, len(x) - 1)]
        while stack:
            low, high, first, last = stack.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            a = np.arange(first, min(last, mid - 1) + 1)
            value = best[a] + cost(a, mid)
            k = int(np.argmin(value))
            after[mid], took[mid] = value[k], a[k]
            stack += [(low, mid - 1, first, int(a[k])), (mid + 1, high, int(a[k]), last)]
        best = after
        choice.append(took)
    bounds, at = [int(x[-1])], len(x)
    for took in reversed(choice):
        at = int(took[at])
        if at == 0:
            break
        bounds.append(int(x[at - 1]))
    return bounds[::-1]


def token_counts(docs: DataFrame, tokens: Column | Callable[[str], int] | None = None) -> DataFrame:
    """doc_id, n_tokens (long) and spread (a hash of the row). tokens: a column, or a Python function of a text (a
    tokenizer's count); by default the words of a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spread = F.xxhash64("doc_id", text).alias("spread")
    if callable(tokens) and not isinstance(tokens, Column):
        rows = lambda b: {"doc_id": b["doc_id"], "n_tokens": [tokens(t) for t in b["text"]], "spread": b["spread"]}
        return map_rows(docs.select("doc_id", text.alias("text"), spread), rows, "doc_id long, n_tokens long, spread long", ["doc_id", "text", "spread"])
    n = F.size(words_of(text)) if tokens is None else tokens
    return docs.select("doc_id", n.cast("long").alias("n_tokens"), spread)


def _step(n: Column, fine: int) -> Column:
    """The cell of the histogram that a length falls into."""
    width = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)))) - 8)
    return F.when(n <= fine, n).otherwise((F.ceil(n / width) * width).cast("long"))


def pack(docs: DataFrame, tokens: Column | Callable[[str], int] | None = None, buckets: int = BUCKETS, budget: int = BUDGET,
         slice_rows: int = SLICE, fine: int | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket (its bound), batch (number within the bucket), place (in the batch) and padding of every document."""
    sized = cut(token_counts(docs, tokens).withColumn("row", F.monotonically_increasing_id()))
    cells = sized.groupBy((_step(F.col("n_tokens"), fine) if fine else F.col("n_tokens")).alias("cell")).agg(F.max("n_tokens").alias("top"), F.sum("n_tokens").alias("mass"), F.count("*").alias("n"))
    histogram = cells.orderBy("cell").collect()
    bounds = optimal_bounds(np.array([r.top for r in histogram], np.int64), np.array([r.n for r in histogram], np.int64), buckets)
    total = sum(r.n for r in histogram)
    bound = F.lit(bounds[-1] if bounds else 0)
    for b in reversed(bounds[:-1]):
        bound = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bound)
    slices = max(1, -(-total // slice_rows))
    dealt = sized.withColumns({"bucket": bound.cast("long"), "slice": F.pmod(F.xxhash64("row"), F.lit(slices))})  # rows that are alike are dealt out too

    inside = Window.partitionBy("bucket", "slice").orderBy(F.col("doc_id").asc_nulls_first(), "spread", "n_tokens")
    counts = dealt.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1)))).cast("long")
    ranked = dealt.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["bucket", "slice"]).withColumn("rank", F.col("start") + F.col("at"))
    return ranked.select("doc_id", "n_tokens", "bucket", F.floor(F.col("rank") / capacity).cast("long").alias("batch"),
                         F.pmod("rank", capacity).alias("place"), (F.col("bucket") - F.col("n_tokens")).alias("padding"))
