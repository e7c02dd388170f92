"""Target-distribution importance resampling: documents drawn in proportion to how much likelier the target makes their n-grams.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; features are all runs of 1 to ``n`` words, hashed to ``buckets`` buckets by
the CRC-32 of their UTF-8 bytes. A bucket's gain compares its smoothed share of the target with that of the corpus, in thousandths of a nat. A document's
weight is the floored mean of its features' gains; its score adds Gumbel noise from a hash of its id, so the highest scores are a draw without replacement.

Overlap chunking. Texts of over ``chunk`` bytes are split at word boundaries; a chunk owns the words that start in it and carries the next n - 1 words, so
every feature belongs to the chunk that owns its first word. Chunks of long texts are dealt to all tasks, those of short texts (one chunk) stay where
they were read. Counts and gains are summed by document afterwards, from one small row a chunk.

What reaches the driver: one count a bucket of corpus and target, and one count a distinct score (scores are whole thousandths of bounded logarithms, so
there are some ten thousands at any corpus size). Only the drawn rows are sorted; ranks are offsets of their sorted partitions plus places in them.

Defined cases: null and empty texts have no features and weight 0; a null doc_id hashes as the empty text, and stands last among ties; rows that repeat a doc_id are
rows of their own, each drawn or not, and rows of one doc_id and text are alike up to their ranks; documents of under ``least`` words are never drawn; an empty
table gives an empty result, an empty target or corpus counts as zeros; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmill.llm._shared import cut

BUCKETS, WORDS, PERCENT, LEAST, SEED = 10_000, 1, 10, 20, 2024
#: Bytes of text beyond which a document is dealt out in chunks of about as many.
CHUNK = 1 << 16
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text: bytes, n: int, chunk: int) -> Iterator[tuple[bytes, int]]:
    """Chunks of a lower-cased text, each with the number of words it owns: the words that start in its own stretch, and then the n - 1 that it carries."""
    start = 0
    while start < len(text) or not start:
        end = min(start + chunk, len(text))
        if end < len(text) and (inside := _WORD.match(text, end)) and _WORD.match(text, end - 1):
            end = inside.end()  # a word is owned by the chunk that it starts in
        own, after, stop = len(_WORD.findall(text, start, end)), _WORD.finditer(text, end), end
        for _ in range(n - 1):
            if (word := next(after, None)) is None:
                break
            stop = word.end()
        yield text[start:stop], own
        start = end or 1


def hashed(piece: bytes, own: int, n: int, buckets: int) -> np.ndarray:
    """The bucket of every feature whose first word is one of the first own words of a piece."""
    words = _WORD.findall(piece)
    runs = [words[:own], *([b" ".join(words[i : i + k]) for i in range(min(own, len(words) - k + 1))] for k in range(2, n + 1))]
    return np.concatenate([np.fromiter(map(crc32, run), np.int64, len(run)) for run in runs]) % buckets


def chunks(docs: DataFrame, n: int = WORDS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Two tables of doc_id, th (hash of the text), piece (lower-cased bytes), own and copies: the short texts, one chunk a row where they were read, and
    the chunks of long texts, dealt to all tasks, copies the number of rows that have this doc_id and text. Each text has one chunk at least."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, th long, part int, piece binary, own long"
    arrow = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("part", pa.int32()), ("piece", pa.binary()), ("own", pa.int64())])

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for k in range(batch.num_rows):
                doc_id, th, text = (batch.column(i)[k].as_py() for i in range(3))
                for part, (piece, own) in enumerate(split(text.lower(), n, chunk)):
                    found.append((doc_id, th, part, piece, own))
                    held += len(piece)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow, strict=True)], schema=arrow)
                        found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow, strict=True)], schema=arrow)

    size = F.octet_length("text")
    one = rows.where(size <= chunk).mapInArrow(cutting, schema).drop("part").withColumn("copies", F.lit(1).cast("long"))
    many = rows.where(size > chunk).mapInArrow(cutting, schema).groupBy("doc_id", "th", "part").agg(F.first("piece").alias("piece"), F.first("own").alias("own"), F.count("*").alias("copies"))
    return one, many.drop("part")


def bucket_counts(docs: DataFrame, n: int = WORDS, buckets: int = BUCKETS, chunk: int = CHUNK) -> np.ndarray:
    """Features of all texts of docs by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece, own, copies in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                total += np.bincount(hashed(piece, own, n, buckets), minlength=buckets) * copies
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    rows = docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.lit(None).cast("long"))
    one, many = (part.select("piece", "own", "copies").mapInArrow(count, "bucket long, n long") for part in chunks(rows, n, chunk))
    sums = one.union(many).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, total in sums.collect():  # one row a bucket at most
        out[bucket] = total
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of a nat by bucket, floored: log of the smoothed share of the target over that of the corpus."""
    whole, wanted = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1) * whole / ((s + 1) * wanted))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)])


def weights(docs: DataFrame, gain: np.ndarray, n: int = WORDS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one long a bucket

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, gained = np.zeros((2, batch.num_rows), np.int64)
            for k, (piece, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                found = hashed(piece, own, n, len(shared.value))
                features[k], gained[k] = len(found), shared.value[found].sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3)), pa.array(features), pa.array(gained), batch.column(4)], names=["doc_id", "th", "n_words", "n_features", "gain", "copies"])

    sums = ["n_words", "n_features", "gain"]
    one, many = (part.select("doc_id", "th", "piece", "own", "copies").mapInArrow(total, "doc_id long, th long, n_words long, n_features long, gain long, copies long") for part in chunks(docs, n, chunk))
    whole = many.groupBy("doc_id", "th").agg(*(F.sum(c).alias(c) for c in sums), F.max("copies").alias("copies"))
    rows = one.select("doc_id", *sums).union(whole.select("doc_id", *sums, F.explode(F.expr("sequence(1L, copies)")).alias("_copy")).drop("_copy"))
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "n_words", "n_features", weight.alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in floored thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """scored (doc_id, n_words, score and others; cut) with rank: 1, 2, ... for the floor of so many percent of the rows of at least so many words, by score, ties
    to the smaller doc_id; null for the others."""
    able = scored.where(F.col("n_words") >= least)
    by_score = sorted(able.groupBy("score").count().collect(), reverse=True)
    number = percent * sum(c for _, c in by_score) // 100
    above, lowest = 0, None
    for score, count in by_score:
        if above >= number:
            break
        above, lowest = above + count, score
    none = F.lit(None).cast("long").alias("rank")
    if lowest is None:
        return scored.select("*", none)
    candidate = (F.col("n_words") >= least) & (F.col("score") >= lowest)
    tie = F.monotonically_increasing_id()  # spreads rows that are alike; it orders nothing else
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_tie")]
    best = cut(scored.where(candidate).withColumn("_tie", tie).repartitionByRange(*order).sortWithinPartitions(*order))
    best = best.withColumn("_at", F.monotonically_increasing_id())  # partition and place of the rows as they are kept
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = best.groupBy(part.alias("part")).count().sort("part").collect()  # one row a partition
    starts, at = {}, 0
    for p, size in sizes:
        starts[p], at = at, at + size
    offsets = scored.sparkSession.createDataFrame(list(starts.items()), "_part long, _start long")
    placed = best.withColumn("_place", place + 1).join(F.broadcast(offsets), part == F.col("_part"))
    rank = F.col("_start") + F.col("_place")
    drawn = placed.select(*scored.columns, F.when(rank <= number, rank).alias("rank"))
    return drawn.union(scored.where(~candidate).select("*", none))


def resample(docs: DataFrame, target: DataFrame, n: int = WORDS, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs (doc_id, text), drawn towards target (text)."""
    gain = gains(bucket_counts(docs, n, buckets, chunk), bucket_counts(target.select("text"), n, buckets, chunk))
    scored = cut(weights(docs, gain, n, chunk).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return ranked(scored, percent, least)
