"""Native quality rules: base counts and a hashed n-gram likelihood ratio between trusted and raw text.

Every word (n = 1) and word pair (n = 2) of a text falls into one of ``buckets`` by XXH64. Two multinomials are
estimated over the buckets: the raw one over all documents, the trusted one over all labelled documents of quality 1 (their ids are broadcast up to a
checked number, else joined), smoothed towards the raw one by ``prior`` pseudo-counts a bucket. A document's figure is the mean over its n-grams of log(trusted / raw); it
is kept if the base rules pass and the figure is at least a threshold. The ratios (``buckets`` numbers) are one literal array.

The threshold comes from all trusted documents: each gets a second figure from the ratios of the other folds (FOLDS, by a hash of the doc_id), which have not learnt from it. It is as
far below the median of these as twice the distance of their quantile ``low``, so what is twice as odd as the oddest trusted text is dropped. A number may be given
instead.

Everything is DataFrame expressions; no text is shuffled: only bucket counts are.

Defined cases: null and empty texts have no words and fail the base rules; without trusted rows the ratio
is 0 and the base rules alone decide; with one alone its own figure, which has learnt from nothing, is 0; repeated rows and null doc_ids are judged as they stand; of repeated labels the largest counts;
other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmill.llm._shared import cut, settled, small, words_of

BUCKETS, PRIOR, LOW, WINDOW, FOLDS = 1 << 14, 5.0, 0.001, 8, 5


def _after(values: Column, gap: int, size: Column) -> Column:
    """A hash of each value and the one gap places after it, for as many values as have one; size is that of values."""
    return F.transform(F.slice(values, 1, F.greatest(size - gap, F.lit(0))), lambda v, i: F.xxhash64(v, F.get(values, i + gap)))


def grams(words: Column, pairs: Column, buckets: int = BUCKETS) -> Column:
    """Bucket numbers of all words and of all pairs of neighbours (given as hashes)."""
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    return F.concat(F.transform(words, lambda w: bucket(F.xxhash64(w))), F.transform(pairs, bucket))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the helper columns _words and _pairs."""
    text, size = F.coalesce(F.col("text"), F.lit("")), F.size("_words")
    out = docs.withColumn("_words", words_of(F.col("text"))).withColumns({
        "n_words": size.cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        "_pairs": _after(F.col("_words"), 1, size),
    })
    # A window of eight is two fours, a four two pairs: no word is hashed again.
    out = out.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_fours": F.when(F.col("n_words") >= WINDOW, _after(F.col("_pairs"), 2, F.size("_pairs"))),
    }).drop("_lines")
    out = out.withColumn("_windows", _after(F.col("_fours"), 4, F.size("_fours"))).drop("_fours")
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    out = out.withColumn("_twice", F.sort_array(F.transform(F.filter("_sorted", lambda x, k: (
        x["h"] == F.get(F.col("_sorted"), k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(F.col("_sorted"), F.greatest(k - 1, F.lit(0)))["h"]))),
        lambda x: x["i"]))).drop("_sorted")
    covered = F.transform("_twice", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_twice"), k + 1) - p, F.lit(WINDOW))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_twice")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def trusted_ids(labels: DataFrame, learnt: bool | None = None) -> DataFrame:
    """doc_id and fold of rows of quality 1, once: all, or those outside (learnt) or inside the first tenth of a hash."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    some = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    if learnt is not None:
        some = some.where(part != 0 if learnt else part == 0)
    return some.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))


def _counted(docs: DataFrame, trusted: DataFrame, buckets: int) -> list:
    """bucket, raw and good (of each fold) of all buckets that occur. The driver gets one row of counts a bucket, whatever the corpus."""
    marked = docs.select("doc_id", words_of(F.col("text")).alias("w")).withColumn("p", _after(F.col("w"), 1, F.size("w"))).join(trusted, "doc_id", "left")
    each = marked.select("fold", F.explode(grams(F.col("w"), F.col("p"), buckets)).alias("bucket")).groupBy("bucket")
    return each.agg(F.count("*").alias("raw"), F.array(*(F.count_if(F.col("fold") == k) for k in range(FOLDS))).alias("good")).collect()


def _ratios(counts: list, buckets: int, prior: float, without: int | None = None) -> list[float]:
    """log(trusted / raw) of each bucket, learnt from all folds but one."""
    learnt = [sum(n for k, n in enumerate(r.good) if k != without) for r in counts]
    out, raw, good, mass = [0.0] * buckets, sum(r.raw for r in counts), sum(learnt), prior * buckets
    for r, n in zip(counts, learnt, strict=True):
        share = r.raw / raw
        out[r.bucket] = math.log((n + mass * share) / ((good + mass) * share))
    return out


class Ratios(list):
    """Ratios learnt from all trusted documents, with those that each fold's documents are judged by: learnt from the other folds."""

    others: list[list[float]]


def bucket_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> Ratios:
    """log(trusted / raw) of each bucket."""
    counts = _counted(docs, small(trusted_ids(labels)), buckets)
    out = Ratios(_ratios(counts, buckets, prior))
    out.others = [_ratios(counts, buckets, prior, k) for k in range(FOLDS)]
    return out


def _values(ratios: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")


def figures(docs: DataFrame, ratios: list[float], others: list[list[float]] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed and llr (mean log ratio) of every document; with others (ratios for each fold) also own, the llr by those of its fold (null: no fold)."""
    base = base_counts(docs.select("doc_id", "text", *(["fold"] if others else []))).withColumn("_grams", grams(F.col("_words"), F.col("_pairs"), len(ratios)))
    mean = lambda values, at: F.aggregate("_grams", F.lit(0.0), lambda a, g: a + F.get(values, g + at)) / F.greatest(F.size("_grams"), F.lit(1))
    own = [F.when(F.col("fold").isNotNull(), mean(_values([x for o in others for x in o]), F.col("fold") * len(ratios))).alias("own")] if others else []
    return base.withColumn("llr", mean(_values(ratios), F.lit(0))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", *own)


def _least(seen: DataFrame, column: str, low: float) -> float:
    """What no figure of a trusted document that passes the base rules comes near: their median less twice its distance from the quantile low."""
    found = seen.where("not base_failed").agg(F.percentile(column, F.array(F.lit(0.5), F.lit(low))).alias("q")).first().q
    return found[0] - 2 * (found[0] - found[1]) if found else -math.inf


def own_threshold(docs: DataFrame, labels: DataFrame, ratios: list[float], low: float = LOW) -> float:
    """The threshold from all trusted documents, each judged by ratios that have not learnt from it, as bucket_ratios() has them. Of other ratios nothing is known but
    themselves: theirs comes from the first tenth, which they must not have learnt from."""
    others = getattr(ratios, "others", None)
    drawn = small(trusted_ids(labels, None if others else False))
    # Cut on both sides: a filter, or a join's conditions, among the long projections would compute them anew for each name they mention.
    seen = cut(figures(cut(docs.select("doc_id", "text").join(drawn, "doc_id")), ratios, others).select("base_failed", "own" if others else "llr"))
    return _least(seen, "own" if others else "llr", low)


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the base counts, base_failed, llr (mean log ratio) and kept of every document. Without a threshold the figures (some numbers a document) are computed once and
    kept in the shared folder, as own_threshold() depends on those of the trusted documents among them."""
    ratios = bucket_ratios(docs, labels, buckets)
    if threshold is None:
        seen = cut(figures(docs.select("doc_id", "text").join(small(trusted_ids(labels)), "doc_id", "left"), ratios, ratios.others))
        found, threshold = seen.drop("own"), _least(seen.where("own is not null"), "own", LOW)
    else:
        found = figures(docs, ratios)
    return found.select("*", settled(~F.col("base_failed") & (F.col("llr") >= F.lit(float(threshold)))).alias("kept"))
