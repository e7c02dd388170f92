"""Sequence decoding of recognition scores (an array of steps, each an array of class scores), as native columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The best path of a sequence, step by step of one class: the class, the score of its first step, how many steps.
PATH = "array<struct<c:int,score:float,n:int>>"


def steps(flat: Column, n: int, classes: int) -> Column:
    """A flat array cut into whole steps, at most n."""
    whole = F.least(F.floor(F.size(flat) / classes), F.lit(n))
    return F.when(whole > 0, F.transform(F.sequence(F.lit(0), (whole - 1).cast("int")), lambda t: F.slice(flat, t * classes + 1, F.lit(classes)))).otherwise(F.array())


def best(step: Column) -> Column:
    """The class of the largest score, from 0; of equal ones the first."""
    return (F.array_position(step, F.array_max(step)) - 1).cast("int")


def collapsed(scores: Column, dictionary: list[str]) -> Column:
    """struct(ch, score) of the characters that are read: not blank (class 0), not the class of the step before. Classes past the dictionary are
    spaces; empty entries are not read."""
    marks = F.array(*(F.lit(c) for c in dictionary)) if dictionary else F.array().cast("array<string>")
    pairs = F.transform(scores, lambda s: F.struct(best(s).alias("c"), F.array_max(s).alias("score")))
    new = F.filter(pairs, lambda p, i: (p["c"] != 0) & ((i == 0) | (p["c"] != best(F.get(scores, F.greatest(i - 1, F.lit(0)))))))
    read = F.transform(new, lambda p: F.struct(F.coalesce(F.get(marks, p["c"] - 1), F.lit(" ")).alias("ch"), p["score"].cast("double").alias("score")))
    return F.filter(read, lambda r: r["ch"] != "")


def decoded(scores: Column, dictionary: list[str]) -> Column:
    """struct(text, confidence): the characters and the mean of their scores, 0 without any."""
    return _joined(collapsed(scores, dictionary))


def _joined(read: Column) -> Column:
    total = F.aggregate(read, F.lit(0.0), lambda a, r: a + r["score"])
    return F.struct(F.array_join(F.transform(read, lambda r: r["ch"]), "").alias("text"), F.when(F.size(read) > 0, total / F.size(read)).otherwise(F.lit(0.0)).alias("confidence"))


def upside_down(scores: Column) -> Column:
    """Whether the second of two scores, negative ones counted as 0, takes over nine tenths of a softmax."""
    a, b = F.exp(F.greatest(F.get(scores, 0).cast("double"), F.lit(0.0))), F.exp(F.greatest(F.get(scores, 1).cast("double"), F.lit(0.0)))
    return F.coalesce(b / (a + b) > 0.9, F.lit(False))


def best_path(scores: np.ndarray) -> list[tuple[int, float, int]]:
    """The run-length code of the best path of steps x classes scores: some dozen triples instead of all scores."""
    if not scores.size:
        return []
    best = scores.argmax(axis=1)
    starts = np.append(0, 1 + np.flatnonzero(best[1:] != best[:-1]))
    return list(zip(best[starts].tolist(), scores[starts, best[starts]].tolist(), np.diff(np.append(starts, len(best))).tolist(), strict=True))


def decoded_path(path: Column, dictionary: list[str]) -> Column:
    """decoded() of a best path (PATH): each run is one character, as its class differs from that of the step before."""
    marks = F.array(*(F.lit(c) for c in dictionary)) if dictionary else F.array().cast("array<string>")
    read = F.transform(F.filter(path, lambda r: r["c"] != 0), lambda r: F.struct(F.coalesce(F.get(marks, r["c"] - 1), F.lit(" ")).alias("ch"), r["score"].cast("double").alias("score")))
    return _joined(F.filter(read, lambda r: r["ch"] != ""))


def best_classes(scores: np.ndarray) -> list[int]:
    """The classes that best_path() reads, without blanks: all that a text needs."""
    if not scores.size:
        return []
    best = scores.argmax(axis=1)
    new = best != 0
    new[1:] &= best[1:] != best[:-1]
    return best[new].tolist()


def spelled(classes: Column, dictionary: list[str]) -> Column:
    """decoded()'s text of best_classes()."""
    marks = F.array(*(F.lit(c) for c in dictionary)) if dictionary else F.array().cast("array<string>")
    return F.array_join(F.transform(classes, lambda c: F.coalesce(F.get(marks, c - 1), F.lit(" "))), "")


def turned(scores: np.ndarray) -> bool:
    """upside_down() of one row."""
    a, b = np.exp(np.maximum(np.asarray(scores[:2], np.float64), 0))
    return bool(b / (a + b) > 0.9)
