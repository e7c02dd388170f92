"""The native counts against a plain reading of their definition."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slipmill.llm import quality_rules as R


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


CASES = [None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "a " * 30, "x\ny\nx\n\n \nx", "é ## $ <b> |   z",
         "one two three four five six seven eight nine " * 3 + "ten", "\x0b a\x0cb\r\nc", "日本 語 " * 12, "w " * 5000]


def test_counts(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(None, "a b"), (3, "a")]
    got = R.base_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(r.text), r.text


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c\n", "d"]), max_size=60), min_size=20, max_size=40))
def test_counts_of_random_words(spark, texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for r in R.base_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(r.text), r.text


def test_ratio_is_the_mean_over_all_grams(spark):
    import math

    import xxhash

    docs = [(1, "the cat sat " * 10), (2, "||| ### $$$ " * 12), (3, None), (4, "the dog ran far " * 9), (None, "the")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (2, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    h = lambda x, seed=42: xxhash.xxh64_intdigest(x.encode(), seed)

    def grams(text):
        w = (text or "").split()
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        return [signed(h(x)) % 64 for x in w] + [signed(h(b, h(a))) % 64 for a, b in zip(w, w[1:])]

    learnt = {r.doc_id for r in R.trusted_ids(labels, True).collect()}
    assert learnt and learnt | {r.doc_id for r in R.trusted_ids(labels, False).collect()} == {1, 4}
    raw, good = [0] * 64, [0] * 64
    for i, t in docs:
        for g in grams(t):
            raw[g] += 1
            good[g] += i in learnt
    want = [math.log((good[b] + 5 * 64 * raw[b] / sum(raw)) / ((sum(good) + 5 * 64) * raw[b] / sum(raw))) if raw[b] else 0.0 for b in range(64)]
    got = {r.doc_id: r for r in R.judge(frame, labels, buckets=64).collect()}
    for i, t in docs:
        g = grams(t)
        assert got[i].llr == pytest.approx(sum(want[b] for b in g) / max(1, len(g)), abs=1e-4)
    assert got[2].llr < 0 < max(got[i].llr for i in learnt)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert R.judge(none, labels).collect() == []


def test_threshold_and_verdict(spark):
    rng = random.Random(2)
    good = [(i, " ".join(f"word{rng.randrange(60)}" for _ in range(60))) for i in range(400)]
    bad = [(1000 + i, " ".join(f"#junk{rng.randrange(60)}|" for _ in range(60))) for i in range(10)]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in good + bad], "doc_id long, text string, _words string, llr double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(1000, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = R.judge(docs, labels).collect()
    assert {r.doc_id for r in rows if r.kept} == {i for i, _ in good} and not any(r.base_failed for r in rows)
    least = R.own_threshold(docs, labels, R.bucket_ratios(docs, labels))
    assert all((r.llr >= least) == r.kept for r in rows)
    alone = R.judge(docs, labels.where("quality = 0")).collect()
    assert all(r.kept and r.llr == 0 for r in alone)
    assert {r.kept for r in R.judge(docs, labels, threshold=99.0).collect()} == {False}


def test_threshold_comes_from_all_of_the_tenth(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(900)}" for _ in range(24))) for i in range(600)], "doc_id long, text string").coalesce(2)
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    ratios = [rng.uniform(-1, 1) for _ in range(64)]
    ids = {r.doc_id for r in R.trusted_ids(labels, False).collect()}
    llr = sorted(r.llr for r in R.figures(docs, ratios).collect() if r.doc_id in ids and not r.base_failed)
    at = lambda q: llr[int(p := q * (len(llr) - 1))] + (p - int(p)) * (llr[min(int(p) + 1, len(llr) - 1)] - llr[int(p)])
    assert len(llr) > 30 and abs(R.own_threshold(docs, labels, ratios) - (at(0.5) - 2 * (at(0.5) - at(R.LOW)))) < 1e-9


def test_threshold_comes_from_all_trusted_documents_unlearnt(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(24))) for i in range(40)] + [(100 + i, " ".join(f"#x{rng.randrange(90)}|" for _ in range(24))) for i in range(9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    tenth = {r.doc_id for r in R.trusted_ids(spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int"), False).collect()}
    trusted = [i for i in range(40) if i not in tenth]  # none in the tenth: there was no threshold
    labels = spark.createDataFrame([(i, 1) for i in trusted], "doc_id long, quality int")
    fold = {r.doc_id: r.fold for r in R.trusted_ids(labels).collect()}
    assert set(fold) == set(trusted) and len(set(fold.values())) > 1
    own = {}
    for k in set(fold.values()):
        rest = spark.createDataFrame([(i, 1) for i in trusted if fold[i] != k], "doc_id long, quality int")
        own |= {r.doc_id: r.llr for r in R.figures(frame, R.bucket_ratios(frame, rest, 256)).collect() if fold.get(r.doc_id) == k}
    assert set(own) == set(trusted)
    llr = sorted(own.values())
    at = lambda q: llr[int(p := q * (len(llr) - 1))] + (p - int(p)) * (llr[min(int(p) + 1, len(llr) - 1)] - llr[int(p)])
    least = at(0.5) - 2 * (at(0.5) - at(R.LOW))
    ratios = R.bucket_ratios(frame, labels, 256)
    assert R.own_threshold(frame, labels, ratios) == pytest.approx(least, abs=1e-4)
    got = R.judge(frame, labels, buckets=256).collect()
    assert all(r.kept == (r.llr >= least) for r in got if abs(r.llr - least) > 1e-4) and not any(r.kept for r in got if r.doc_id >= 100)
    assert {r.doc_id: r.llr for r in got} == pytest.approx({r.doc_id: r.llr for r in R.figures(frame, ratios).collect()})
