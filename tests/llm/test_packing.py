"""Bounds against trying all of them; batches keep the budget and every document once."""

import itertools
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from slipmill.llm import packing as P


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=30), st.integers(1, 5))
def test_bounds_are_optimal(lengths, k):
    count = Counter(lengths)
    bounds = P.optimal_bounds(np.array(list(count)), np.array(list(count.values())), k)
    rest = sorted(set(lengths))[:-1]
    best = min(padding(lengths, [*c, max(lengths)]) for n in range(k) for c in itertools.combinations(rest, n))
    assert len(bounds) <= k and bounds[-1] == max(lengths) and padding(lengths, bounds) == best


def test_pack(spark):
    rows = [(i, "w " * (i * 7 % 50)) for i in range(300)] + [(7, "w " * 3), (7, "w " * 3), (None, None), (None, "a b"), (500, "w " * 400), (501, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int")
    got = P.pack(docs, buckets=4, budget=200, slice_rows=40).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len((t or "").split())) for i, t in rows)
    batches = {}
    for r in got:
        assert r.padding == r.bucket - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r.place)
    for (bucket, _), places in batches.items():
        assert sorted(places) == list(range(len(places))) and (len(places) == 1 or bucket * len(places) <= 200)
    for bucket in {r.bucket for r in got}:
        full = max(1, 200 // max(bucket, 1))
        sizes = [len(v) for (b, _), v in sorted(batches.items()) if b == bucket]
        assert all(s == full for s in sizes[:-1])


def test_coarse_histogram_and_tokenizer(spark):
    docs = spark.createDataFrame([(i, "x " * (i * 37 % 900)) for i in range(200)], "doc_id long, text string")
    got = P.pack(docs, buckets=3, fine=64).collect()
    assert len(got) == 200 and all(r.padding >= 0 for r in got)
    assert {r.n_tokens for r in P.pack(docs, tokens=len).collect()} == {2 * (i * 37 % 900) for i in range(200)}
    assert P.pack(docs.limit(0)).collect() == []
