"""The field's marginals against brute force, and its learning."""

import itertools

import numpy as np
import pytest

from slipmill.llm import toxicity as T


def brute(unary, trans):
    n, out, pairs, total = len(unary), np.zeros(len(unary)), np.zeros((2, 2)), 0.0
    for states in itertools.product((0, 1), repeat=n):
        s = sum(u * x for u, x in zip(unary, states)) + sum(trans[a, b] for a, b in zip(states, states[1:]))
        w = np.exp(s)
        total += w
        out += w * np.array(states)
        for a, b in zip(states, states[1:]):
            pairs[a, b] += w
    return out / total, pairs / total


@pytest.mark.parametrize("length", [1, 2, 3, 128])
def test_marginals_are_exact(length):
    rng = np.random.default_rng(3)
    trans = rng.normal(size=(2, 2))
    unary = [rng.normal(size=n) * 2 for n in (5, 0, 9, 1, 7)]
    pairs, expected = np.zeros((2, 2)), np.zeros((2, 2))
    got = T.marginals(unary, trans, pairs, length)
    for u, p in zip(unary, got):
        if len(u):
            want, more = brute(u, trans)
            expected += more
            np.testing.assert_allclose(p, want, atol=1e-9)
        else:
            assert len(p) == 0
    np.testing.assert_allclose(pairs, expected, atol=1e-8)


def test_no_text():
    assert [len(p) for p in T.marginals([np.zeros(0)], np.zeros((2, 2)))] == [0]


def test_score_of_planted_words(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    prose = lambda n: " ".join("".join(rng.choice(list("abdeilnorst"), 4)) for _ in range(n))
    rows = [(i, prose(40) + (" idiot " + prose(10) + " clown! " + prose(10) if i < 40 else "")) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "an idiot and a clown"), (3, rows[3][1]), (502, prose(60_000))]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1, int(i < 40)) for i in range(100)] + [(500, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = T.train(docs, labels, F.lit(True))
    got = {(r.doc_id, k): r for k, r in enumerate(T.score(docs, model).collect())}
    assert len(got) == len(rows)
    for (i, k), r in got.items():
        text = rows[k][1] or ""
        assert (r.score >= 0.5) == ("idiot" in text)
        assert [text[s.start : s.end] for s in r.spans] == [w for w in text.split() if w.strip("!") in ("idiot", "clown")]
    assert T.keep_clean(docs, model).count() == sum("idiot" not in (t or "") for _, t in rows)
    none = T.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in T.score(docs, none).collect()} == {0.0} and T.keep_clean(docs, none).count() == len(rows)
    assert T.score(docs.limit(0), model).collect() == []


def test_every_token_of_the_sample_is_learnt(monkeypatch):
    seen = []
    real = T.marginals
    monkeypatch.setattr(T, "marginals", lambda unary, *a, **k: seen.append(sum(map(len, unary))) or real(unary, *a, **k))
    toxic = ["good " * 300 + "you idiot " * 6 + "fine " * 200] * 3
    clean = [f"word{i} plain text here " * 40 for i in range(5)]
    T.fit(toxic, clean, rounds=1)
    assert seen[0] == sum(len(t.split()) for t in toxic + clean)


def test_sample_is_bounded_in_characters(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, ("idiot " if i % 2 else "fine ") * (10_000 if i < 4 else 5)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    assert T.train(docs, labels, F.lit(True), chars=2000)["line"] is not None
    assert T.train(docs, labels, F.lit(True), chars=2)["line"] is None


def test_held_out_documents_of_the_tables(spark):
    import os

    at = "/root/testdata/sf0.1"
    if not os.path.isdir(at):
        pytest.skip("no tables")
    from slipmill.llm.queries import op3_toxicity

    labels = spark.read.parquet(f"{at}/labels.parquet")
    rows = op3_toxicity(spark, at).where("held_out").join(labels, "doc_id").where("toxic is not null").collect()
    right = {k: np.mean([r.predicted == k for r in rows if r.toxic == k]) for k in (0, 1)}
    assert right[0] >= 0.97 and right[1] >= 0.8
