"""Exact votes against a plain reading; training on bounded labels."""

import os

import numpy as np
import pytest

from slipmill.llm import quality_knn as Q


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    good = [" ".join("".join(rng.choice(list("aeinrst"), 5)) for _ in range(40)) + "." for _ in range(n)]
    bad = [" ".join("".join(rng.choice(list("AEINRST"), 5)) + "!!" for _ in range(40)) for _ in range(n)]
    return good, bad


def test_votes_are_those_of_a_plain_reading():
    good, bad = texts(30)
    model = Q.fit(np.stack([Q.counts(t) for t in good + bad]), [1] * 30 + [0] * 30, dims=8)
    asked = texts(5, 2)[0] + texts(5, 2)[1] + ["Mixed TEXT of both!! kinds", None, "", good[0]]
    got = Q.votes(model, asked, voters=7)
    for text, score in zip(asked, got):
        raw = Q.counts(text) * model["idf"]
        for block in Q.BLOCKS:
            raw[block] /= np.linalg.norm(raw[block]) or 1
        v = raw @ model["project"]
        if not v.any():
            assert score == 0.5
            continue
        near = model["near"] @ (v / np.linalg.norm(v)).astype(np.float32)
        top = sorted(range(60), key=lambda i: (-near[i], i))[:7]
        w = np.maximum(near[top], 0).astype(float) ** 4 + 1e-9
        np.testing.assert_allclose(score, (w * model["label"][top]).sum() / w.sum(), atol=1e-4)
    assert (got[:5] > 0.9).all() and (got[5:10] < 0.1).all()


def test_train_and_score(spark):
    good, bad = texts(20)
    rows = [(i, t, i) for i, t in enumerate(good + bad)] + [(100, None, 0), (None, good[0], 0), (101, "", 0), (3, good[3], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)] + [(100, None, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F
    model = Q.train(docs, labels, F.col("doc_id") % 3 != 1)
    got = {(r.doc_id, i): r.score for i, r in enumerate(Q.score(docs, model).collect())}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all((s >= 0.5) == (i < 20) for (i, _), s in got.items() if i is not None and i < 40)
    none = Q.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5} and Q.score(docs.limit(0), model).collect() == []


def test_words_count_beside_shape():
    one, two = Q.counts("the garden was lovely today"), Q.counts("xyz qqqqqq zzz kkkkkk ppppp")
    assert (one[Q.BLOCKS[2]] == two[Q.BLOCKS[2]]).all() and not (one[Q.BLOCKS[0]] == two[Q.BLOCKS[0]]).all() and not (one[Q.BLOCKS[1]] == two[Q.BLOCKS[1]]).all()


def test_space_holds_the_largest_singular_vectors():
    rng = np.random.default_rng(4)
    topics = np.abs(rng.normal(size=(5, Q.WIDTH))) * (rng.random((5, Q.WIDTH)) < 0.02)
    x = (rng.random((60, 5)) ** 3 @ topics + 0.01 * rng.random((60, Q.WIDTH))).astype(np.float32)
    model = Q.fit(x.copy(), [1] * 60, dims=5)
    w = Q._weighted(x, model["idf"])
    best = (np.linalg.svd(w, compute_uv=False)[:5] ** 2).sum()
    assert ((w @ model["project"]) ** 2).sum() > 0.98 * best


def test_held_out_documents_of_the_tables(spark):
    at = "/root/testdata/sf0.01"
    if not os.path.isdir(at):
        pytest.skip("no tables")
    from slipmill.llm.queries import op2_quality

    labels = spark.read.parquet(f"{at}/labels.parquet")
    rows = op2_quality(spark, at).where("held_out").join(labels, "doc_id").where("quality is not null").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.97
