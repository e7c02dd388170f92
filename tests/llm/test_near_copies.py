"""Near copies of 0.8 and more go, texts below stay; classes against brute force over whole sets."""

import random

import numpy as np

import corpus_pipeline
from slipmill.llm import near_copies as N


def plain_set(text):
    words = (text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = plain_set(a), plain_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(30):
        text = rng.choices(words, k=200)
        rows.append(text)
        for k in range(8):
            copy = list(rng.choice(rows[-(k + 1) :]))
            for _ in range(rng.randrange(1, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def survivors(rows):
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {rows[i][0] for i in range(len(rows)) if root(i) == i}


def test_stage_drops_copies_of_eight_tenths(spark):
    rng = random.Random(3)
    rows = []
    for k in range(20):
        text = [f"t{rng.randrange(5000)}" for _ in range(300)]
        rows.append((2 * k, " ".join(text)))
        for at in range(5, 300, 300 // (1 + k % 5)):
            text[at] = f"new{k}"
        rows.append((2 * k + 1, " ".join(text)))
    measured = [jaccard(rows[2 * k][1], rows[2 * k + 1][1]) for k in range(20)]
    assert all(0.8 <= j < 1 for j in measured) and min(measured) < 0.87
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.without_near_copies(spark, docs, "")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {2 * k for k in range(20)}


def test_against_brute_force(spark):
    rows = corpus(1)
    want = survivors(rows)
    assert 30 < len(want) < len(rows) - 30
    assert {r.doc_id for r in N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_large_buckets_in_tiles(spark, monkeypatch):
    for name, value in (("FEW", 2), ("TURNS", 0), ("TILE", 3)):
        monkeypatch.setattr(N, name, value)
    rows = corpus(2)[:90]
    assert {r.doc_id for r in N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == survivors(rows)


def test_common():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 5, 800, 7000, 6500, 3)]
    want = [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:4]]
    assert (N.common(sets[:4], sets[2:]) == np.array(want)).all()


def test_rows_are_known_by_id_and_text(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text), (3, text), (9, "other words that stand alone here"), (9, "quite another text of the same number again"),
            (None, text), (None, None), (None, ""), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(*r, k, k, k, k) for k, r in enumerate(rows)], "doc_id long, text string, sh long, _gone_id long, _id long, th long")
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or -1, r.text or "") for r in kept.collect())
    assert got == sorted([(3, text), (9, rows[2][1]), (9, rows[3][1]), (-1, ""), (5, "twice")])
    assert N.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []
