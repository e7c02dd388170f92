"""Leaks against a comparison of every window with every window."""

import random

from slipmill.llm import decontamination as D


def brute(text, items):
    words, out = D.tokens(text), set()
    for i, t in items:
        item = D.tokens(t)
        n = min(D.WINDOW, len(item))
        if n and any(sum(a != b for a, b in zip(words[x : x + n], item[y : y + n])) <= int(n * D.TOLERANCE)
                     for x in range(len(words) - n + 1) for y in range(len(item) - n + 1)):
            out.add(i)
    return out


def world(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 4, 6, 9, 12, 14, 20, 30])))) for i in range(40)] + [(90, None), (91, " . "), (5, "w1 w2 w3 w4 w5")]
    docs = [(-1, None), (-2, ""), (-3, "w1"), (None, items[7][1])]
    for k in range(150):
        body = rng.choices(words, k=rng.randrange(0, 40))
        if k % 2:
            part = D.tokens(rng.choice(items[:40])[1])
            for _ in range(rng.randrange(5)):
                part[rng.randrange(len(part))] = "other"
            body[len(body) // 2 : len(body) // 2] = part
        docs.append((k, ", ".join(body).upper()))
    return docs, items


def test_leaks_are_those_of_brute_force(spark):
    docs, items = world(3)
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d or 0, sorted(brute(t, items))) for d, t in docs)
    for block in (10_000, 60):
        got = sorted((r.doc_id or 0, sorted({x.item_id for x in r.leaks})) for r in D.leaks(frame, bench, block).collect())
        assert got == want
    kept = D.clean(frame, bench)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, w in want if not w)
    assert any(w for _, w in want) and any(not w for _, w in want)


def test_spans():
    text = "a b c " + " ".join(f"t{i}" for i in range(20)) + " z"
    index = D.index([(4, " ".join(f"t{i}" for i in range(20)))])
    assert D.search(index, [text, None, "nothing"]) == [[(0, 3 - 2, 23 + 1)], [], []] or D.search(index, [text])[0][0][1] <= 3


def test_empty(spark):
    docs = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(docs, none).collect()[0].leaks == [] and D.clean(docs, none).count() == 1
    assert D.leaks(docs.limit(0), spark.createDataFrame([(1, "x")], "item_id long, text string")).collect() == []
