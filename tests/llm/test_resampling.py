"""Importance resampling against a plain reading of its definition, over chunks of any size and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from slipmill.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def plain(docs, target, n, buckets, percent, least):
    """(doc_id, n_features, weight, score, rank) of docs (doc_id, text), sorted."""

    def found(text):
        words = WORD.findall((text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    corpus, wanted = Counter(b for _, t in docs for b in found(t)[1]), Counter(b for t in target for b in found(t)[1])
    whole, other = sum(corpus.values()) + buckets, sum(wanted.values()) + buckets
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * whole / ((corpus[b] + 1) * other))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        words, features = found(text)
        weight = sum(gain[b] for b in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def odd(seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "a1", "größe", "日本", "x_y", "12", "déjà", "end.", "--", "Ünder", "q\tr", "s\nt", "u\x00v", "w\x7fx"] + [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 25, 90])))) for k in range(80)]
    docs += [(80, None), (81, ""), (82, " ... "), (None, "null id " * 15), (None, None), (5, docs[5][1]), (5, "other text of a repeated id " * 6)]
    docs += [(90, " ".join(rng.choice(words) for _ in range(3000))), (90, "x" * 5000), (91, ". " * 3000)] + [(92, "one long text that stands twice " * 300)] * 2
    return docs, ["the target has w1 w2 w3 w4", None, "größe 日本 w1", ""]


@pytest.mark.parametrize(("n", "chunk"), [(1, 200), (1, 1 << 16), (2, 64), (3, 500)])
def test_plain_reading(spark, n, chunk):
    docs, target = odd()
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rank string").repartition(5)
    out = resampling.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=500, percent=30, chunk=chunk)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in out.collect()), key=repr) == plain(docs, target, n, 500, 30, 20)


def test_chunks_own_their_words():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab é.") for _ in range(rng.randrange(60))).encode()
        n, chunk = rng.choice([1, 2, 3]), rng.randrange(1, 12)
        words = re.findall(r"[abé]+", text.decode())
        want = Counter(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
        got = Counter()
        for piece, own in resampling.split(text, n, chunk):
            have = re.findall(r"[abé]+", piece.decode())
            got.update(" ".join(have[i : i + n]) for i in range(min(own, len(have) - n + 1)))
        assert got == want


def test_ranks_over_ties_and_many_partitions(spark):
    rows = [(k % 50, 30, 7) for k in range(400)] + [(k, 30, k % 5) for k in range(100, 300)] + [(1000, 3, 99)]
    table = spark.createDataFrame(rows, "doc_id long, n_words long, score long").repartition(7)
    got = resampling.ranked(resampling.cut(table), percent=80, least=20).collect()
    able = sorted(((-s, i) for i, n, s in rows if n >= 20))
    assert sorted((r["rank"], -r.score, r.doc_id) for r in got if r["rank"]) == [(k + 1, *x) for k, x in enumerate(able[: 80 * 600 // 100])]
    assert len(got) == len(rows)


def test_empty_target_and_empty_corpus(spark):
    docs = spark.createDataFrame([(1, "some words " * 20)], "doc_id long, text string")
    none = docs.limit(0)
    assert [r.n_features for r in resampling.resample(docs, none).collect()] == [40]
    assert resampling.resample(none, docs).collect() == []
