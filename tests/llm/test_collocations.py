"""Phrase collocations against a plain reading of their definition, bitmaps against sets, shards of any size."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from slipmill.llm import collocations as co

LOWER = {65 + i: 97 + i for i in range(26)}


def plain(rows, least, longest, first, share):
    """(lang, rank, phrase, a, l, r, n, score) of rows (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        able = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in able.items():
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in able.items())
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(scored)[:first])]
    return sorted(out)


def odd(seed=5, docs=150):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["The", "the", "größe", "日本", "a b", "x" * 300, "(x)", "\x00z", "\x1c"]
    fixed = ["new york city hall", "machine learning", "New york City hall of fame", "of the", "w1 w2 w1 w2 w1 w2 w1"]
    rows = []
    for _ in range(docs):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(40))]
        rows.append(("".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"]) for p in parts), rng.choice(["en", "en", "en", "de", None])))
    return rows + [(None, "en"), ("", None), (" ,. \n", "en"), ("one doc of its own language", "zz"), rows[0], rows[0]]


@pytest.mark.parametrize(("size", "partitions", "least", "share"), [(500_000, 3, 12, 100), (60, 2, 12, 100), (16, 1, 5, 80), (97, 4, 20, 100)])
def test_plain_reading(spark, size, partitions, least, share):
    rows = odd()
    table = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, rank int").repartition(partitions)
    got = co.collocations(table, least=least, first=15, share=share, size=size)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == plain(rows, least, 5, 15, share)


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def sets_of(level):
    return {tuple(w): {int(b) * 8 + j for o, b, bits in zip(level.owner, level.block, level.bits) if o == k for j in range(8) if int(bits) >> j & 1} for k, w in enumerate(level.words.tolist())}


def test_bitmaps_are_sets():
    rng = random.Random(2)
    for _ in range(200):
        ids = np.array([rng.randrange(-1, 4) for _ in range(rng.choice([1, 7, 8, 9, 64, 400]))], np.int32)
        some = np.flatnonzero(ids >= 0)
        words = co.Words(ids, some)
        alone = words.alone()
        assert sets_of(alone) == {(k,): set(np.flatnonzero(ids == k)) for k in set(ids[some].tolist())}
        assert alone.counts(3).tolist() == [len({p for p in s if p >= 3}) for s in sets_of(alone).values()]
        assert {k: {p - 1 for p in s} for k, s in sets_of(alone.shifted()).items()} == sets_of(alone)
        pairs = {(a, b): {p for p in some if p and ids[p - 1] == a and ids[p] == b} for a in range(4) for b in range(4)}
        longer = words.extend(alone)
        assert sets_of(longer) == {k: s for k, s in pairs.items() if s}
        together = {}
        for part in longer.parts(2):
            together |= sets_of(part)
        assert together == sets_of(longer)


@pytest.mark.parametrize("slice_", [1, 7, 40])
def test_a_long_piece_goes_on_in_the_next_shard(monkeypatch, slice_):
    """No break but one, slices of a few bytes, shards of some words: every run is counted once."""
    monkeypatch.setattr(co, "SLICE", slice_)
    rng = random.Random(slice_)
    words = [rng.choice("abcd") * rng.choice([1, 1, 9]) for _ in range(600)]
    text = " ".join(words[:450]) + ". " + " ".join(words[450:])
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array([text.encode(), b"other"], pa.binary())], names=["lang", "text"])
    got, single = Counter(), Counter()
    every = np.full(8, np.iinfo(np.uint64).max, np.uint64)
    for lang, shard in co.shards(iter([batch]), 30, 4):
        names = shard.words()
        single.update(names[k] for k in shard.ids()[shard.carried :] if k >= 0)
        for found, f in co.phrases(shard.ids(), co._hash(lang, names), every, every, 5, shard.carried, most=5):
            for phrase, n in zip(found.tolist(), f.tolist(), strict=True):
                got[tuple(names[k].decode() for k in phrase)] += n
    pieces = [words[:450], words[450:], ["other"]]
    assert single == Counter(w.encode() for p in pieces for w in p)
    assert got == Counter(tuple(p[i : i + k]) for p in pieces for k in range(2, 6) for i in range(len(p) - k + 1))


def test_scores_beyond_64_bits(spark):
    n = 3 * 10**12
    up = spark.sql(f"select cast(1000 as decimal(4,0)) * cast({n}L as decimal(19,0)) * cast({n}L as decimal(19,0)) as up, cast({n - 1}L as decimal(19,0)) * cast({n}L as decimal(19,0)) as down")
    assert up.selectExpr("up div down").first()[0] == 1000 * n * n // ((n - 1) * n)
