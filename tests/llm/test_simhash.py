"""Fingerprints against a plain reading, components against brute force."""

import random

import numpy as np
import xxhash

from slipmill.llm import simhash as S


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                label[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return sorted((rows[i][0], f"{prints[i]:016x}", min(groups[root(i)])) for i in range(len(rows)))


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(200)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "ONE TWO"), (5, "a b c d"), (6, " x y\x0bz w q")]
    while len(rows) < n:
        if rng.random() < 0.5 and len(rows) > 8:
            base = (rng.choice(rows)[1] or "").split() or ["x"]
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = rng.choice(words)
        else:
            base = rng.choices(words, k=rng.randrange(20, 300))
        rows.append((len(rows), " ".join(base)))
    return rows


def test_components_are_those_of_brute_force(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    want = brute(rows)
    for shard, tile in ((2048, 8192), (32, 16)):
        got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs, shard=shard, tile=tile, leaf=64).collect())
        assert got == want


def test_trees_lose_no_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = base[:1000].copy()
    for k in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64)
    fps = np.concatenate([base, near])
    nodes = S.fit_trees(fps[::3], len(fps), shard=64, tile=1 << 20)
    shards = [set(idx.tolist()) for _, _, idx in S.place(nodes, fps)]
    assert max(map(len, shards)) < 2500
    where = {}
    for k, s in enumerate(shards):
        for i in s:
            where.setdefault(i, set()).add(k)
    assert all(where[i] & where[3000 + i] for i in range(1000))


def hexed(fps):
    return [f"{f:016x}" for f in fps]


def components_of(spark, rows):
    """component_id by row number of (doc_id, fingerprint) rows."""
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    prints = spark.createDataFrame([(k, i, signed(f)) for k, (i, f) in enumerate(rows)], "k int, doc_id long, fp long")
    return [r.component_id for r in prints.join(S.members(prints), "fp").orderBy("k").collect()]


def test_ids_do_not_link_and_null_ids_do(spark):
    far, apart = 0x0123456789ABCDEF, 0xFEDCBA9876543210
    rows = [(9, far), (9, apart), (5, far ^ 0b111), (12, apart ^ 0b111)]
    assert components_of(spark, rows) == [5, 9, 5, 9]
    bridge = [(3, far), (None, far ^ 0xF), (8, far ^ 0xFF), (None, apart), (None, apart ^ 1)]
    assert components_of(spark, bridge) == [3, 3, 3, None, None]


def union_find(fps, radius=4):
    label = np.arange(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= radius):
            low, high = sorted((label[i], label[j]))
            label[label == high] = low
    return label


def test_shards_split_and_keep_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    group = np.repeat(base[:1], 600)
    for _ in range(5):
        group ^= np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)
    near = base.copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    fps = np.unique(np.concatenate([base, near, group]))
    want = union_find(fps)
    for leaf in (4096, 128):
        forest = S.shard_links(fps, leaf=leaf)
        a, b = forest.links()
        assert (np.bitwise_count(fps[a] ^ fps[b]) <= 4).all() and len(a) == len(fps) - len(np.unique(want))
        assert len(np.unique(np.stack([want, forest.label]), axis=1).T) == len(np.unique(want))


def test_copies_and_comparisons_stay_flat_as_classes_grow():
    """Simulated classes: uniform fingerprints, 2.5, 25 and 250 million of them."""
    rng = np.random.default_rng(3)
    some, copies = rng.integers(0, 1 << 63, 400, dtype=np.uint64), {}
    for total in (2_500_000, 25_000_000, 250_000_000):
        sample = rng.integers(0, 1 << 63, min(500_000, max(20_000, total // 5000)), dtype=np.uint64)
        copies[total] = sum(tiles * len(idx) for _, tiles, idx in S.place(S.fit_trees(sample, total), some)) / len(some)
    assert copies[25_000_000] <= 2 * copies[2_500_000] and copies[250_000_000] <= 2 * copies[2_500_000] <= 60
    each = {n: S.shard_links(rng.integers(0, 1 << 63, n, dtype=np.uint64), S.PROJECTIONS[0]).compared / n for n in (10_000, 100_000)}
    assert each[100_000] <= 3 * each[10_000] < 10_000  # ten times the rows, not ten times the comparisons of each


def test_a_group_of_near_copies_is_not_compared_in_full():
    rng = np.random.default_rng(8)
    group = np.full(20_000, 0x0F0F0F0F0F0F0F0F, np.uint64)
    for _ in range(3):
        group ^= np.uint64(1) << rng.integers(0, 64, len(group)).astype(np.uint64)
    fps = np.unique(group)
    forest = S.shard_links(fps)
    assert len(np.unique(forest.label)) == 1 and forest.compared < len(fps) ** 2 / 10


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(none).collect() == []
