"""SimHash near-duplicates, found through vantage-point trees.

Fingerprints: 64 bits over XXH64 (seed 42) of four-word shingles. Two documents link if their fingerprints differ in
at most ``RADIUS`` bits; a component is what links reach.

Search. The 64 bits are cut into three projections. Fingerprints within 4 bits of each other are within 4 // 3 = 1 bit
in at least one projection, so each projection gets a vantage-point tree of its own with radius 1: distances in a
projection are sharp enough there to prune, where those over all 64 bits are not. A node (vantage v, threshold m) sends
x left if d(x, v) <= m and right if d(x, v) > m - 1. By the triangle bound two fingerprints within 1 differ by at most 1
in their distance to v, so both stand in the left child or both in the right: only the boundary shell d = m goes to both
shards, and no pair is lost.

Two levels. The upper trees are fitted on a sample of fingerprints (20,000, or one in 5,000, at most 500,000) and deal all
of them to shards; every fingerprint is placed, in some 20 to 50 shards whatever the corpus. A task splits its shard further
from the shard's own rows, by the same rule, until ``LEAF`` rows are left, which are compared exactly over all 64 bits. A ball
of 4 bits around a fingerprint that holds a good part of a shard (a group of near copies) is joined through its centre, and
only the ring from 4 to 8 bits is compared with it, each of its members until one link is found. A shard that the sample
shows to hold more than ``tile`` rows is dealt to tiles, and every two tiles meet in one task.

A shard gives a forest of true links, not all pairs: at most one link fewer than it has fingerprints. Components are found
over fingerprints; doc_ids are only carried along.

Defined cases: null and empty texts have the fingerprint 0 and link as others do; rows with equal doc_id are kept, each
with its own fingerprint, and do not link by their id; a null doc_id gets the smallest doc_id of its component (null if
it has none) and links as others do; other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipmill.llm._shared import cut, map_rows

SHINGLE, RADIUS = 4, 4
#: Bits of the three projections; 4 differing bits leave at most one in one of them.
PROJECTIONS = ((1 << 22) - 1, ((1 << 21) - 1) << 22, ((1 << 21) - 1) << 43)
#: Rows that the upper trees aim at, rows compared without another split, rows of a tile.
SHARD, LEAF, TILE = 2048, 1024, 1 << 20
_ALL = (1 << 64) - 1


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each four-word shingle of the lower-cased (A-Z) text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], 42) for a, b in pairs], np.uint64)


def fingerprint(text: str | None) -> int:
    """64 bits, each set if set in over half of the shingle hashes."""
    hashes = shingle_hashes(text)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8)
        votes += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and th (a hash of the text) of every document."""

    def rows(batch: dict) -> dict:
        return {"doc_id": batch["doc_id"], "fp": [fingerprint(t) for t in batch["text"]], "th": batch["th"]}

    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return map_rows(hashed, rows, "doc_id long, fp long, th long", ["doc_id", "text", "th"])


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _cut_at(rows: np.ndarray, vantages: np.ndarray, mask: int, radius: int) -> tuple[int, int] | None:
    """Of the vantages and thresholds near their medians the pair that leaves the smallest larger child; None if all
    leave over 85 of 100 rows in one. Left: d <= m; right: d > m - radius."""
    best = None
    for vantage in vantages:
        d = _bits((rows ^ vantage) & np.uint64(mask))
        middle = int(np.median(d))
        for m in {middle, middle - 1, middle + radius // 2}:
            size = max(int((d <= m).sum()), int((d > m - radius).sum()))
            if best is None or size < best[0]:
                best = (size, int(vantage), m)
    return best[1:] if best and best[0] <= 0.85 * len(rows) else None


def fit_trees(sample: np.ndarray, total: int, shard: int = SHARD, tile: int = TILE, seed: int = 7) -> list[dict]:
    """A flat list of nodes for three vantage-point trees; the roots are nodes 0, 1 and 2.

    An inner node has mask, vantage, threshold, left, right; a leaf has mask and tiles, how many tiles its share of the
    sample asks for. A node splits while its share of all rows is over ``shard`` and both children get clearly smaller.
    """
    rng, nodes = np.random.default_rng(seed), [{} for _ in PROJECTIONS]
    stack = [(i, mask, sample) for i, mask in enumerate(PROJECTIONS)]
    scale = total / max(1, len(sample))
    while stack:
        at, mask, rows = stack.pop()
        best = _cut_at(rows[:: max(1, len(rows) // 4096)], rng.choice(rows, 8), mask, 1) if len(rows) * scale > shard and len(rows) >= 32 else None
        if best is None:
            nodes[at] = {"mask": mask, "tiles": max(1, int(np.ceil(len(rows) * scale / tile)))}
            continue
        vantage, m = best
        d = _bits((rows ^ np.uint64(vantage)) & np.uint64(mask))
        nodes[at] = {"mask": mask, "vantage": vantage, "threshold": m, "left": len(nodes), "right": len(nodes) + 1}
        nodes += [{}, {}]
        stack += [(len(nodes) - 2, mask, rows[d <= m]), (len(nodes) - 1, mask, rows[d >= m])]
    return nodes


def place(nodes: list[dict], fps: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(leaf, tiles, indices of fps) for each leaf that some of fps reach."""
    stack = [(i, np.arange(len(fps))) for i in range(len(PROJECTIONS))]
    while stack:
        at, idx = stack.pop()
        node = nodes[at]
        if not len(idx):
            continue
        if "tiles" in node:
            yield at, node["tiles"], idx
            continue
        d = _bits((fps[idx] ^ np.uint64(node["vantage"])) & np.uint64(node["mask"]))
        stack += [(node["left"], idx[d <= node["threshold"]]), (node["right"], idx[d >= node["threshold"]])]


class Forest:
    """Links between rows of a shard: those that join two trees are kept. compared: how many pairs were tested."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius, self.label, self.compared = fps, radius, np.arange(len(fps)), 0
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Takes links a[i] - b[i]; each round hooks every larger label to one smaller one."""
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, first = np.unique(np.maximum(x, y), return_index=True)
            self.kept.append((a[first], b[first]))
            self.label[high] = np.minimum(x, y)[first]
            while not np.array_equal(step := self.label[self.label], self.label):
                self.label = step

    def compare(self, rows: np.ndarray) -> None:
        """Every two of rows."""
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            for other in range(at, len(rows), 8192):
                rest = rows[other : other + 8192]
                i, j = np.nonzero(_bits(self.fps[part][:, None] ^ self.fps[rest][None, :]) <= self.radius)
                self.compared += len(part) * len(rest)
                self.join(part[i], rest[j])

    def attach(self, ring: np.ndarray, core: np.ndarray) -> None:
        """Links of ring with core, which is joined already: each row of ring is tested until it has one."""
        for at in range(0, len(core), 256):
            ring = ring[self.label[ring] != self.label[core[0]]]
            for other in range(0, len(ring), 8192):
                part, rest = core[at : at + 256], ring[other : other + 8192]
                hit = _bits(self.fps[rest][:, None] ^ self.fps[part][None, :]) <= self.radius
                self.compared += len(part) * len(rest)
                some = hit.any(axis=1)
                self.join(rest[some], part[hit[some].argmax(axis=1)])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return (np.concatenate([k[0] for k in self.kept]), np.concatenate([k[1] for k in self.kept])) if self.kept else (none, none)


def shard_links(fps: np.ndarray, mask: int = _ALL, radius: int = RADIUS, leaf: int = LEAF) -> Forest:
    """A forest of the links of one shard: of all its pairs within radius that are also within radius // 3 on the mask (all
    bits: within radius)."""
    forest, rng = Forest(fps, radius), np.random.default_rng(len(fps))
    near = radius if mask == _ALL else radius // len(PROJECTIONS)
    stack = [np.arange(len(fps))]
    while stack:
        idx = stack.pop()
        while len(idx) > leaf:
            tried, some = idx[rng.integers(0, len(idx), 16)], idx[rng.integers(0, len(idx), 4096)]
            inside = (_bits(fps[tried][:, None] ^ fps[some][None, :]) <= radius).mean(axis=1)
            if inside.max() >= 1 / 64:
                d = _bits(fps[idx] ^ fps[tried[np.argmax(inside)]])
                core, ring = idx[d <= radius], idx[(d > radius) & (d <= 2 * radius)]
                forest.join(core, np.full(len(core), tried[np.argmax(inside)]))
                forest.attach(ring, core)
                idx = idx[d > radius]
                continue
            for bits, reach in ((mask, near), (_ALL, radius)):
                if best := _cut_at(fps[some], fps[tried[:8]], bits, reach):
                    d = _bits((fps[idx] ^ np.uint64(best[0])) & np.uint64(bits))
                    left, right = idx[d <= best[1]], idx[d > best[1] - reach]
                    if max(len(left), len(right)) < 0.95 * len(idx):
                        break
            else:
                break
            stack.append(right)
            idx = left
        forest.compare(idx)
    return forest


def links(classes: DataFrame, shard: int = SHARD, tile: int = TILE, sample: int | None = None, leaf: int = LEAF) -> DataFrame:
    """A forest (a, b) of links between fingerprints of each shard of classes (fp, distinct): what links reach, it reaches."""
    spark, total = classes.sparkSession, classes.count()
    drawn = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample or min(500_000, max(20_000, total // 5000)))
    nodes = fit_trees(np.array([r.fp for r in drawn.collect()], np.int64).view(np.uint64), total, shard, tile)
    tree = spark.sparkContext.broadcast(nodes)

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for pdf in frames:
            held.append(pdf["fp"].to_numpy(np.int64))
            if sum(map(len, held)) >= 500_000:
                yield from placed(np.concatenate(held))
                held = []
        if held:
            yield from placed(np.concatenate(held))

    def placed(fps: np.ndarray) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for leaf_id, tiles, idx in place(tree.value, fps.view(np.uint64)):
            own = (fps[idx].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(tiles)
            meet = [(0, 0, idx)] if tiles == 1 else [(min(i, j), max(i, j), idx[own == i]) for i in range(tiles) for j in range(tiles) if i != j]
            rows += [(leaf_id, i, j, part) for i, j, part in meet if len(part)]
            if sum(len(r[3]) for r in rows) > 200_000:
                yield _table(rows, fps)
                rows = []
        if rows:
            yield _table(rows, fps)

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(np.int64)
        a, b = shard_links(fps.view(np.uint64), tree.value[key[0]]["mask"], leaf=leaf).links()
        return pd.DataFrame({"a": fps[a], "b": fps[b]})

    dealt = classes.select("fp").repartition("fp").mapInPandas(spread, "leaf int, i int, j int, fp long")
    return dealt.groupBy("leaf", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _table(rows: list[tuple], fps: np.ndarray) -> pd.DataFrame:
    sizes = [len(r[3]) for r in rows]
    leaf, i, j = (np.repeat([r[k] for r in rows], sizes).astype(np.int32) for k in range(3))
    return pd.DataFrame({"leaf": leaf, "i": i, "j": j, "fp": fps[np.concatenate([r[3] for r in rows])]})


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id of edges (a, b) but the components' own, component the smallest id reachable; alternating large and
    small stars.

    Each round is two groupings and joins on the edge table; rounds grow with the logarithm of the longest chain. The edge
    table is cut into the shared folder each round. Hot centres: minima are pre-aggregated, the join back is one that AQE
    splits.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("c")).select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
        before = now


def members(prints: DataFrame, **how) -> DataFrame:
    """fp and component_id of every distinct fingerprint of prints (doc_id, fp); how: see links()."""
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = components(links(classes, **how))
    found = found.union(found.select("component", "component").distinct()).withColumnRenamed("id", "fp")
    reached = cut(classes.join(found, "fp"))
    least = reached.groupBy("component").agg(F.min("id").alias("least"))
    owned = reached.join(least, "component").select("fp", "least")
    return classes.join(owned, "fp", "left").select("fp", F.coalesce("least", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document of docs (doc_id, text); how: see links()."""
    prints = cut(fingerprints(docs).select("doc_id", "fp"))
    return prints.join(members(prints, **how), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
