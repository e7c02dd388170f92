"""Near copies of five-word Jaccard similarity 0.8 or more, for the pipeline's near_dedup stage: SimHash first, then what it cannot reach.

Two documents link if their sets of five-word shingles have a Jaccard similarity of ``SIMILAR`` or more; a component is what
links reach. Documents with the same set are one class. Every link is verified over the whole sets of both texts.

Candidates come from two searches.

1. SimHash: 64-bit fingerprints of the sets, all within 4 bits found by ``simhash.links`` (vantage-point trees). This reaches
   copies of about 0.95 and more. A pair of 0.8 differs in 10 bits on average and in up to 18; no triangle bound prunes at 18 of
   64 bits, so a wider radius would compare all pairs.
2. The rest by MinHash: a class has BANDS keys, each over ROWS least values; classes that share a key (a bucket) are candidates. A
   pair of 0.8 is missed with probability (1 - 0.8 ** 5) ** 26 = 3e-5, one of 0.9 with 7e-11. The lowest bits of the 130 least
   values are a sketch; candidates that differ in over ``MOST`` of them (4.5 deviations from what 0.8 gives) are not verified.

A bucket is not compared pair by pair. In each of ``TURNS`` turns the components that meet in a bucket are compared through
members drawn from its largest component: of all pairs between two components the likeliest by sketch are verified (one, in later
turns 16 times as many), and components that turn out to be linked become one. So a large group of copies costs rows in proportion to its size. What
is then still apart within a bucket is compared in full, so every two members of a bucket are in one component or were compared: in
buckets of up to ``FEW`` as pairs, in larger ones inside tasks, tile against tile, whose sets are counted by matrix products and
which give only a forest of links.

Defined cases: texts under five words are one shingle; null and empty texts have the empty set and are copies of each other;
rows are known by doc_id and a hash of the text; a null doc_id stays only where no numbered row is in its component; of
rows that repeat a doc_id and text one stays; other columns do not matter, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmill.llm import simhash
from slipmill.llm._shared import cut, fresh, map_rows, small

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 26, 5
#: Differing sketch bits at most, turns, members drawn from a bucket's largest component in each turn, remembered words per worker.
MOST, TURNS, HUBS, MEMORY = 28, 1, 8, 100_000
#: Members of a bucket that is compared as pairs; members and bytes of sets of a tile in larger ones.
FEW, TILE, TILE_BYTES = 8, 1024, 16_000_000
_RNG = np.random.default_rng(11)
_TIMES, _PLUS, _PLACE = (_RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, SHINGLE))
_WORDS: dict[bytes, int] = {}


def shingle_set(text: str | None) -> np.ndarray:
    """A hash of each five-word shingle of the lower-cased (A-Z) text, sorted and distinct."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    if len(_WORDS) > MEMORY:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh64_intdigest(w, 42)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    mixed = sum(h[k : k + n] * _PLACE[k] for k in range(SHINGLE))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def sketch(shingles: np.ndarray) -> tuple[list[int], list[int], int]:
    """Band keys, three longs with the lowest bits of the least values, and the 64-bit fingerprint of a set; no keys for an empty one."""
    if not len(shingles):
        return [], [0, 0, 0], 0
    least, votes = np.full(BANDS * ROWS, np.iinfo(np.uint64).max), np.zeros(64, np.int64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        mixed = part[:, None] * _TIMES + _PLUS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
        votes += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    keys = [xxhash.xxh64_intdigest(part.tobytes(), k) - (1 << 63) for k, part in enumerate(least.reshape(BANDS, ROWS))]
    low = np.packbits(np.pad((least & np.uint64(1)).astype(np.uint8), (0, 192 - BANDS * ROWS))).view(">i8").tolist()
    return keys, low, int.from_bytes(np.packbits(votes * 2 > len(shingles)).tobytes(), "big", signed=True)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), sh (hash of the shingle set), n (its size), keys, bits and fp of every document."""

    def rows(batch: dict) -> dict:
        sets = [shingle_set(t) for t in batch["text"]]
        keys, bits, fps = zip(*map(sketch, sets), strict=True) if sets else ((), (), ())
        return {"doc_id": batch["doc_id"], "th": batch["th"], "sh": [xxhash.xxh64_intdigest(s.tobytes(), 42) - (1 << 63) for s in sets],
                "n": [len(s) for s in sets], "keys": list(keys), "bits": list(bits), "fp": list(fps)}

    return map_rows(docs.select("doc_id", "text", _text_hash().alias("th")), rows,
                    "doc_id long, th long, sh long, n long, keys array<long>, bits array<long>, fp long", ["doc_id", "text", "th"])


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sh and set (bytes) of every class of wanted (sh, doc_id, th), once for each row of docs that has its id and text; made again from the texts,
    which are not shuffled while wanted is small."""
    wanted = small(wanted.select("sh", F.col("doc_id").alias("_id"), F.col("th").alias("_th")))
    texts = docs.select("doc_id", "text", _text_hash().alias("th")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))

    def rows(batch: dict) -> dict:
        return {"sh": batch["sh"], "set": [shingle_set(t).tobytes() for t in batch["text"]]}

    return map_rows(texts, rows, "sh long, set binary", ["sh", "text"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar. pairs is cut; each pair moves its own two sets, which may stand in sets repeatedly."""
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("sh"))
    both = sets.join(F.broadcast(sides) if pairs.count() <= 50_000 else sides, "sh").groupBy("a", "b").agg(F.min("set").alias("x"), F.max("set").alias("y"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = [similarity(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64)) >= SIMILAR for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return cut(both.select("a", "b", "x", "y").mapInArrow(keep, "a long, b long"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def close_pairs(classes: DataFrame) -> DataFrame:
    """A forest (a, b) of classes whose fingerprints are within 4 bits."""
    reps = cut(classes.where("n > 0").groupBy("fp").agg(F.min("sh").alias("rep")))
    same = classes.where("n > 0").join(reps, "fp").where("sh <> rep").select(*_ordered("sh", "rep"))
    one, two = (reps.select(F.col("fp").alias(c), F.col("rep").alias(f"r{c}")) for c in "ab")
    return same.union(simhash.links(reps.select("fp")).join(one, "a").join(two, "b").select(*_ordered("ra", "rb"))).distinct()


def buckets(classes: DataFrame) -> DataFrame:
    """key, sh, n, bits and label (sh) of every class in every bucket that it shares."""
    dealt = classes.select("sh", F.explode("keys").alias("key")).repartition("key")
    shared = dealt.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    return dealt.join(shared, "key").join(classes.select("sh", "n", "bits"), "sh").select("key", "sh", "n", "bits", F.col("sh").alias("label"))


def _candidate(n: Column, m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Whether sizes and sketches let two sets be similar, and in how many bits the sketches differ."""
    differ = sum((F.bit_count(F.get(x, k).bitwiseXOR(F.get(y, k))) for k in range(1, 3)), F.bit_count(F.get(x, 0).bitwiseXOR(F.get(y, 0))))
    return (F.least(n, m) >= F.greatest(n, m) * F.lit(SIMILAR) - 0.001) & (differ <= MOST), differ


def _relabelled(open_: DataFrame, edges: DataFrame) -> DataFrame:
    """open_ with labels that edges (a, b) of labels join made one."""
    joined = simhash.components(edges)
    return open_.join(joined, F.col("label") == F.col("id"), "left").select("key", "sh", "n", "bits", F.coalesce("component", "label").alias("label"))


def _met(open_: DataFrame, turn: int) -> DataFrame:
    """The rows of buckets with several labels, with the label of the bucket's largest component (main), members drawn from it (hubs), and of
    the bucket total (members), rest (those outside main) and mass (the sets' sizes)."""
    drawn = F.array(*(F.min(F.struct(F.xxhash64("sh", F.lit(turn * HUBS + k)).alias("h"), "sh", "n", "bits")) for k in range(HUBS)))
    parts = open_.groupBy("key", "label").agg(F.count("*").alias("size"), F.sum("n").alias("mass"), drawn.alias("hubs"))
    heads = parts.groupBy("key").agg(F.count("*").alias("labels"), F.sum("size").alias("total"), F.sum("mass").alias("mass"), F.max("size").alias("most"),
                                     F.max_by(F.struct(F.col("label").alias("main"), "hubs"), F.struct("size", "label")).alias("head"))
    return open_.join(heads.where("labels > 1").select("key", "head.main", "head.hubs", "total", (F.col("total") - F.col("most")).alias("rest"), "mass"), "key")


def _sides(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members outside main, and all, under names of their own."""
    side = lambda c: [F.col(a).alias(f"{b}{c}") for a, b in (("sh", "s"), ("label", "l"), ("n", "n"), ("bits", "x"))]
    return met.where("label <> main").select("key", "main", "hubs", "total", "rest", "mass", *side("p")), met.select("key", *side("q"))


def common(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of every set of xs with every set of ys."""
    flat, owner = zip(*((np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (xs, ys)), strict=True)
    names, out, cells = np.intersect1d(*flat), np.zeros((len(xs), len(ys)), np.float32), []
    for values, rows in zip(flat, owner, strict=True):
        at = np.searchsorted(names, values)
        known = at < len(names)
        known[known] = names[at[known]] == values[known]
        order = np.argsort(at[known], kind="stable")
        cells.append((at[known][order], rows[known][order]))
    for low in range(0, len(names), 4096):
        marks = []
        for (at, rows), n in zip(cells, (len(xs), len(ys)), strict=True):
            part = slice(*np.searchsorted(at, (low, low + 4096)))
            mark = np.zeros((n, min(4096, len(names) - low)), np.float32)
            mark[rows[part], at[part] - low] = 1
            marks.append(mark)
        out += marks[0] @ marks[1].T
    return out


def in_tiles(many: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components of large buckets, every member outside main against every member; a task holds two tiles of sets."""
    left, right = _sides(many)
    left = left.join(right, (left["key"] == right["key"]) & (F.col("lp") != F.col("lq")) & _candidate(F.col("np"), F.col("nq"), F.col("xp"), F.col("xq"))[0], "left_semi")
    bytes_ = F.col("mass") * 8 / TILE_BYTES
    tiles = {"ti": F.ceil(F.greatest(F.col("rest") / TILE, bytes_ * F.col("rest") / F.col("total"), F.lit(1))).cast("int"), "tj": F.ceil(F.greatest(F.col("total") / TILE, bytes_, F.lit(1))).cast("int")}
    left = cut(left.withColumns(tiles).select("key", F.col("sp").alias("sh"), F.col("lp").alias("label"), "ti", "tj"))
    right = right.join(left.groupBy("key").agg(F.first("ti").alias("ti"), F.first("tj").alias("tj")), "key").select("key", F.col("sq").alias("sh"), F.col("lq").alias("label"), "ti", "tj")
    own = lambda n: F.pmod(F.xxhash64("sh"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = left.select("key", "sh", "label", F.lit(True).alias("own"), own("ti").alias("i"), each("tj").alias("j")).union(
        right.select("key", "sh", "label", F.lit(False).alias("own"), each("ti").alias("i"), own("tj").alias("j")))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own, sh, label = pdf["own"].to_numpy(bool), pdf["sh"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64)
        found, l, m = [np.frombuffer(x, np.uint64) for x in pdf["set"]], np.flatnonzero(own), np.flatnonzero(~own)
        if not len(l) or not len(m):
            return pd.DataFrame({"a": sh[:0], "b": sh[:0]})
        both, n = common([found[k] for k in l], [found[k] for k in m]).astype(np.float64), np.array([len(x) for x in found])
        i, j = np.nonzero((both / (n[l][:, None] + n[m][None, :] - both) >= SIMILAR) & (label[l][:, None] != label[m][None, :]))
        forest = simhash.Forest(sh, 0)
        forest.join(l[i], m[j])
        a, b = forest.links()
        return pd.DataFrame({"a": sh[a], "b": sh[b]})

    return cut(dealt.join(sets, "sh").groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct())


def links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Edges (a, b) between classes of found (prints): a subset of all links that reaches what all links of candidates reach."""
    classes = cut(found.groupBy("sh").agg(*(F.first(c).alias(c) for c in ("keys", "n", "bits", "fp")), F.min(F.struct("doc_id", "th")).alias("row")))
    tried, open_ = cut(close_pairs(classes)), cut(buckets(classes))
    wanted = open_.select("sh").union(tried.select("a")).union(tried.select("b")).distinct()
    sets = cut(sets_of(docs, wanted.join(classes.select("sh", "row.doc_id", "row.th"), "sh")))
    good = [similar(tried, sets)]
    edges = good[0]
    for turn in range(TURNS + 1):
        met = cut(_met(_relabelled(open_, edges), turn))
        left, right = _sides(met)
        if turn < TURNS:
            pairs = left.withColumn("h", F.explode("hubs")).select("*", F.col("h.sh").alias("sq"), F.col("main").alias("lq"), F.col("h.n").alias("nq"), F.col("h.bits").alias("xq"))
            fits = F.lit(True)
        else:
            good.append(in_tiles(met.where(F.col("total") > FEW), sets))
            pairs = left.where(F.col("total") <= FEW).join(right, "key")
            fits = (F.col("lp") != F.col("lq")) & ((F.col("lq") == F.col("main")) | (F.col("sp") > F.col("sq")))
        able, differ = _candidate(F.col("np"), F.col("nq"), F.col("xp"), F.col("xq"))
        pairs = pairs.where(fits & able).select(*_ordered("sp", "sq"), F.least("lp", "lq").alias("la"), F.greatest("lp", "lq").alias("lb"), differ.alias("d"))
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
        if turn < TURNS:
            pairs = pairs.groupBy("la", "lb", F.pmod(F.xxhash64("a", "b"), F.lit(16**turn)).alias("part")).agg(F.min(F.struct("d", "a", "b")).alias("m")).select("m.a", "m.b", "la", "lb")
        chosen = cut(pairs.select("a", "b", "la", "lb").dropDuplicates(["a", "b"]))
        good.append(similar(chosen, sets))
        tried = tried.union(chosen.select("a", "b"))
        edges = chosen.join(good[-1], ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))
        open_ = met.select(open_.columns)
    return reduce(DataFrame.union, good)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component one row with the smallest doc_id stays, all its columns as they are. Texts are not shuffled
    while the rows to drop are few enough to broadcast."""
    found = cut(prints(docs))
    reached = simhash.components(links(docs, found)).withColumnRenamed("id", "sh")
    owned = found.join(reached, "sh", "left").select("doc_id", "th", F.coalesce("component", "sh").alias("c"))
    stay = owned.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("row"), F.count("*").alias("size")).where("size > 1")
    goes = ~(F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("th") == F.col("row.th")))
    names = [fresh(docs, n) for n in ("_gone_id", "_gone_th")]

    def known(rows: DataFrame) -> tuple[DataFrame, Column]:
        """rows (doc_id, th) under names that docs does not have, and what joins them to docs."""
        keys = small(rows.select(F.col("doc_id").alias(names[0]), F.col("th").alias(names[1])))
        return keys, docs["doc_id"].eqNullSafe(F.col(names[0])) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(names[1]))

    out = docs.join(*known(owned.join(stay, "c").where(goes).select("doc_id", "th").distinct()), "left_anti")
    repeated = found.groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th")
    if repeated.limit(1).count():
        keys, same = known(repeated)
        again = out.join(keys, same, "left_semi").withColumn(names[1], F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", names[1]]).drop(names[1])
        out = out.join(keys, same, "left_anti").union(again)
    return out
