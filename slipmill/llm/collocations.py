"""Phrase collocations: word runs that stand together more often than their parts, counted exactly with position bitmaps.

Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends to pieces, these at spaces and tabs to words. Everything is counted per language.

Shards. A task numbers the words of its texts, language by language, in shards of some ``SHARD`` positions; a piece's end is a position without a word,
so nothing reaches over it. In a shard every word has a bitmap of its positions, compressed to its non-zero 8-bit blocks. Shifting a phrase's bitmap by one
position and ANDing it with a word's bitmap gives the bitmap of the longer phrase; its popcount is the phrase's count in the shard. Phrases are extended
depth-first, up to ``LONGEST`` words, in groups of phrases whose bitmaps are shifted and ANDed together, and the popcounts are summed over the shards. A piece that is longer than a shard goes on in the next one: the last
words are carried, and only phrases that end behind the carried words count there.

Pruning. A phrase that is frequent in the whole corpus consists of frequent words, pairs and triples. Words, then hashed pairs of frequent words, then hashed
triples of frequent pairs are counted in passes of their own, and what is frequent is kept as a bitmap of ``BITS`` hash slots that is broadcast: its size does
not grow with the corpus. Two hashes in one slot only leave a rare phrase in; the sums over shards are exact and decide. So pruning changes cost, not results.

Else only the languages' totals are broadcast, up to a checked number. A language with a third of all words is as many shards as it needs; the first rows of each
language are taken per partition before one window ranks them.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they stand; ties are ordered by phrase, byte by byte;
a word of any length is a word; other columns do not matter, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmill.llm._shared import cut, small

LEAST, LONGEST, FIRST, SHARE = 100, 5, 2000, 100
#: Positions of a shard, bytes of text that are split at once, hash slots of what is frequent (8 MB as bits).
SHARD, SLICE, BITS = 2_000_000, 1 << 20, 1 << 26
#: Buckets that phrases are added up in, one at a time, and phrases that a task packs at once: counts travel in a row for each bucket instead of one for each phrase.
BUCKETS, PACKED = 4096, 500_000
_ENDS, _BREAK = re.compile(rb"[.,;:!?\n-\r]+"), re.compile(rb"[.,;:!?\x09-\x0d\x20]")
#: Stands for a piece's end; UTF-8 has no such byte.
_END = b"\xff"


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, with marks at the ends of pieces, in lists of bounded slices; the last list ends with a mark."""
    start = 0
    while start < len(text):
        end = start + SLICE
        end = m.start() if end < len(text) and (m := _BREAK.search(text, end)) else len(text)
        yield _ENDS.sub(b" \xff ", text[start:end].lower()).split()
        start = end
    yield [_END]


class Shard:
    """Positions of one language: word numbers, -1 where there is none, the first ``carried`` positions counted before."""

    def __init__(self, words: list[bytes] = ()):
        self.vocabulary: dict[bytes, int] = {_END: -1}
        self.parts: list[np.ndarray] = []
        self.size = self.carried = 0
        if words:
            self.add(words)
            self.carried = len(words)

    def add(self, words: list[bytes]) -> None:
        vocabulary = self.vocabulary
        for w in words:
            if w not in vocabulary:
                vocabulary[w] = len(vocabulary) - 1
        self.parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def ids(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def words(self) -> list[bytes]:
        return list(self.vocabulary)[1:]

    def rest(self, most: int) -> list[bytes]:
        """The last words, as far back as most, of a piece that has not ended."""
        tail = np.concatenate(self.parts[-most:])[-most:].tolist() if most else []
        known = self.words()
        return [known[k] for k in tail[len(tail) - tail[::-1].index(-1) if -1 in tail else 0 :]]


def shards(batches: Iterator[pa.RecordBatch], size: int, carry: int) -> Iterator[tuple[str, Shard]]:
    """Shards of the rows (lang, text) of a task. All that are open hold some size positions together; the largest goes first."""
    open_: dict[str, Shard] = {}
    held, size = 0, max(size, 4 * carry)
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for k in range(batch.num_rows):
            lang = langs[k]
            for words in tokens(batch.column(1)[k].as_py()):
                open_.setdefault(lang, Shard()).add(words)
                held += len(words)
                while held > size:
                    most = max(open_, key=lambda x: open_[x].size)
                    done = open_.pop(most)
                    held -= done.size
                    if most == lang and (rest := done.rest(carry)):
                        open_[most] = Shard(rest)
                        held += len(rest)
                    yield most, done
    yield from open_.items()


def _table(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _in_shards(docs: DataFrame, found: Callable[[str, Shard], Iterator[pa.RecordBatch]], schema: str, size: int, carry: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in shards(batches, size, carry):
            yield from found(lang, shard)

    return docs.mapInArrow(run, schema)


def _hash(lang: str, words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word in a language."""
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    h = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(31))


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their slot set."""
    slot = hashes % np.uint64(len(bits) * 64)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _slots(frequent: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the slots of frequent (slot long), as 64-bit blocks: bits / 8 bytes at any size of frequent."""
    blocks = frequent.groupBy(F.shiftright("slot", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("value"))
    found, out = blocks.toArrow(), np.zeros(bits // 64, np.uint64)
    out[found["block"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return out


def _slot(hashes: np.ndarray, bits: int) -> pa.Array:
    return pa.array((hashes % np.uint64(bits)).astype(np.int64))


def _known(shard: Shard, lang: str, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard's word numbers with -1 for rare words too, and the hashes of its words."""
    ids, hashes = shard.ids(), _hash(lang, shard.words())
    kept = np.append(_marked(marks, hashes), False)  # place -1
    return np.where(kept[ids], ids, -1), hashes


def word_counts(docs: DataFrame, size: int = SHARD, longest: int = LONGEST) -> DataFrame:
    """lang, word, f and slot of every word."""

    def count(lang: str, shard: Shard) -> Iterator[pa.RecordBatch]:
        ids, words = shard.ids()[shard.carried :], shard.words()
        f = np.bincount(ids[ids >= 0], minlength=len(words))
        seen = np.flatnonzero(f)
        yield _table({"lang": pa.array([lang] * len(seen), pa.string()), "word": pa.array([words[k] for k in seen], pa.binary()), "f": pa.array(f[seen]), "slot": _slot(_hash(lang, words)[seen], BITS)})

    parts = _in_shards(docs, count, "lang string, word binary, f long, slot long", size, longest - 1)
    return parts.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("f").alias("f"), F.first("slot").alias("slot"))


def _runs(ids: np.ndarray, hashes: np.ndarray, pairs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions where runs of two known words end, or of three whose pairs are marked in pairs, and the runs' hashes."""
    ends = 1 + np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    two = _mixed(hashes[ids[ends - 1]], hashes[ids[ends]])
    if pairs is None:
        return ends, two
    good = _marked(pairs, two)
    ends, two = ends[good], two[good]
    twice = 1 + np.flatnonzero(ends[1:] == ends[:-1] + 1)
    return ends[twice], _mixed(two[twice - 1], hashes[ids[ends[twice]]])


def frequent_runs(docs: DataFrame, marks: np.ndarray, pairs: np.ndarray | None, least: int, size: int, longest: int) -> np.ndarray:
    """Slots of the hashes of pairs of marked words, or with pairs of triples of marked pairs, that stand least times or more in docs."""
    shared = docs.sparkSession.sparkContext.broadcast((marks, pairs))  # BITS / 8 bytes each

    def count(lang: str, shard: Shard) -> Iterator[pa.RecordBatch]:
        ids, hashes = _known(shard, lang, shared.value[0])
        if len(ids) > 1 and len(hashes):
            ends, runs = _runs(ids, hashes, shared.value[1])
            found, f = np.unique(runs[ends >= shard.carried], return_counts=True)
            yield _table({"h": pa.array(found.view(np.int64)), "f": pa.array(f.astype(np.int32))})

    sums = _in_shards(docs, count, "h long, f int", size, longest - 1).groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return _slots(sums.select(F.col("h").bitwiseAND(BITS - 1).alias("slot")), BITS)


class Level:
    """Phrases of one length with their bitmaps: the phrases' words, a row each; and the non-zero blocks of all bitmaps (owner: row of words, block, bits), in order."""

    __slots__ = ("bits", "block", "owner", "words")

    def __init__(self, words: np.ndarray, owner: np.ndarray, block: np.ndarray, bits: np.ndarray):
        self.words, self.owner, self.block, self.bits = words, owner, block, bits

    def counts(self, carried: int = 0) -> np.ndarray:
        """The popcount of each bitmap, from position carried (at most 8) on."""
        bits = np.where(self.block == 0, self.bits & np.uint8(0xFF << carried & 0xFF), self.bits) if carried else self.bits
        return np.bincount(self.owner, np.bitwise_count(bits), len(self.words)).astype(np.int64)

    def parts(self, most: int) -> Iterator[Level]:
        """The phrases in groups of some most blocks."""
        group = np.searchsorted(self.owner, np.arange(len(self.words) + 1)) // most
        for rows in np.split(np.arange(len(self.words)), np.flatnonzero(np.diff(group[:-1])) + 1) if len(self.words) else ():
            here = slice(*np.searchsorted(self.owner, (rows[0], rows[-1] + 1)))
            yield Level(self.words[rows], self.owner[here] - rows[0], self.block[here], self.bits[here])

    def shifted(self) -> Level:
        """Every position one further on."""
        over, kept = np.flatnonzero(self.bits >> 7), np.flatnonzero(self.bits & 0x7F)
        owner, block = np.concatenate([self.owner[kept], self.owner[over]]), np.concatenate([self.block[kept], self.block[over] + 1])
        bits = np.concatenate([self.bits[kept] << 1, np.ones(len(over), np.uint8)])
        order = np.argsort(owner * (int(block.max(initial=0)) + 1) + block, kind="stable")
        owner, block, bits = owner[order], block[order], bits[order]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]))) if len(owner) else order
        return Level(self.words, owner[first], block[first], np.bitwise_or.reduceat(bits, first) if len(first) else bits)


class Words:
    """The bitmaps of all words of a shard at some positions, by block and by word."""

    def __init__(self, ids: np.ndarray, at: np.ndarray):
        at = at[np.lexsort((ids[at], at >> 3))]
        block, word, bits = at >> 3, ids[at].astype(np.int64), np.uint8(1) << (at & 7).astype(np.uint8)
        first = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (word[1:] != word[:-1]))) if len(at) else at
        self.block, self.word, self.bits = block[first], word[first], np.bitwise_or.reduceat(bits, first) if len(first) else bits
        self.starts = np.searchsorted(self.block, np.arange((len(ids) >> 3) + 3))

    def alone(self) -> Level:
        """Every word as a phrase."""
        order = np.argsort(self.word, kind="stable")
        words, owner = np.unique(self.word[order], return_inverse=True)
        return Level(words[:, None], owner, self.block[order], self.bits[order])

    def extend(self, level: Level) -> Level:
        """The phrases that are one word longer: each shifted bitmap ANDed with the bitmaps of all words that share a block with it, empty ones left out."""
        moved = level.shifted()
        low = self.starts[moved.block]
        many = self.starts[moved.block + 1] - low
        entry = np.repeat(np.arange(len(many)), many)
        other = np.arange(len(entry)) + np.repeat(low - np.cumsum(many) + many, many)
        both = moved.bits[entry] & self.bits[other]
        some = np.flatnonzero(both)
        entry, word = entry[some], self.word[other[some]]
        span = int(word.max(initial=0)) + 1
        longer, owner = np.unique(moved.owner[entry] * span + word, return_inverse=True)
        order = np.argsort(owner, kind="stable")
        words = np.concatenate([moved.words[longer // span], (longer % span)[:, None]], axis=1)
        return Level(words, owner[order], moved.block[entry[order]], both[some[order]])


def phrases(ids: np.ndarray, hashes: np.ndarray, pairs: np.ndarray, triples: np.ndarray, longest: int, carried: int = 0, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases (rows of word numbers) of 2 to longest words and their counts, depth-first in groups whose bitmaps have some most blocks. A phrase goes on only where its last two, and
    then three, words are marked."""
    if len(ids) < 2 or not len(hashes):
        return
    ends, runs = _runs(ids, hashes, None)
    ends = ends[_marked(pairs, runs)]
    second = Words(ids, ends)
    three, runs = _runs(ids, hashes, pairs)
    third = Words(ids, three[_marked(triples, runs)] if longest > 2 else three[:0])
    open_ = [*Words(ids, ends - 1).alone().parts(most)] if len(ends) else []
    while open_:
        level = open_.pop()
        longer = (second if level.words.shape[1] == 1 else third).extend(level)
        if len(longer.words):
            counts = longer.counts(carried)
            yield longer.words[counts > 0], counts[counts > 0]
            if longer.words.shape[1] < longest:
                open_ += longer.parts(most)


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = SHARD) -> DataFrame:
    """lang, phrase, k (words) and f of the phrases of docs (lang, text as bytes) that stand least times or more; words: word_counts of docs."""
    marks = _slots(words.where(F.col("f") >= least).select("slot"), BITS)
    pairs = frequent_runs(docs, marks, None, least, size, longest)
    triples = frequent_runs(docs, marks, pairs, least, size, longest) if longest > 2 else np.zeros(1, np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast((marks, pairs, triples))  # BITS / 8 bytes each

    def count(lang: str, shard: Shard) -> Iterator[pa.RecordBatch]:
        ids, hashes = _known(shard, lang, shared.value[0])
        words, held, f = shard.words(), [], []
        for found, counts in phrases(ids, hashes, *shared.value[1:], longest, shard.carried):
            held += [b" ".join([words[i] for i in row]) for row in found.tolist()]
            f.append(counts)
            if len(held) > PACKED:
                yield _packed(lang, held, np.concatenate(f))
                held, f = [], []
        if held:
            yield _packed(lang, held, np.concatenate(f))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sums = None, {}

        def rows() -> pa.RecordBatch:
            good = [(p, n) for p, n in sums.items() if n >= least]
            return _table({"lang": pa.array([group[1]] * len(good), pa.string()), "phrase": pa.array([p for p, _ in good], pa.binary()),
                           "k": pa.array([p.count(b" ") + 1 for p, _ in good], pa.int32()), "f": pa.array([n for _, n in good], pa.int64())})

        for batch in batches:
            for bucket, lang, packed, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, lang) != group:
                    if sums:
                        yield rows()
                    group, sums = (bucket, lang), {}
                for p, n in zip(packed.split(b"\n"), counts, strict=True):
                    sums[p] = sums.get(p, 0) + n
        if sums:
            yield rows()

    parts = _in_shards(docs, count, "bucket int, lang string, phrases binary, counts array<long>", size, longest - 1)
    dealt = parts.repartition("bucket", "lang").sortWithinPartitions("bucket", "lang")
    return dealt.mapInArrow(add_up, "lang string, phrase binary, k int, f long").select("lang", F.col("phrase").cast("string").alias("phrase"), "k", "f")


def _packed(lang: str, found: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    """Phrases and counts, a row for each bucket of phrases: the texts joined by line feeds, which no word has."""
    bucket = np.fromiter((xxhash.xxh32_intdigest(p) & (BUCKETS - 1) for p in found), np.int32, len(found))
    order = np.argsort(bucket, kind="stable")
    starts = np.append(0, 1 + np.flatnonzero(np.diff(bucket[order])))
    texts = [b"\n".join([found[k] for k in part]) for part in np.split(order, starts[1:])]
    sums = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array(counts[order], pa.int64()))
    return _table({"bucket": pa.array(bucket[order][starts]), "lang": pa.array([lang] * len(starts), pa.string()), "phrases": pa.array(texts, pa.binary()), "counts": sums})


def _part(phrase: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, share: int = SHARE, size: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases of docs (text, lang). A phrase's score is that of its weakest cut, the floor of
    1000 * a * n / (l * r); phrases inside a longer one that stands at least share hundredths as often are left out."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    words = cut(word_counts(texts, size, longest))
    found = cut(phrase_counts(texts, words, least, longest, size))
    totals = small(words.groupBy("lang").agg(F.sum("f").alias("n")))
    parts = words.where(F.col("f") >= least).select("lang", F.col("word").alias("part"), "f").union(found.select("lang", "phrase", "f"))
    cuts = found.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = cuts.select("*", _part(F.col("phrase"), F.lit(1), F.col("cut")).alias("left"), _part(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        sides = sides.join(parts.select("lang", F.col("part").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    sides = sides.join(totals, "lang").withColumns({"_up": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "_down": wide("l") * wide("r")}).withColumn("score", F.expr("_up div _down"))
    best = sides.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = found.where("k > 2").select("lang", "phrase", "k", "f", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m")).select("lang", "phrase", "k", "f", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("s"))
    covered = inner.select("lang", _part(F.col("phrase"), F.col("s"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("covering"))
    kept = best.join(covered, ["lang", "phrase"], "left").where(F.col("covering").isNull() | (F.lit(100).cast("decimal(3,0)") * wide("covering") < F.lit(share).cast("decimal(10,0)") * wide("a")))
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
