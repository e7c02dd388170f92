"""Benchmark decontamination by spaced seeds, tolerant of substituted words.

An item leaks into a document if some window of ``WINDOW`` neighbouring tokens of the item (the whole item, if shorter)
stands in the document with at most a fifth of its tokens substituted (two of thirteen). With k substitutions allowed, a
window's positions are dealt to k + 2 groups in turn; each fixed mask looks at two groups and ignores the rest. k
substitutions spoil at most k groups, so one mask at least sees two whole groups: no leak is lost. Hashes of masked test
windows are joined with those of the training text and every hit is compared token by token.

The benchmark is a stated query set: it is taken in blocks of at most ``block`` tokens; a block's seeds (bounded by the
block) are broadcast and every document is searched in place, so no text and no hash of it is shuffled, however large the
benchmark. ``TOGETHER`` blocks are searched in one pass, each in a worker of its own; between passes the rows are cut into the shared
folder, so memory is bounded by that many blocks. A hot document source or a passage that many documents share changes nothing.

Tokens are lower-cased runs of letters, digits and underscores. Defined cases: null and empty texts hold no leak; items
without a token are never found; an item of fewer than five tokens is found word by word only; repeated items and
documents count each; null item ids are reported as null; other columns do not matter; empty tables give no leaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipmill.llm._shared import cut, keep_rows, map_rows

#: Tokens of a window, share of them that may be substituted, tokens of benchmark text in one broadcast block, blocks in one pass.
WINDOW, TOLERANCE, BLOCK, TOGETHER = 13, 0.2, 500_000, 4
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def masks(width: int) -> tuple[int, list[np.ndarray]]:
    """Substitutions that a window of this width tolerates, and the positions that each mask looks at."""
    spare = int(width * TOLERANCE)
    groups = [np.arange(g, width, spare + 2) for g in range(min(width, spare + 2))]
    return spare, [np.sort(np.concatenate(p)) for p in combinations(groups, 2)] or groups


def index(items: list[tuple[int | None, str | None]]) -> dict:
    """The seeds of a block of items."""
    vocabulary: dict[str, int] = {}
    found = [(i, np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in tokens(t)], np.int32)) for i, t in items]
    found = [(i, x) for i, x in found if len(x)]
    rng = np.random.default_rng(11)
    factor = rng.integers(1, 1 << 62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    value = rng.integers(1, 1 << 62, len(vocabulary) + 1, dtype=np.uint64)
    starts = np.cumsum([0, *(len(x) for _, x in found)])
    flat = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(found)), np.diff(starts))
    seeds = []
    for width in sorted({min(WINDOW, len(x)) for _, x in found}):
        at = np.concatenate([np.arange(starts[k], starts[k] + max(1, len(x) - width + 1)) for k, (_, x) in enumerate(found) if min(WINDOW, len(x)) == width])
        spare, looks = masks(width)
        for look in looks:
            h = _hash(value[flat], at, look, factor)
            order = np.argsort(h, kind="stable")
            seeds.append({"width": width, "least": width - spare, "look": look, "hash": h[order], "at": at[order], **_bitmap(h)})
    return {"vocabulary": vocabulary, "ids": [i for i, _ in found], "flat": flat, "owner": owner, "seeds": seeds, "factor": factor, "value": value}


def _hash(values: np.ndarray, at: np.ndarray | slice, look: np.ndarray, factor: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for k in look.tolist():
        h += values[at + k] * factor[k]
    return h


def _bitmap(h: np.ndarray) -> dict:
    """Which leading bits some seed has: eight times as many cells as seeds."""
    shift = np.uint64(64 - max(16, len(h).bit_length() + 3))
    table = np.zeros(1 << (64 - int(shift)), bool)
    table[h >> shift] = True
    return {"table": table, "shift": shift}


def search(index: dict, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """For each text (number of the item in the index, first token, token after the last) of every leaking item."""
    known = index["vocabulary"].get
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ids = [np.fromiter((known(w, 0) for w in tokens(t)), np.int32) for t in texts]
    gap = np.zeros(WINDOW, np.int32)
    flat = np.concatenate([y for x in ids for y in (x, gap)]) if ids else gap
    sizes = np.array([len(x) + WINDOW for x in ids], np.int64)
    first = np.cumsum(sizes) - sizes
    values, hits = index["value"][flat], []
    values[flat == 0] = 0
    for seed in index["seeds"]:
        width, n = seed["width"], max(0, len(flat) - seed["width"] + 1)
        h = np.zeros(n, np.uint64)
        for k in seed["look"].tolist():
            h += values[k : k + n] * index["factor"][k]
        at = np.flatnonzero(seed["table"][h >> seed["shift"]])
        low = np.searchsorted(seed["hash"], h[at])
        many = np.searchsorted(seed["hash"], h[at], side="right") - low
        at, low, many = at[many > 0], low[many > 0], many[many > 0]
        for part in np.array_split(np.arange(len(at)), max(1, int(many.sum()) // 500_000)):
            reps = many[part]
            doc_at = np.repeat(at[part], reps)
            place = np.repeat(low[part] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            item_at = seed["at"][place]
            same = np.zeros(len(doc_at), np.int64)
            for k in range(width):
                same += flat[doc_at + k] == index["flat"][item_at + k]
            good = same >= seed["least"]
            if good.any():
                doc_at, item = doc_at[good], index["owner"][item_at[good]]
                hits.append(np.stack([np.searchsorted(first, doc_at, side="right") - 1, item, doc_at, doc_at + width]))
    if hits:
        doc, item, start, end = np.concatenate(hits, axis=1)
        order = np.lexsort((start, item, doc))
        doc, item, start, end = doc[order], item[order], start[order], end[order]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(item) != 0))))
        last = np.maximum.reduceat(end, new)
        for d, i, a, b in zip(doc[new].tolist(), item[new].tolist(), start[new].tolist(), last.tolist(), strict=True):
            out[d].append((i, a - int(first[d]), b - int(first[d])))
    return out


def blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[dict]:
    """Indexes of the benchmark, a block at a time; the driver holds one block."""
    items, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy(F.col("item_id").asc_nulls_first(), "text").toLocalIterator():
        items.append((r.item_id, r.text))
        size += len(tokens(r.text))
        if size >= block:
            yield index(items)
            items, size = [], 0
    if items:
        yield index(items)


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id and leaks (item_id, start and end in tokens, from the first to the last matching window) of every document."""
    kind = "array<struct<item_id:long,start:int,end:int>>"
    out = docs.select("doc_id", "text", F.array().cast(kind).alias("leaks"))
    for n, each in enumerate(blocks(benchmark, block)):
        shared, out = docs.sparkSession.sparkContext.broadcast(each), cut(out) if n and n % TOGETHER == 0 else out

        def rows(batch: dict, shared=shared) -> dict:
            more = search(shared.value, batch["text"])
            ids = shared.value["ids"]
            found = [[*old, *({"item_id": ids[i], "start": a, "end": b} for i, a, b in new)] for old, new in zip(batch["leaks"], more, strict=True)]
            return {"doc_id": batch["doc_id"], "text": batch["text"], "leaks": found}

        out = map_rows(out, rows, f"doc_id long, text string, leaks {kind}", ["doc_id", "text", "leaks"])
    return out.select("doc_id", "leaks")


def clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs without those that an item leaks into."""
    for n, each in enumerate(blocks(benchmark, block)):
        shared, docs = docs.sparkSession.sparkContext.broadcast(each), cut(docs) if n and n % TOGETHER == 0 else docs
        docs = keep_rows(docs, lambda texts, shared=shared: [not x for x in search(shared.value, texts)])
    return docs
