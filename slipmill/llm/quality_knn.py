"""Quality by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled training documents (``limit`` rows, a documented parameter) is turned into three blocks of counts:
words and hashed byte trigrams (what a text says), and n-grams of character classes with shares of repeated words and lines (how it
is built). Each block is weighted by inverse document frequency and brought to length one; a truncated SVD of all three
together gives the latent space. Tasks make the counts of the labelled documents, so the driver gets at most ``limit`` sparse rows of
at most ``WIDTH`` counts, never a text. The labelled vectors are broadcast: their size is limit * dims * 4 bytes (1.5 MB at the
defaults), whatever the corpus. Every document of the corpus is mapped to the same space, its cosine with every labelled vector is
computed exactly, in blocks of documents, and the k nearest vote with their labels, weighted by similarity.

Defined cases: null and empty texts have the zero vector, so all neighbours are equally near and the score is the share
of label 1 in the sample; null labels are not learnt from; without any usable label every score is 0.5; ties among
neighbours go to the smaller doc_id; of repeated labelled rows the smallest text is learnt; repeated rows and null
doc_ids are scored as they stand; other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmill.llm._shared import map_rows

#: Hashed widths of words, byte trigrams and class trigrams, number of latent dimensions, voters, labelled rows at most.
WORDS, BYTES, TRIGRAMS, DIMS, VOTERS, LIMIT = 4096, 2048, 1024, 96, 25, 4096
#: Remembered words per worker at most.
MEMORY = 100_000
_CLASSES = 24


def _class_table() -> np.ndarray:
    """Byte -> character class: white space, newline, lower, upper, digit, UTF-8 lead and tail, each common sign, rest."""
    table = np.full(256, 23, np.int64)
    for byte in range(256):
        char = chr(byte)
        if byte >= 0xC0:
            table[byte] = 5
        elif byte >= 0x80:
            table[byte] = 6
        elif char == "\n":
            table[byte] = 1
        elif char.isspace():
            table[byte] = 0
        elif char.islower():
            table[byte] = 2
        elif char.isupper():
            table[byte] = 3
        elif char.isdigit():
            table[byte] = 4
    for i, char in enumerate(".,!?#*$%&|<>\"':/"):
        table[ord(char)] = 7 + i
    return table


_TABLE = _class_table()
_BINS = 8
SHAPE = _CLASSES**2 + TRIGRAMS + 4 * _BINS
WIDTH = WORDS + BYTES + SHAPE
BLOCKS = (slice(0, WORDS), slice(WORDS, WORDS + BYTES), slice(WORDS + BYTES, WIDTH))
_PLACES: dict[bytes, int] = {}


def _hashed(a: np.ndarray, width: int) -> np.ndarray:
    """Places of up to 32-bit numbers among width."""
    return (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % width


def counts(text: str | None) -> np.ndarray:
    """The raw feature vector of a whole text: words and byte trigrams in lower case, class n-grams and structure bins; square roots of shares."""
    out = np.zeros(WIDTH, np.float32)
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return out
    low = data.lower()
    terms = low.split()
    if len(_PLACES) > MEMORY:
        _PLACES.clear()
    for w in set(terms).difference(_PLACES):
        _PLACES[w] = zlib.crc32(w.strip(b".,;:!?\"'()[]")) % WORDS
    n = len(terms) or 1
    out[BLOCKS[0]] = np.bincount(np.fromiter(map(_PLACES.__getitem__, terms), np.int64, len(terms)), minlength=WORDS) / n
    raw = np.frombuffer(low, np.uint8).astype(np.uint32)
    out[BLOCKS[1]] = np.bincount(_hashed(raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:], BYTES), minlength=BYTES) / len(data)
    c = _TABLE[np.frombuffer(data, np.uint8)]
    two = c[:-1] * _CLASSES + c[1:]
    shape = out[BLOCKS[2]]
    shape[: _CLASSES**2] = np.bincount(two, minlength=_CLASSES**2) / len(data)
    three = (two[:-1] * _CLASSES + c[2:]) * 2654435761 % (1 << 32) * TRIGRAMS >> 32
    shape[_CLASSES**2 : _CLASSES**2 + TRIGRAMS] = np.bincount(three, minlength=TRIGRAMS) / len(data)
    np.sqrt(out, out=out)
    words, lines = data.split(), data.split(b"\n")
    shares = (
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
        min(1.0, len(data) / n / 40),
    )
    for i, share in enumerate(shares):
        shape[_CLASSES**2 + TRIGRAMS + i * _BINS + min(_BINS - 1, int(share * _BINS))] = 1
    return out


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of raw vectors by idf, each block of length one or zero; in place, some rows at a time, so no second table is held."""
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        part *= idf
        for block in BLOCKS:
            part[:, block] = _unit(part[:, block])
    return x


def fit(x: np.ndarray, labels: list[int], dims: int = DIMS, seed: int = 3) -> dict:
    """The space and the labelled, normalised vectors in it, from the raw vectors of labelled documents. The truncated SVD works on a random
    subspace that four products with x and its transpose turn towards the largest singular vectors."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = _weighted(x, idf)
    q = np.random.default_rng(seed).normal(size=(WIDTH, min(dims + 16, WIDTH))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    project = q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :dims]
    return {"idf": idf, "project": project, "near": _unit(x @ project), "label": np.array(labels, np.float32)}


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(norm > 0, norm, 1)).astype(np.float32)


def votes(model: dict, texts: list[str | None], voters: int = VOTERS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors of each text."""
    if not len(model["label"]):
        return np.full(len(texts), 0.5)
    x = _unit(_weighted(np.stack([counts(t) for t in texts]), model["idf"]) @ model["project"])
    near = x @ model["near"].T
    k = min(voters, near.shape[1])
    top = np.argsort(-near, axis=1, kind="stable")[:, :k] if k == near.shape[1] else _top(near, k)
    weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** 4 + 1e-9
    score = (weight * model["label"][top]).sum(axis=1) / weight.sum(axis=1)
    score[~x.any(axis=1)] = model["label"].mean()
    return np.clip(score, 0, 1)


def _top(near: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest of each row; equal values by smaller index."""
    part = np.argpartition(-near, k, axis=1)[:, : k + 1]
    least = np.take_along_axis(near, part, axis=1).min(axis=1)
    out = np.empty((len(near), k), np.int64)
    for i, row in enumerate(near):
        idx = np.flatnonzero(row >= least[i])
        out[i] = idx[np.argsort(-row[idx], kind="stable")[:k]]
    return out


def train(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = LIMIT) -> dict:
    """Fits on at most ``limit`` labelled rows of docs for which ``usable`` (over doc_id) holds."""
    marked = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label")).where(usable)
    drawn = marked.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.min("label").alias("label"))
    kind = "doc_id long, label int, at binary, value binary"

    def sparse(batch: dict) -> dict:
        raw = [counts(t) for t in batch["text"]]
        at = [np.flatnonzero(v) for v in raw]
        return {"doc_id": batch["doc_id"], "label": batch["label"], "at": [i.astype(np.int32).tobytes() for i in at],
                "value": [v[i].tobytes() for v, i in zip(raw, at, strict=True)]}

    rows = sorted(map_rows(found.withColumn("label", F.col("label").cast("int")), sparse, kind, ["doc_id", "text", "label"]).collect(), key=lambda r: r.doc_id)
    if not rows:
        return {"idf": np.ones(WIDTH, np.float32), "project": np.zeros((WIDTH, 1), np.float32), "near": np.zeros((0, 1), np.float32), "label": np.zeros(0)}
    x = np.zeros((len(rows), WIDTH), np.float32)
    for row, r in zip(x, rows, strict=True):
        row[np.frombuffer(r.at, np.int32)] = np.frombuffer(r.value, np.float32)
    return fit(x, [r.label for r in rows])


def score(docs: DataFrame, model: dict, voters: int = VOTERS) -> DataFrame:
    """doc_id and score (0 to 1) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: dict) -> dict:
        return {"doc_id": batch["doc_id"], "score": votes(shared.value, batch["text"], voters).tolist()}

    return map_rows(docs, rows, "doc_id long, score double", ["doc_id", "text"])
