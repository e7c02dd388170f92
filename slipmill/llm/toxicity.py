"""Toxic spans by a linear-chain conditional random field.

States: plain and toxic. The training tokens get their labels from the document labels of a bounded sample (``limit``
rows of either label, of these as many as have ``chars`` characters together; documented parameters): a token of a toxic document is toxic if its word, or a stem of four to
six of its letters, stands in so many more of the sample's toxic documents than of its clean ones that chance does
not explain it (a likelihood ratio test). The field has one hashed weight vector over word, prefix, suffix and shape
features and a transition matrix, trained on every token of the sample by gradient ascent on the exact log-likelihood (forward-backward). Scoring
runs forward-backward over every token of every whole text; the marginals give the offending offsets, and a calibrated
logistic function of the two largest and the summed marginals gives the document's score.

Defined cases: null and empty texts, and texts without a word, have the score of a document without toxic tokens and no
spans; null labels are not learnt from; a sample without toxic or without clean rows gives every document the score 0;
of repeated labelled rows the smallest text is learnt; repeated rows and null doc_ids are scored as they stand; other
columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmill.llm._shared import cut, keep_rows, map_rows

#: Width of the hashed features, labelled rows of either kind at most, their characters at most, remembered words per worker at most.
WIDTH, LIMIT, CHARS, MEMORY = 1 << 17, 800, 4_000_000, 200_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def normal(word: str) -> str:
    """A token without case and without signs at its ends."""
    return word.lower().strip(_SIGNS)


def stems(word: str) -> list[str]:
    """What a token may be recognised by: the word itself and its first four to six letters."""
    return [f"={word}", *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n)] if word else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature indices of all words and the place of the word that each belongs to: the word, and its byte n-grams
    of 3, 4 and 6 with the marks of both ends."""
    data = [b"^" + normal(w).encode("utf-8", "surrogatepass") + b"$" for w in words]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    ends, owner = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(data)), sizes)
    raw, place = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64), np.arange(len(owner))
    found, owners = [np.fromiter((zlib.crc32(d) % WIDTH for d in data), np.int64, len(data))], [np.arange(len(data))]
    for n in (3, 4, 6):
        at = place[place + n <= ends]
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + raw[at + k]
        found.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % WIDTH)
        owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners)


def lexicon(toxic: list[list[str]], clean: list[list[str]], doubt: float = 0.05) -> set[str]:
    """Words and stems that the sample proves to be toxic: a share of toxic texts over 0.9 at even odds, and a likelihood
    ratio that chance gives none of the stems tried (``doubt`` over all of them together).

    A stem counts once for each document in which it stands between neighbours that no document before had, so neither copies
    of a text nor a word that one text repeats prove anything.
    """
    tally, total = [Counter(), Counter()], [1, 1]
    for side, docs in enumerate((clean, toxic)):
        seen: set[tuple[str, str, str]] = set()
        for words in docs:
            new = set(zip(words, ["", *words], [*words[1:], ""], strict=False)) - seen
            seen |= new
            total[side] += bool(new)
            tally[side].update({stem for w in {c[0] for c in new} for stem in stems(w)})
    odds, least, out = total[1] / total[0], 2 * np.log(max(2, len(tally[1])) / doubt), set()
    for stem, a in tally[1].items():
        b = tally[0][stem]
        mean = (a + b) / sum(total)
        ratio = 2 * (a * np.log(a / total[1] / mean) + (b * np.log(b / total[0] / mean) if b else 0))
        if a > 9 * b * odds and ratio > least:
            out.add(stem)
    return out


def marginals(unary: list[np.ndarray], trans: np.ndarray, pairs: np.ndarray | None = None, length: int = 128) -> list[np.ndarray]:
    """P(toxic) of every token, exact. unary: for each text the scores of toxic over plain; trans: 2 x 2 scores; pairs: if
    given, gets the expected number of each of the 2 x 2 transitions added.

    Texts are cut into segments of one length. A segment's tokens make one 2 x 2 matrix; these carry the messages from
    segment to segment, and then all segments run side by side, so a long text takes no longer loop than a short one.
    """
    sizes = np.array([len(u) for u in unary], np.int64)
    counts = -(-sizes // length)
    total = int(counts.sum())
    if not total:
        return [np.zeros(0) for _ in unary]
    first = np.cumsum(counts) - counts
    place = np.repeat(first * length - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    e, linked = np.ones(total * length), np.zeros(total * length, bool)
    e[place], linked[place] = np.exp(np.clip(np.concatenate(unary), -30, 30)), True
    linked[first[sizes > 0] * length] = False
    e, linked = e.reshape(total, length).T, linked.reshape(total, length).T
    m = np.exp(trans)
    a, b = np.where(linked, m[0, 0], 1), np.where(linked, m[0, 1], 0) * e
    c, d = np.where(linked, m[1, 0], 0), np.where(linked, m[1, 1], 1) * e
    p = np.array([[1.0], [0], [0], [1]]) * np.ones(total)
    for t in range(length):
        p = np.stack([p[0] * a[t] + p[1] * c[t], p[0] * b[t] + p[1] * d[t], p[2] * a[t] + p[3] * c[t], p[2] * b[t] + p[3] * d[t]])
        p /= p.sum(axis=0)
    start, end = np.full((2, total), 0.5), np.full((2, total), 0.5)
    for k in range(int(counts.max()) - 1):
        s = first[counts > k + 1] + k
        v = np.stack([start[0, s] * p[0, s] + start[1, s] * p[2, s], start[0, s] * p[1, s] + start[1, s] * p[3, s]])
        start[:, s + 1] = v / v.sum(axis=0)
    for k in range(int(counts.max()) - 1, 0, -1):
        s = first[counts > k] + k
        v = np.stack([p[0, s] * end[0, s] + p[1, s] * end[1, s], p[2, s] * end[0, s] + p[3, s] * end[1, s]])
        end[:, s - 1] = v / v.sum(axis=0)
    f, forward = start, np.empty((length + 1, total))
    forward[0] = start[1]
    for t in range(length):
        f = np.stack([f[0] * a[t] + f[1] * c[t], f[0] * b[t] + f[1] * d[t]])
        f /= f.sum(axis=0)
        forward[t + 1] = f[1]
    r, out = end, np.empty((length, total))
    for t in range(length - 1, -1, -1):
        toxic, plain = forward[t + 1] * r[1], (1 - forward[t + 1]) * r[0]
        out[t] = toxic / (toxic + plain)
        if pairs is not None:
            g = forward[t]
            joint = np.stack([(1 - g) * a[t] * r[0], (1 - g) * b[t] * r[1], g * c[t] * r[0], g * d[t] * r[1]])[:, linked[t]]
            pairs += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        r = np.stack([a[t] * r[0] + b[t] * r[1], c[t] * r[0] + d[t] * r[1]])
        r /= r.sum(axis=0)
    return np.split(out.T.reshape(-1)[place], np.cumsum(sizes)[:-1])


def fit(toxic: list[str | None], clean: list[str | None], rounds: int = 25, rate: float = 1.5) -> dict:
    """Weights, transitions and the calibration of document scores."""
    model = {"weight": np.zeros(WIDTH, np.float32), "bias": 0.0, "trans": np.zeros((2, 2)), "line": None}
    if not toxic or not clean:
        return model
    texts = [*toxic, *clean]
    tokens = [_WORD.findall(t or "") for t in texts]
    name = {w: normal(w) for ws in tokens for w in ws}
    plain = [[name[w] for w in ws] for ws in tokens]
    known = lexicon(plain[: len(toxic)], plain[len(toxic) :])
    hot = {w for w, n in name.items() if any(s in known for s in stems(n))}
    runs = [(ws, np.array([k < len(toxic) and w in hot for w in ws], np.float64)) for k, ws in enumerate(tokens) if ws]
    if not runs:
        return model
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for r in runs for w in r[0]))}
    flat, owner = features([*vocab])
    ids = [np.array([vocab[w] for w in r[0]]) for r in runs]
    used, truth = np.concatenate(ids), np.concatenate([r[1] for r in runs])
    gold_pairs = np.zeros((2, 2))
    for _, g in runs:
        np.add.at(gold_pairs, (g[:-1].astype(int), g[1:].astype(int)), 1)
    trans, weight, bias = np.zeros((2, 2)), np.zeros(WIDTH), 0.0
    square, square_trans, square_bias = np.full(WIDTH, 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(rounds):
        scores = np.bincount(owner, weight[flat], len(vocab)) + bias
        pairs = np.zeros((2, 2))
        p = np.concatenate(marginals([scores[i] for i in ids], trans, pairs))
        error = np.bincount(used, truth - p, len(vocab))
        grad = (np.bincount(flat, error[owner], WIDTH) - 0.1 * weight) / len(runs)
        grad_trans, grad_bias = (gold_pairs - pairs - 0.1 * trans) / len(runs), float((truth - p).sum()) / len(runs)
        square, square_trans, square_bias = square + grad**2, square_trans + grad_trans**2, square_bias + grad_bias**2
        weight += rate * grad / np.sqrt(square)
        trans += rate * grad_trans / np.sqrt(square_trans)
        bias += rate * grad_bias / np.sqrt(square_bias)
    model |= {"weight": weight.astype(np.float32), "bias": bias, "trans": trans}
    x = np.array([summary(*t) for at in range(0, len(texts), 256) for t in tag(model, texts[at : at + 256], {})])
    model["line"] = _line(x, np.repeat([1.0, 0.0], [len(toxic), len(clean)]))
    return model


def summary(words: list[str], p: np.ndarray) -> tuple[float, float, float]:
    """Of a text's tokens and their marginals: the logits of the largest and of the largest of another word, and the logarithm of one plus
    the sum over 0.05. Each word counts once, so a line that repeats is no more toxic than one."""
    best: dict[str, float] = {}
    for i in np.flatnonzero(p > 0.05).tolist():
        word = normal(words[i])
        best[word] = max(best.get(word, 0.0), float(p[i]))
    ranked = sorted(best.values(), reverse=True)
    top = ranked[0] if ranked else float(p.max()) if len(p) else 0.0
    logit = lambda v, least: float(np.log(min(max(v, least), 1 - 1e-4) / (1 - min(max(v, least), 1 - 1e-4))))
    return logit(top, 1e-4), logit(ranked[1] if len(ranked) > 1 else 0.0, 0.01), float(np.log1p(sum(ranked)))


def _line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps; both labels count alike."""
    a = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (share * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(hess, a.T @ (share * (y - p)) - 1e-3 * w)
    return w


def tag(model: dict, texts: list[str | None], memory: dict[str, float]) -> list[tuple[list[str], np.ndarray]]:
    """The tokens of every text and their marginals. memory: token scores, kept between calls and emptied when full."""
    weight, bias, words = model["weight"], model["bias"], [_WORD.findall(t or "") for t in texts]
    if len(memory) > MEMORY:
        memory.clear()
    if new := [*set().union(*words).difference(memory)]:
        flat, owner = features(new)
        memory.update(zip(new, (np.bincount(owner, weight[flat], len(new)) + bias).tolist(), strict=True))
    return list(zip(words, marginals([np.fromiter(map(memory.__getitem__, ws), np.float64, len(ws)) for ws in words], model["trans"]), strict=True))


def train(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = LIMIT, chars: int = CHARS) -> dict:
    """Fits on at most ``limit`` toxic and ``limit`` clean rows for which ``usable`` (over doc_id) holds: in the order of a hash of the
    doc_id, those whole texts that fit into half of ``chars`` for either label, so the driver's share is bounded in bytes too."""
    marked = labels.where(F.col("toxic").isin(0, 1)).where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for k in (1, 0)]
    drawn = F.broadcast(pick[0].union(pick[1]))
    found = cut(docs.select("doc_id", "text").join(drawn, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    room, chosen = {0: chars // 2, 1: chars // 2}, []
    for r in found.select("doc_id", "toxic", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.n <= room[r.toxic]:
            room[r.toxic] -= r.n
            chosen.append((r.doc_id,))
    if not chosen:
        return fit([], [])
    keys = docs.sparkSession.createDataFrame(chosen, "doc_id long")
    rows = sorted(found.join(F.broadcast(keys), "doc_id").collect(), key=lambda r: r.doc_id)
    return fit([r.text for r in rows if r.toxic], [r.text for r in rows if not r.toxic])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, spans (start and end in code points, the tokens whose marginal is over one half) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memory: dict[str, float] = {}

    def rows(batch: dict) -> dict:
        model, scores, spans = shared.value, [], []
        if model["line"] is None:
            none = [0.0] * len(batch["text"]), [[]] * len(batch["text"])
            return {"doc_id": batch["doc_id"], "score": none[0], "spans": none[1]}
        for text, (words, p) in zip(batch["text"], tag(model, batch["text"], memory), strict=True):
            x = np.array([*summary(words, p), 1.0]) @ model["line"]
            scores.append(float(1 / (1 + np.exp(-np.clip(x, -30, 30)))))
            spans.append(offsets(text or "", p) if len(p) and p.max() > 0.5 else [])
        return {"doc_id": batch["doc_id"], "score": scores, "spans": spans}

    return map_rows(docs, rows, "doc_id long, score double, spans array<struct<start:int,end:int>>", ["doc_id", "text"])


def keep_clean(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memory: dict[str, float] = {}

    def keep(texts: list[str | None]) -> list[bool]:
        line = shared.value["line"]
        if line is None:
            return [True] * len(texts)
        x = np.array([[*summary(*t), 1.0] for t in tag(shared.value, texts, memory)])
        return (1 / (1 + np.exp(-np.clip(x @ line, -30, 30))) < threshold).tolist()

    return keep_rows(docs, keep)


def offsets(text: str, p: np.ndarray) -> list[dict]:
    """Runs of toxic tokens as code point spans."""
    hot, out = p > 0.5, []
    for k, found in enumerate(_WORD.finditer(text)):
        if hot[k] and k and hot[k - 1]:
            out[-1]["end"] = found.end()
        elif hot[k]:
            out.append({"start": found.start(), "end": found.end()})
    return out
