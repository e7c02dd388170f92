"""Native licence scan: a trained paragraph classifier, confirmed by template comparison.

Features are words and pairs of neighbours (lower-cased ``[a-z0-9]+`` with inner ``. + -``). A multinomial logistic
regression with an L1 penalty over the classes none, unknown and one per licence family is fitted on the driver to the
labelled paragraphs below, perturbed (words dropped, cropped, put into ordinary text). For the temperature that calibrates its
probabilities, and for the figures of ``held_out``, whole templates are left out of the fit, every ``HOLD``-th. Only some hundred n-grams
keep a weight.

A paragraph is a run of lines that hold a word; lines without one (empty, or only the marks of a comment) part paragraphs. A paragraph
is scored whole, and each of its lines alone, since a notice may stand on a line of a long paragraph. What a whole paragraph
gives stands beside its lines' if none of these gives the same family (for unknown: if none gives anything). Lines and paragraphs are
scored if they hold a sign, an n-gram whose weight for some licence is over that for none by ``SIGN``. A family stands if its probability is at least
``SURE`` and some template of it shares ``SHARED`` or more of its word pairs with what is scored, templates of up to ``SHORT`` words only
if they make up half of the line; what has ``SURE`` for the classes beside none together, but no confirmed family, is unknown. The
main path is DataFrame functions over literal arrays (hash, and weights by bucket), each n-gram is hashed once; no shuffle.

Defined cases: null and empty texts have no licence; ties between classes go to the first by name; repeated rows and null
doc_ids are scanned as they stand; other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmill.llm._shared import settled

SURE, SHARED, SHORT, HOLD, SIGN = 0.6, 0.6, 4, 4, 0.5
_WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Notices of public licences, by family.
TEMPLATES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3", "GNU Affero General Public License as published by the Free Software Foundation",
             "SPDX-License-Identifier: AGPL-3.0-only", "This work is licensed under the AGPL-3.0"],
    "apache": ["Licensed under the Apache License, Version 2.0", "You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0",
               "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0", "Apache License Version 2.0, January 2004",
               "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
            "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License", "Released under the BSD License", "SPDX-License-Identifier: BSD-2-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "Text is available under CC BY 3.0",
              "SPDX-License-Identifier: CC-BY-4.0", "Licensed under the Creative Commons Attribution License"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC 3.0",
                 "SPDX-License-Identifier: CC-BY-NC-4.0", "Licensed under CC BY-NC-SA 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0", "Text is available under CC BY-SA 3.0",
                 "SPDX-License-Identifier: CC-BY-SA-4.0", "available under the Creative Commons Attribution-ShareAlike License"],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0 Universal", "Licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0",
            "This is free and unencumbered software released into the public domain", "released into the public domain"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or at your option any later version",
            "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU General Public License v2", "Licensed under the GPL-3.0", "Released under the GNU GPL version 2"],
    "isc": ["Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC", "Released under the ISC License",
            "Licensed under the ISC License"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License as published by the Free Software Foundation",
             "SPDX-License-Identifier: LGPL-2.1-or-later", "Released under the LGPL-3.0"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", "The MIT License (MIT)",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files the Software",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0",
            "Released under the Mozilla Public License, version 2.0"],
    "proprietary": ["Copyright 2024. All rights reserved", "All rights reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited", "Proprietary and confidential",
                    "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher"],
}
#: Paragraphs that speak of a licence of no family above, and ordinary ones.
UNKNOWN = ["Licensed under the terms of the vendor agreement", "This software is licensed, not sold", "See the license file for details", "Released under a custom license",
           "Licensed under the European Union Public License", "Distributed under the Artistic License 2.0", "Released under the Boost Software License", "Licensed under the Eclipse Public License",
           "Use of this software is governed by the license agreement", "SPDX-License-Identifier: NOASSERTION", "Released under the terms stated in the accompanying license",
           "This work is licensed under the Open Database License", "Licensed under the SIL Open Font License", "the license of this work is not known", "Licensed to you under our terms"]
ORDINARY = ["The meeting was held in the public library on Monday", "He published a version of the story in January", "She may obtain the result at the end of the day", "The source of the river is in the north of the country",
            "You need a driving licence to rent a car", "The software was used by the school for many years", "This work is hard and takes a lot of time", "They released the new album in the spring",
            "Any person may enter the garden free of charge", "The form has to be signed and returned by post", "No part of the house was damaged in the storm", "A copy of the letter was found under the bed",
            "The foundation gave money to the general hospital", "He was granted permission to leave", "The rights of the people are written in the law", "Attribution of the painting is uncertain",
            "The following conditions of the road are bad", "The public has a right to know", "Her mit was lost in the snow", "The terms of the treaty were agreed on in May",
            "With or without you the show must go on", "The university is one of the oldest in Europe", "Text and pictures are shown on the next page", "the and of to in a is that for it as was with be by on not he his but at are this",
            "have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people mr how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three",
            "All rights are reserved by the owner of the house in the contract", "The seats are reserved for the guests", "All human rights reserved a place in his speech", "rights reserved to the states",
            "All rights reserved by the tenant were lost in court", "The price covers all rights reserved by the heirs", "A table reserved by the guest in the hall", "rooms reserved by the school in the spring",
            "mit dem zug in die stadt", "la casa de la familia en el norte", "le chat est sur la table avec du lait", "der hund und die katze im garten", "los derechos de todos"]
CLASSES = ["none", "unknown", *sorted(TEMPLATES)]


def grams(text: str) -> list[str]:
    """Distinct words and pairs of neighbours, in order."""
    w = re.findall(_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))
    return list(dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]))


def _texts(held: bool) -> list[tuple[str, int]]:
    """Labelled paragraphs: those that ``held_out`` leaves out, or the others."""
    out = []
    for label, name in enumerate(CLASSES):
        for k, text in enumerate({"none": ORDINARY, "unknown": UNKNOWN}.get(name) or TEMPLATES[name]):
            if (k % HOLD == HOLD - 1) == held:
                out.append((text, label))
    return out


def _examples(texts: list[tuple[str, int]], copies: int = 10) -> list[tuple[str, int]]:
    """Each of texts as it stands and in perturbed forms, and ordinary words."""
    rng = np.random.default_rng(5)
    filler = [w for t in ORDINARY for w in t.split()]
    out = []
    for text, label in texts:
        words = text.split()
        out += [(text, label)] * 2
        for k in range(copies):
            part = words
            if k % 3 == 0 and len(words) > 6:
                part = [w for w in words if rng.random() > 0.1]
            elif k % 3 == 1 and len(words) > 10:
                n = int(rng.integers(len(words) * 3 // 4, len(words) + 1))
                at = int(rng.integers(0, len(words) - n + 1))
                part = words[at : at + n]
            around = [rng.choice(filler, int(rng.integers(0, 12))).tolist() for _ in range(2)]
            out.append((" ".join([*around[0], *part, *around[1]]), label))
    for _ in range(400):
        out.append((" ".join(rng.choice(filler, int(rng.integers(1, 30)))), 0))
    return out


def _fitted(texts: list[tuple[str, int]]) -> tuple[list[str], np.ndarray]:
    """n-grams and their weights; the last row is the bias."""
    examples = _examples(texts)
    names = sorted({g for t, _ in examples for g in grams(t)})
    x = _rows([t for t, _ in examples], names)
    common = x.sum(axis=0) >= 3
    return [g for g, ok in zip(names, common, strict=False) if ok], _fit(x[:, common], np.array([label for _, label in examples]))


def _rows(texts: list[str], names: list[str]) -> np.ndarray:
    """Which n-grams stand in each text, and a column of ones."""
    place, x = {g: i for i, g in enumerate(names)}, np.zeros((len(texts), len(names) + 1))
    for row, text in zip(x, texts, strict=True):
        row[[place[g] for g in grams(text) if g in place]] = 1
    x[:, -1] = 1
    return x


@functools.cache
def held_out() -> dict:
    """Of the templates left out of a fit: the temperature that suits them best, the share of licences that are found as some licence (family or
    unknown) and of ordinary paragraphs that are not, at that temperature."""
    names, w = _fitted(_texts(False))
    asked = _texts(True)
    y, logits = np.array([label for _, label in asked]), _rows([t for t, _ in asked], names) @ w
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
    heat = min((0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5, 2.0), key=loss)
    any_ = 1 - _softmax(logits / heat)[:, 0] >= SURE
    return {"temperature": heat, "licences_found": float(any_[y > 0].mean()), "ordinary_left": float((~any_[y == 0]).mean())}


@functools.cache
def model() -> dict:
    """grams: weights by class, rounded, and the biases; all divided by the temperature. signs: n-grams that speak for a licence."""
    names, w = _fitted([*_texts(False), *_texts(True)])
    w = np.round(w / held_out()["temperature"], 3)
    used = np.flatnonzero(np.abs(w[:-1]).max(axis=1) > 0)
    return {"weights": {names[i]: w[i].tolist() for i in used}, "bias": w[-1].tolist(), "signs": {names[i] for i in used if w[i, 1:].max() - w[i, 0] >= SIGN}}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 4e-4, rounds: int = 150) -> np.ndarray:
    """Accelerated proximal gradient; the last column, the bias, is not penalised."""
    classes = len(CLASSES)
    share = 1 / np.bincount(y, minlength=classes)[y]
    share /= share.sum()
    target = np.eye(classes)[y]
    rate = 2 / max(1e-9, float((share[:, None] * x**2).sum(axis=1).sum()) )
    rate *= 4
    w = v = np.zeros((x.shape[1], classes))
    t = 1.0
    for _ in range(rounds):
        grad = x.T @ (share[:, None] * (_softmax(x @ v) - target))
        new = v - rate * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    return w


def _pairs(text: str) -> list[str]:
    return [g for g in grams(text) if " " in g] or grams(text)


def _confirmed(words: list[str], held: set[str], template: str) -> bool:
    pairs, size = _pairs(template), len(re.findall(_WORD, template.lower()))
    return sum(g in held for g in pairs) >= SHARED * len(pairs) and (size > SHORT or 2 * size >= len(words))


def predict(paragraph: str) -> tuple[str, float]:
    """(class, probability) of a line or paragraph: the plain reading of what scan() computes."""
    m, found = model(), grams(paragraph)
    if not any(g in m["signs"] for g in found):
        return "none", 0.0
    z = np.array(m["bias"]) + sum((np.array(m["weights"][g]) for g in found if g in m["weights"]), np.zeros(len(CLASSES)))
    p = _softmax(z[None])[0]
    best = 2 + int(np.argmax(p[2:]))
    words = re.findall(_WORD, paragraph.translate(str.maketrans(_UPPER, _LOWER)))
    if p[best] >= SURE and any(_confirmed(words, set(found), t) for t in TEMPLATES[CLASSES[best]]):
        return CLASSES[best], float(p[best])
    return ("unknown", float(1 - p[0])) if 1 - p[0] >= SURE else ("none", 0.0)


def _table() -> tuple[int, list[int], list[int], list[list[float]], int]:
    """(buckets, hash in each, row of each, weight rows, how many of these are signs, which come first): every n-gram alone in its bucket."""
    m = model()
    names = sorted(m["weights"], key=lambda g: (g not in m["signs"], g))
    signed = [h - (1 << 64) if h >> 63 else h for h in (xxhash.xxh64_intdigest(g, 42) for g in names)]
    buckets = 1 << 12
    while len({h % buckets for h in signed}) < len(names):
        buckets += 1
    held, row = [0] * buckets, [0] * buckets
    for i, h in enumerate(signed):
        held[h % buckets], row[h % buckets] = h, i
    return buckets, held, row, [m["weights"][g] for g in names], len(m["signs"])


def _words(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"({_WORD})"), F.lit(1))


def _neighbours(words: Column) -> Column:
    """Pairs of neighbouring words."""
    return F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and licenses (line, family or unknown, probability) of every document; lines count from 0, a paragraph's is its first with a word."""
    buckets, held, row, weights, signs = _table()
    literal = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    keys, rows = literal(held, "bigint"), literal(row, "int")
    columns = [literal((w[c] for w in weights), "double") for c in range(len(CLASSES))]
    bias = model()["bias"]

    def known(some: Column) -> Column:
        """Rows of the n-grams that have one."""
        bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
        found = F.filter(F.transform(some, lambda g: F.xxhash64(g)), lambda h: F.get(keys, bucket(h)) == h)
        return F.transform(found, lambda h: F.get(rows, bucket(h)))

    low = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    parts = F.split(low, r"\n(?=[^a-z0-9\n]*(?:\n|\z))", -1)
    out = docs.select("doc_id", parts.alias("_parts"))
    lines = F.transform("_parts", lambda part: F.transform(F.split(part, "\n", -1), _words))
    out = out.withColumn("_w", lines)
    out = out.withColumn("_h", F.transform("_w", lambda part: F.transform(part, lambda w: known(F.concat(w, _neighbours(w))))))
    sign = lambda h: F.exists(h, lambda r: r < signs)

    def across(part: Column) -> Column:
        """Pairs over the ends of lines; of a paragraph's lines only the first can be without words."""
        full = F.filter(part, lambda w: F.size(w) > 0)
        return F.transform(F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))), lambda w, i: F.concat(F.element_at(F.get(full, i), -1), F.lit(" "), F.get(w, 0)))

    def unit(k: Column, line: Column, hits: Column, words: Column, whole: bool) -> Column:
        return F.struct(k.alias("k"), line.cast("int").alias("line"), F.lit(whole).alias("whole"), hits.alias("hits"), words.alias("words"))

    def units(part: Column, k: Column) -> Column:
        h = F.get(F.col("_h"), k)
        alone = F.filter(F.transform(part, lambda w, i: unit(k, i, F.array_distinct(F.get(h, i)), w, False)), lambda u: sign(u["hits"]))
        first = F.when(F.size(F.get(part, 0)) > 0, 0).otherwise(1)
        return F.when(F.size(F.filter(part, lambda w: F.size(w) > 0)) < 2, alone).otherwise(F.concat(alone, F.filter(
            F.array(unit(k, first, F.array_distinct(F.concat(F.flatten(h), known(across(part)))), F.flatten(part), True)), lambda u: sign(u["hits"]))))

    out = out.select("doc_id", "_parts", F.flatten(F.transform("_w", units)).alias("_u"))
    summed = lambda u, c: F.aggregate(u["hits"], F.lit(bias[c]).cast("double"), lambda a, r: a + F.get(columns[c], r))
    logits = lambda u: F.array(*(summed(u, c) for c in range(len(CLASSES))))
    carry = lambda u: [u[c].alias(c) for c in ("k", "line", "whole", "words")]
    out = out.withColumn("_z", F.transform("_u", lambda u: F.struct(*carry(u), logits(u).alias("z")))).drop("_u")
    out = out.withColumn("_e", F.transform("_z", lambda u: F.struct(*carry(u), F.transform(u["z"], lambda z: F.exp(z - F.array_max(u["z"]))).alias("e")))).drop("_z")
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    families = lambda e: F.slice(e, 3, len(CLASSES) - 2)
    out = out.withColumn("_s", F.transform("_e", lambda u: F.struct(*carry(u), (1 - u["e"][0] / total(u["e"])).alias("any"), (F.array_max(families(u["e"])) / total(u["e"])).alias("p"),
                                                                    F.array_position(families(u["e"]), F.array_max(families(u["e"]))).cast("int").alias("best")))).drop("_e")
    size = lambda t: len(re.findall(_WORD, t.lower()))
    templates = F.array(*(F.array(*(F.struct(F.lit(size(t)).alias("n"), F.array(*(F.lit(g) for g in _pairs(t))).alias("pairs")) for t in TEMPLATES[name])) for name in CLASSES[2:]))

    def confirmed(u: Column) -> Column:
        seen = F.concat(u["words"], _neighbours(u["words"]))
        return F.exists(F.get(templates, u["best"] - 1), lambda t: (F.size(F.array_intersect(t["pairs"], seen)) >= SHARED * F.size(t["pairs"]))
                        & ((t["n"] > SHORT) | (2 * t["n"] >= F.size(u["words"]))))

    names = F.array(*(F.lit(c) for c in CLASSES[2:]))
    named = F.transform(F.filter("_s", lambda u: u["any"] >= SURE), lambda u: F.struct(u["k"].alias("k"), u["line"].alias("line"), u["whole"].alias("whole"), u["any"].alias("any"), u["p"].alias("p"),
                                                                                       F.when((u["p"] >= SURE) & confirmed(u), F.get(names, u["best"] - 1)).otherwise("unknown").alias("family")))
    out = out.select("doc_id", "_parts", settled(named).alias("_f"))
    told = lambda u: F.exists("_f", lambda s: ~s["whole"] & (s["k"] == u["k"]) & ((s["family"] == u["family"]) | (u["family"] == "unknown")))
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    before = lambda k: F.aggregate(F.slice("_parts", F.lit(1), k), F.lit(0), lambda a, t: a + breaks(t) + 1)
    found = F.transform(F.filter("_f", lambda u: ~u["whole"] | ~told(u)), lambda u: F.struct(
        (before(u["k"]) + u["line"]).alias("line"), u["family"].alias("family"), F.round(F.when(u["family"] == "unknown", u["any"]).otherwise(u["p"]), 6).alias("probability")))
    return out.select("doc_id", settled(F.array_sort(found)).alias("licenses"))


def summary(found: DataFrame) -> DataFrame:
    """One row a document: how many lines name a family and how many an unknown licence, and the families."""
    sure = F.filter("licenses", lambda x: x["family"] != "unknown")
    return found.select("doc_id", F.size(sure).cast("long").alias("n_confirmed"), (F.size("licenses") - F.size(sure)).cast("long").alias("n_unknown"),
                        F.array_join(F.sort_array(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"))
