"""The native scan against the plain reading of its model; held-out wordings."""

import re

import pytest

from slipmill.llm import licenses as L

TEXTS = [None, "", "\n\n", "Licensed under CC BY-NC 4.0.", "words of a text\nReleased under the MIT License.\nmore words", "ÉTÉ Licensed under the Apache License, Version 2.0.",
         "All rights reserved\nLicensed under CC BY 4.0\nAll rights reserved", "Released under a license of our own", "the of and with this work is", "mit dem hund",
         "x " * 50_000 + "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", "SPDX-License-Identifier: MIT",
         "/*\n * Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated\n * documentation files the Software\n *\n * more */\nend"]


def plain_scan(text):
    """(line, class, probability) of lines and of paragraphs of several lines that tell more than theirs."""
    out, run = [], []
    for k, line in enumerate([*(text or "").split("\n"), ""]):
        if re.search("[A-Za-z0-9]", line):
            run.append((k, line))
            continue
        alone = [(i, *L.predict(t)) for i, t in run]
        alone = [x for x in alone if x[1] != "none"]
        out += alone
        if len(run) > 1:
            family, p = L.predict("\n".join(t for _, t in run))
            if family != "none" and not any(x[1] == family or family == "unknown" for x in alone):
                out.append((run[0][0], family, p))
        run = []
    return sorted(out)


def test_scan_is_the_plain_reading(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, TEXTS[3]), (3, TEXTS[3])], "doc_id long, text string").selectExpr("*", "1 as _w", "'x' as licenses", "2 as _parts")
    got = sorted((((r.doc_id if r.doc_id is not None else -1), [(x.line, x.family, x.probability) for x in r.licenses]) for r in L.scan(docs).collect()))
    want = [(i, [(k, c, pytest.approx(p, abs=2e-6)) for k, c, p in plain_scan(t)]) for i, t in [*enumerate(TEXTS), (-1, TEXTS[3]), (3, TEXTS[3])]]
    assert got == sorted(want, key=lambda x: (x[0], str(x[1])))


def test_families():
    for text, family in (("This document is released under the MIT License", "mit"), ("Licensed under the Apache License 2.0", "apache"), ("Content licensed under CC BY-SA 4.0", "cc-by-sa"),
                         ("licensed under the GNU General Public License, version 2", "gpl"), ("Licensed under CC BY-NC 4.0 unless noted", "cc-by-nc")):
        assert L.predict(text)[0] == family
    assert L.predict("The boy was free to go, as was the rest of the class")[0] == "none"
    assert L.predict("All rights reserved by the landlord in the lease")[0] == "none" and L.predict("Copyright 2021 Jo. All rights reserved.")[0] == "proprietary"


def test_held_out_templates():
    found = L.held_out()
    assert found["licences_found"] >= 0.9 and found["ordinary_left"] >= 0.85


def test_empty(spark):
    assert L.summary(L.scan(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
