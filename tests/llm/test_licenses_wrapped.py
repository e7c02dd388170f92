"""Notices that are wrapped over lines keep their family; the offset is the first line of their run."""

import textwrap

from slipmill.llm import licenses as L


def test_wrapped_notices(spark):
    rows, want = [], {}
    for family in ("bsd", "isc", "gpl", "lgpl"):
        text = max(L.TEMPLATES[family], key=len)
        for width in (30, 40):
            i = len(rows)
            rows.append((i, "Some words\n \t\n" + textwrap.fill(text, width) + "\n\nmore words"))
            want[i] = family
    got = {r.doc_id: {(x.line, x.family) for x in r.licenses} for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((2, family) in got[i] or family in {f for _, f in got[i]} for i, family in want.items()), got
    assert any((2, f) in got[i] for i, f in want.items() if f in ("bsd", "isc"))
