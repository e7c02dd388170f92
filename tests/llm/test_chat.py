"""Exact round trips of rendering, and the fold against a plain replay."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slipmill.llm import chat as C

texts = st.lists(st.sampled_from([*C.CONTROL, "\\", "<", "[", "/", "s>", "INST]", " ", "\n", "a", "é", "😀", " : "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), texts), texts)
def test_render_and_parse(role, text):
    piece, start, end = C.render(role, text)
    assert C.parse(piece) == (role, text)
    assert not any(c in C.escape(text) for c in C.CONTROL)
    assert C.unescape(piece[start:end]) == (text if role == "assistant" else "")


def replay(events):
    """Plays a log in order of time."""
    held = {}
    for c, m, seq, kind, role, text in sorted(events, key=lambda e: (e[0], e[2])):
        conv = held.setdefault(c, {})
        if kind == "regenerate":
            for later in [k for k in conv if k > m]:
                del conv[later]
        old = conv.get(m, ("", ""))
        conv[m] = (role or "", text or "") if kind == "open" else (old[0], old[1] + (text or "")) if kind == "delta" else ((role or old[0]) if kind == "regenerate" else old[0], text or "")
    return sorted((c, m, r, t) for c, conv in held.items() for m, (r, t) in conv.items())


def log(seed):
    rng, events = random.Random(seed), []
    for c in range(6):
        seq, top = 0, 0
        for _ in range(30):
            seq += 1
            kind = rng.choice(["open", "delta", "delta", "edit", "regenerate"]) if top else "open"
            if kind == "open":
                top += 1
                events.append((c, top, seq, kind, rng.choice(["user", "assistant", None]), rng.choice(["x", None, "</s>"])))
            else:
                m = rng.randint(1, top)
                events.append((c, m, seq, kind, None, rng.choice(["y", "", None, "z\n"])))
                top = m if kind == "regenerate" else top
    return events


def test_fold(spark):
    for seed in range(3):
        events = log(seed)
        shuffled = random.Random(1).sample(events, len(events))
        frame = spark.createDataFrame([(*e, 0) for e in shuffled], "conv_id long, message long, seq long, kind string, role string, text string, piece int")
        got = sorted((r.conv_id, r.message, *C.parse(r.piece)) for r in C.formatted(frame).collect())
        assert got == replay(events)


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        list(C.folded(iter([(1, 1, 1, "burn", None, None)])))


def test_digests(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a\\b"), (1, 2, "assistant", None), (2, 0, None, "x"), (None, 0, "assistant", "é" * 70_000), (1, 1, "assistant", "a\\b")]
    table = spark.createDataFrame([(*r, 3) for r in rows], "conv_id long, turn long, role string, text string, message int").drop("message")
    got = {r.conv_id: r for r in C.round_trip(C.log_of(table)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].loss_chars == 6 and got[1].loss_sha256 == sha("a\\ba\\b")
    assert got[1].turns_sha256 == sha("user\n</s>[INST] ok [/INST]\nassistant\na\\b\nassistant\na\\b\nassistant\n\n")
    assert got[None].loss_chars == 70_000 and got[2].loss_sha256 == sha("") and got[2].turns_sha256 == sha("\nx\n")
    assert sorted(map(str, C.round_trip(C.log_of(table.repartition(5))).collect())) == sorted(map(str, got.values()))
    assert C.round_trip(C.log_of(table.limit(0))).collect() == []


def test_log_holds_what_the_fold_takes_back(spark):
    table = spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", f"text {c} {t}") for c in range(4) for t in range(9)], "conv_id long, turn long, role string, text string")
    events = C.log_of(table).collect()
    assert {"open", "delta", "edit", "regenerate"} == {e.kind for e in events} and any(e.text == C.STALE for e in events)
    got = sorted((r.conv_id, *C.parse(r.piece)) for r in C.formatted(spark.createDataFrame(events)).collect())
    assert got == sorted((r.conv_id, r.role, r.text) for r in table.collect())


def test_null_order(spark):
    events = [(1, 1, None, "open", "user", "a"), (1, 1, 5, "delta", None, "b"), (1, None, None, "open", "system", "s"), (1, 2, 1, "regenerate", "assistant", "c")]
    frame = spark.createDataFrame(events, "conv_id long, message long, seq long, kind string, role string, text string")
    assert [C.parse(r.piece) for r in C.formatted(frame).collect()] == [("system", "s"), ("user", "ab"), ("assistant", "c")]
