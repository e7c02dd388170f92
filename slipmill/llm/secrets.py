"""Secrets: fixed patterns, and the guess cost of values that stand where credentials stand.

Three patterns give the base spans (assign, access, hex). Beside them, every value in a credential context (``password: x``,
``pwd=x``, ``Authorization: Bearer x``, ``passphrase is x`` ...) gets the number of guesses that finding it takes: the
cheapest segmentation into words, dates, repeats, runs of the alphabet or of digits, walks over neighbouring keys (with turns),
speakable letters and brute-force stretches, by dynamic programming over the whole value. Every stretch of these kinds is offered,
not only the longest. Values of ``threshold`` decimal digits of guesses or more are spans of the kind guess. ``pass: please`` is cheap
and stays; a random key is not.

Words are ranked: the fixed ones, and after them, if a trusted corpus is given, those that ``vocabulary`` counts in it (a job; at most ``RANKS`` of
them reach the driver). A guess list is public, so its rank is the number of guesses. By default a document's spans depend on its text alone: a corpus that is scanned
teaches nothing, as a secret would teach itself.

All spans are code points of the whole text, end exclusive. One pass over the documents, no shuffle.

Defined cases: null and empty texts have no spans; a pattern's matches are the leftmost non-overlapping ones, those that
are too short being used up but not reported; spans of different kinds may overlap; repeated rows and null doc_ids are
scanned as they stand; other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipmill.llm._shared import map_rows, words_of

#: Decimal digits of guesses from which a value counts as a secret.
THRESHOLD = 10.0
MASK = "[SECRET]"
KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|signing|encryption)[_-]?key|credentials?|auth(?:orization)?)"""
    r"""["'`]?(?:[\x20\t]*(?:=>|:=|[:=])[\x20\t]*(?:(?:bearer|basic)[\x20\t]+)?|[\x20\t]+is[\x20\t]+)["'`]?([^\s"'`,;<>(){}\[\]]{6,})""", re.I | re.A)
_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")

#: Frequent words of passwords, most frequent first; the place is the number of guesses.
COMMON = """password admin root user login letmein welcome qwerty dragon monkey shadow master sunshine princess football
baseball superman batman trustno iloveyou hello freedom whatever secret token change changeme default example sample test
testing demo guest public private none null true false please enter your here value string hidden redacted placeholder the
and for with this that from have not you are was but all can had her one our out day get has him his how man new now old see
two way who boy did its let put say she too use summer winter spring autumn january february march april june july august
september october november december monday tuesday friday sunday love baby angel lovely star family jordan michael thomas
access key server database mysql oracle linux windows apple google computer internet""".split()
#: The rows of a keyboard, and how far each is shifted to the right, in keys.
ROWS = (("`1234567890-=", -1.0), ("qwertyuiop[]", 0.5), ("asdfghjkl;'", 0.75), ("zxcvbnm,./", 1.25))
#: Most words of a corpus that are ranked, least documents that have one; longest unit of a repeat.
RANKS, DOCUMENTS, UNIT = 20_000, 5, 16

_FIXED = {w: math.log10(i + 1) for i, w in reversed(list(enumerate(dict.fromkeys(COMMON))))}
_PLAIN = str.maketrans("430157$@!", "aeoistsai")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
_VOWELS = frozenset("aeiouy")
#: log10 of guesses: a new stretch; the first key of a walk, a turn of it, a step straight on; the start of a run, a step of it; another copy of
#: a repeat; the first of speakable letters, a change between vowel and consonant, a letter of the same kind.
STRETCH, WALK, TURN, AHEAD, RUN, STEP, COPY, SPEAK, CHANGE, SAME = 0.301, 1.68, 0.7, 0.1, 1.0, 0.1, 0.1, 1.5, 0.5, 0.85


def _places() -> dict[str, tuple[float, float]]:
    shifted = dict(zip("~!@#$%^&*()_+{}|:\"<>?", "`1234567890-=[]\\;',./"))
    at = {c: (row, x + shift) for row, (keys, shift) in enumerate(ROWS) for x, c in enumerate(keys)}
    return at | {c: at[k] for c, k in shifted.items() if k in at}


_AT = _places()
#: (a, b) -> direction, for keys next to each other.
_WAY = {(a, b): (q[0] - p[0], (q[1] > p[1]) - (q[1] < p[1])) for a, p in _AT.items() for b, q in _AT.items()
        if p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1}


def _letters(c: str) -> int:
    """How many characters an attacker tries for one like c."""
    if c.isascii():
        return 10 if c.isdigit() else 26 if c.isalpha() else 33
    return 100


def _low(value: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def word_pieces(value: str, words: dict[str, float]) -> list[tuple[int, int, float]]:
    """(start, end, cost) of every stretch of three characters or more that is a word, in lower case or with signs for letters, or a date."""
    low, out = _low(value), []
    plain, most = low.translate(_PLAIN), max(map(len, words), default=0)
    for at in range(len(value)):
        for end in range(at + 3, min(len(value), at + most) + 1):
            costs = [words[form[at:end]] + extra for form, extra in ((low, 0.0), (plain, 0.6)) if form[at:end] in words]
            if costs:
                out.append((at, end, min(costs) + 0.5 * (value[at:end] != low[at:end])))
        for end in range(at + 4, min(len(value), at + 10) + 1):
            if _DATE.fullmatch(value, at, end):
                out.append((at, end, math.log10(140) if end == at + 4 else math.log10(365 * 140)))
    return out


def guess_cost(value: str, words: dict[str, float] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes; work in proportion to its length.

    States are the kinds of the stretch that ends at a place: each is entered from the cheapest of all (done) for STRETCH and grows a
    character at a time (a repeat: a copy), so a stretch of any length is one path.
    """
    return _cost(value, _FIXED if words is None else words, {})


def _cost(value: str, words: dict[str, float], units: dict[str, float]) -> float:
    n, low = len(value), _low(value)
    ending: dict[int, list[tuple[int, float]]] = {}
    for a, b, cost in word_pieces(value, words):
        ending.setdefault(b, []).append((a, cost))
    done = [0.0] + [math.inf] * n
    brute, walk, run, speak = math.inf, {}, {}, {}
    again: list[dict[int, float]] = [{} for _ in range(n + 1)]
    for i in range(1, n + 1):
        c, sign = low[i - 1], math.log10(_letters(value[i - 1]))
        brute = min(brute, done[i - 1] + STRETCH) + sign
        # Walks and runs start with three characters; only the first of speakable letters may be a capital.
        steps = [(low[k - 1], low[k]) for k in range(max(1, i - 3), i)]
        ways, walk_to = [_WAY.get(s) for s in steps], {}
        if ways and ways[-1]:
            for way, cost in walk.items():
                walk_to[ways[-1]] = min(walk_to.get(ways[-1], math.inf), cost + (AHEAD if way == ways[-1] else TURN))
            if i >= 3 and ways[-2]:
                walk_to[ways[-1]] = min(walk_to.get(ways[-1], math.inf), done[i - 3] + STRETCH + WALK + TURN + (AHEAD if ways[-2] == ways[-1] else TURN))
        gaps, run_to = [ord(b) - ord(a) for a, b in steps], {}
        if gaps and gaps[-1] in (1, -1):
            costs = [run[gaps[-1]] + STEP] if gaps[-1] in run else []
            if i >= 3 and gaps[-2] == gaps[-1]:
                costs.append(done[i - 3] + STRETCH + RUN + 2 * STEP)
            run_to = {gaps[-1]: min(costs)} if costs else {}
        speak_to = {}
        if "a" <= c <= "z":
            for (kind, length), cost in speak.items() if value[i - 1] == c else ():
                more = length + 1 if kind == (c in _VOWELS) else 1
                if more < 3:
                    key = (c in _VOWELS, more)
                    speak_to[key] = min(speak_to.get(key, math.inf), cost + (CHANGE if more == 1 else SAME))
            key = (c in _VOWELS, 1)
            speak_to[key] = min(speak_to.get(key, math.inf), done[i - 1] + STRETCH + SPEAK + 0.5 * (value[i - 1] != c))
        walk, run, speak = walk_to, run_to, speak_to
        for p in range(1, min(UNIT, i // 2) + 1):
            if value[i - p : i] == value[i - 2 * p : i - p]:
                unit = value[i - p : i]
                if unit not in units:
                    units[unit] = _cost(unit, words, units) if p > 1 else sign
                cost = min(done[i - 2 * p] + STRETCH + units[unit] + COPY, again[i - p].get(p, math.inf) + COPY)
                again[i][p] = cost
        done[i] = min([brute, *walk.values(), *run.values(), *speak.values(), *again[i].values(), *(done[a] + STRETCH + cost for a, cost in ending.get(i, ()))])
    return done[n]


def vocabulary(docs: DataFrame, ranks: int = RANKS, least: int = DOCUMENTS) -> dict[str, float]:
    """Words of 3 to 15 letters with the cost of their rank: the fixed ones, then those that stand in most documents of docs, a trusted corpus: what it teaches is no secret
    any more, so the texts that are scanned should not teach it. Values in credential context are left out, and words of under `least` documents. Tokens count where they stand between
    white space, in lower case or with a capital, with no sign but one at their end, so parts of keys are no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    for pattern in (_ASSIGN, _CONTEXT):
        text = F.regexp_replace(text, "(?i)" + pattern.pattern, " ")
    token = F.explode(F.array_distinct(words_of(text))).alias("w")
    word = F.lower(F.regexp_extract("w", r"^([A-Z]?[a-z]{2,14})[.,;:!?]?$", 1)).alias("w")
    counted = docs.select(token).select(word).where("w <> ''").groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    out, place = dict(_FIXED), len(_FIXED)
    for r in counted.orderBy(F.desc("n"), "w").limit(ranks).collect():
        if r.w not in out:
            place += 1
            out[r.w] = math.log10(place)
    return out


def find(text: str | None, threshold: float = THRESHOLD, words: dict[str, float] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start, then kind as listed."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(s in low for s in _STEMS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        at = {m.span(1) for m in _CONTEXT.finditer(text)} | {m.span(2) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6}
        out += [("guess", a, b) for a, b in at if guess_cost(text[a:b], words) >= threshold]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, threshold: float = THRESHOLD, words: dict[str, float] | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end) of every document of docs (doc_id, text); words: see vocabulary(), by default the fixed ones."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def rows(batch: dict) -> dict:
        found = [find(t, threshold, shared.value) for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found]}

    return map_rows(docs, rows, "doc_id long, spans array<struct<kind:string,start:int,end:int>>", ["doc_id", "text"])


def digest(found: DataFrame) -> DataFrame:
    """scan()'s rows as counts, the SHA-256 of the base spans and all spans as one string."""
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(line(base), 256).alias("base_sha256"), line("spans").alias("spans"))


def masked(text: str | None, threshold: float = THRESHOLD, words: dict[str, float] | None = None) -> str | None:
    """text with every secret replaced by a mask; overlapping spans become one."""
    if not (spans := find(text, threshold, words)):
        return text
    out, at, end = [], 0, -1
    for _, a, b in spans:
        if a >= end:
            out += [text[at:a], MASK]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, threshold: float = THRESHOLD, words: dict[str, float] | None = None) -> DataFrame:
    """docs with the secrets of their texts masked and n_chars, if there is one, counted anew; other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                where = part.schema.names.index("text")
                text = pa.array([masked(t, threshold, shared.value) for t in part.column(where).to_pylist()], type=part.schema.field(where).type)
                yield part.set_column(where, part.schema.field(where), text)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
