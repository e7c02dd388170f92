"""Regular expressions with Unicode classes and line feeds as the only line ends, and trimming of all Unicode white space."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Unicode white space, written out: a class of ranges is several times as fast as the property.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space as a string.
SPACES = "".join(re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))))


@functools.cache
def rx(pattern: str, flags: str = "") -> str:
    """pattern with Unicode classes, and line feeds as the only line ends."""
    if "(?i)" in pattern:
        return f"(?dU{flags}){pattern}"
    out, inside = [], False
    for part in re.findall(r"\\.|.", pattern, re.S):
        if part in (r"\s", r"\S"):
            part = WHITE if inside else f"[{'^' * (part == chr(92) + 'S')}{WHITE}]"
        elif part in (r"\d", r"\D"):
            part = rf"\{'p' if part[1] == 'd' else 'P'}{{Nd}}"
        elif part in "[]":
            inside = part == "["
        out.append(part)
    return f"(?d{flags}){''.join(out)}"


def trim_u(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    """Whether c is null or nothing but white space."""
    return F.ltrim(F.coalesce(c, F.lit("")), F.lit(SPACES)) == ""


def some(c: Column) -> Column:
    """c, or null where it is empty."""
    return F.when(c != "", c)


def first(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return some(F.regexp_extract(c, rx(pattern), group))


def every(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of all matches."""
    return F.regexp_extract_all(c, F.lit(rx(pattern)), F.lit(group))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def settled(c: Column) -> Column:
    """c, in a projection that filters stay above. For costly columns that later filters would else compute anew, name by name."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def groups(c: Column, pattern: str, n: int) -> Column:
    """An array of the first n groups of the first match by one pass of the pattern; null without a match."""
    found = F.regexp_extract(c, rx(pattern), 0)
    marked = F.regexp_replace(found, rx(pattern), "\u0001".join(f"${k}" for k in range(1, n + 1)))
    return F.when(found != "", F.split(marked, "\u0001", -1))


#: Any characters, as few as will do; a class, since a group in its place is several times as slow. It does not nest, so long texts need no deep stack.
FAR = r"[\x{0}-\x{10FFFF}]*?"


def searched(c: Column, patterns: list[str], n: int) -> Column:
    """The n groups of the first match of each pattern, by one pass over c for all of them: an array of strings, empty where a group or a pattern has no match.
    The text is decoded once, not once a pattern. A group must not hold a line feed, unless it is the last."""
    ahead = "".join(f"(?:(?={FAR}(?:{p}))|)" for p in patterns)
    return F.split(F.regexp_replace(c, rx(rf"\A{ahead}(?s:.*)"), "\n".join(f"${k}" for k in range(1, n + 1))), "\n", n)


def has(c: Column, *words: str) -> Column:
    """Any of the words stands in c."""
    out = F.contains(c, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(c, F.lit(w))
    return out
