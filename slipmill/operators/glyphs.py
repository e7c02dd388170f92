"""A bitmap font and a matrix code of our own, drawn and read with NumPy: plug-in models for forms that are printed with them, for queries and for tests.

A glyph is 5 x 9 cells. Its top row is full and its bottom row has every other cell, so a line shows its height and which way up it stands; the 7 rows between
are bits of a hash of the character. Lines are read by normalised cross-correlation of their columns with all glyphs, so the reader is a model like any other: a
tensor in, scores of steps by classes out. The matrix code is a framed square of bits: length, check sum, bytes.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from slipmill.operators import images, maps

ROWS, COLUMNS, GAP, SCALE, PITCH = 9, 5, 1, 2, 16
#: Pixels of a cell as lines are compared; score of a step without a character.
CELL, BLANK = 3, 0.7
#: Bytes of drawn pages that a worker holds before it hands them on.
HELD = 4_000_000
#: Cells of a matrix code's side, frame and white border aside.
SIDE = 26
#: Characters of rendered receipts.
ALPHABET = list("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz#.,:;-+/%*()¥：（）→发票代码号开日期年月名称纳税人识别统一社会信用合计价大小写额壹佰元整项目货物甲")


@functools.cache
def glyph(character: str) -> np.ndarray:
    """ROWS x COLUMNS cells of a character, true where there is ink."""
    bits = np.unpackbits(np.frombuffer(hashlib.blake2b(character.encode(), digest_size=5).digest(), np.uint8))
    cells = np.ones((ROWS, COLUMNS), bool)
    cells[1:-1] = bits[: (ROWS - 2) * COLUMNS].reshape(ROWS - 2, COLUMNS) > 0
    cells[-1, 1::2] = False
    return cells


def line(text: str, scale: int = SCALE) -> np.ndarray:
    """Ink of a line of text; white space is not drawn."""
    parts = [_form(c, scale) for c in "".join(text.split())]
    return np.concatenate(parts, axis=1)[:, : -GAP * scale] if parts else np.zeros((ROWS * scale, scale), bool)


@functools.cache
def _form(character: str, scale: int) -> np.ndarray:
    return _grown(np.pad(glyph(character), ((0, 0), (0, GAP))), scale)


def _grown(cells: np.ndarray, scale: int) -> np.ndarray:
    return cells.repeat(scale, axis=0).repeat(scale, axis=1)


def code(payload: str, scale: int = SCALE) -> np.ndarray:
    """Ink of the matrix code of a payload of at most SIDE * SIDE / 8 - 6 bytes in UTF-8."""
    data = payload.encode()
    data = len(data).to_bytes(2, "big") + zlib.crc32(data).to_bytes(4, "big") + data
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    if len(bits) > SIDE * SIDE:
        raise ValueError(f"a payload of {len(data) - 6} bytes")
    cells = np.pad(np.resize(np.pad(bits, (0, SIDE * SIDE - len(bits))), (SIDE, SIDE)) > 0, 1)  # white border
    return _grown(np.pad(cells, 1, constant_values=True), scale)


def page(lines: Sequence[str], payload: str | None = None, turned: Sequence[int] = (), scale: int = SCALE) -> np.ndarray:
    """A gray page: the code in the upper right corner, lines below it, those whose numbers are in turned upside down. Margins are wide enough for boxes that grow."""
    ink = [line(t, scale) for t in lines]
    square = code(payload, scale) if payload is not None else np.zeros((0, 0), bool)
    margin = max([i.shape[1] for i in ink], default=1) // 4 + 8 * scale
    top = square.shape[0] + 8 * scale
    out = np.full((top + (len(ink) * PITCH + 8) * scale, max([square.shape[1], *(i.shape[1] for i in ink)]) + 2 * margin), 255, np.uint8)
    dark = lambda i: np.where(i, np.uint8(0), np.uint8(255))
    out[4 * scale : 4 * scale + square.shape[0], out.shape[1] - 4 * scale - square.shape[1] : out.shape[1] - 4 * scale] = dark(square)
    for k, i in enumerate(ink):
        y = top + k * PITCH * scale
        out[y : y + i.shape[0], margin : margin + i.shape[1]] = dark(i[::-1, ::-1] if k in turned else i)
    return out


def drawn(text: Column, payload: Column, turned: Column) -> Column:
    """An image of a text's lines with its matrix code (null: none); turned: numbers of lines that stand on their heads. A null text has no image. The worker
    hands images on as they fill HELD bytes, so it holds no more than that, however many rows come in one batch."""

    @F.pandas_udf(images.GRAY)
    def run(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return _pages(frames)

    return run(text, payload, turned)


def _pages(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]], most: int = HELD) -> Iterator[pd.DataFrame]:
    for columns in frames:
        out, held = [], 0
        for t, p, n in zip(*columns, strict=True):
            a = page(t.split("\n"), p, () if n is None else n) if t is not None else None
            out.append(images.gray(a) if a is not None else {"width": None, "height": None, "pixels": None})
            held += a.size if a is not None else 0
            if held > most:
                yield pd.DataFrame(out, columns=["width", "height", "pixels"])
                out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=["width", "height", "pixels"])


def detector(again: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """A detection model: dark pixels and what lies between the characters of a line are text; squares as high as a code are not. again: a map holds until the next call."""
    room = images.Room()

    def run(tensor: np.ndarray) -> np.ndarray:
        h, w = tensor.shape[2:]
        ink = np.less(tensor[0, 0], -0.5, out=room("ink", bool)(h, w))
        # Ink from four columns before to three after: doubled three times.
        near = room("near", bool)(h, w + 7)
        near[:, :4] = near[:, w + 4 :] = False
        near[:, 4 : w + 4] = ink
        for name, step in (("pairs", 1), ("fours", 2), ("eights", 4)):
            near = np.logical_or(near[:, :-step], near[:, step:], out=room(name, bool)(h, near.shape[1] - step))
        if (frame := framed(ink)) is not None:
            y, x, side = frame
            near[y : y + side, max(0, x - 8) : x + side + 8] = False
        out = room("map")(1, 1, h, w) if again else np.empty((1, 1, h, w), np.float32)
        out[0, 0] = near
        return out

    return run


def framed(ink: np.ndarray) -> tuple[int, int, int] | None:
    """y, x and side of the topmost square whose four sides are dark."""
    h = ink.shape[0]
    for y, x, end in zip(*(c.tolist() for c in maps.runs(ink, SIDE + 4)), strict=True):
        side = end - x
        if y + side <= h and ink[y : y + side, x].all() and ink[y : y + side, x + side - 1].all() and ink[y + side - 1, x : x + side].all():
            return y, x, side
    return None


def decoder() -> Callable[[np.ndarray], str | None]:
    """A decoding model: the text of the matrix code in an h x w x 3 array, or None."""

    def run(rgb: np.ndarray) -> str | None:
        ink = rgb[..., 0] < 128
        if (frame := framed(ink)) is None:
            return None
        y, x, side = frame
        centre = ((np.arange(SIDE) + 2.5) * side / (SIDE + 4)).astype(int)
        data = np.packbits(ink[np.ix_(y + centre, x + centre)]).tobytes()
        size = int.from_bytes(data[:2], "big")
        body = data[6 : 6 + size]
        return body.decode() if len(body) == size and zlib.crc32(body) == int.from_bytes(data[2:6], "big") else None

    return run


def _strip(tensor: np.ndarray, room: images.Room) -> np.ndarray | None:
    """The ink of a line's rows of bits, in compared cells, a blank cell at both ends; None without ink."""
    ink = np.subtract(1, tensor, out=room("ink")(*tensor.shape))
    ink *= 127.5
    ink[:, (tensor == 0).all(axis=0)] = 0
    ink = ink.astype(np.uint8)
    dark = np.flatnonzero(ink.max(axis=1, initial=0) > 127)
    if not len(dark):
        return None
    body = ink[dark[0] : dark[-1] + 1]
    small = images.resized(body, max(1, round(body.shape[1] * ROWS * CELL / body.shape[0])), ROWS * CELL)[CELL:-CELL]
    out = np.zeros((small.shape[0], small.shape[1] + 2 * CELL), np.float32)  # whole numbers of up to 2^24, so sums are exact
    out[:, CELL:-CELL] = small
    return out


def _windows(strip: np.ndarray, room: images.Room) -> np.ndarray:
    """The sums over the cells of every window of a strip that is as wide as a form, over the window's deviation: the product with a form of whole cells that has
    mean 0 and length 1 / CELL is the normalised cross-correlation. They hold until the next call."""
    width = (COLUMNS + 2 * GAP) * CELL
    tall = strip[::CELL] + strip[1::CELL] + strip[2::CELL]
    sums = tall[:, :-2] + tall[:, 1:-1] + tall[:, 2:]
    upto = np.zeros((2, strip.shape[1] + 1))
    np.cumsum([tall.sum(axis=0), np.einsum("ij,ij->j", strip, strip)], axis=1, out=upto[:, 1:])
    total, square = upto[:, width:] - upto[:, :-width]
    norm = np.maximum(np.sqrt(square - total * total / (len(strip) * width)), 1).astype(np.float32)
    out = room("windows")(len(tall), COLUMNS + 2 * GAP, len(norm))
    np.divide(np.lib.stride_tricks.sliding_window_view(sums, len(norm), axis=1)[:, ::CELL], norm, out=out)
    return out.reshape(-1, len(norm)).T


def reader(characters: Sequence[str] = ALPHABET, again: bool = False) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """What loads a recognition model of the characters: class 0 is no character, class k the k-th. again: scores hold until the next call."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        room = images.Room()
        forms = np.stack([np.pad(glyph(c), ((0, 0), (GAP, GAP)))[1:-1].reshape(-1) for c in characters]).astype(np.float32)
        forms -= forms.mean(axis=1, keepdims=True)
        forms /= np.linalg.norm(forms, axis=1, keepdims=True) * CELL

        def run(tensor: np.ndarray) -> np.ndarray:
            width = (COLUMNS + 2 * GAP) * CELL
            strips = [_strip(t, room) for t in tensor[:, 0]]
            steps = [s.shape[1] - width + 1 if s is not None and s.shape[1] >= width else 0 for s in strips]
            shape = len(strips), max(1, *steps, 1), len(characters) + 1
            out = room("scores")(*shape) if again else np.empty(shape, np.float32)
            out[..., 0] = BLANK
            for to, strip, n in zip(out, strips, steps, strict=True):
                if n:
                    np.matmul(_windows(strip, room), forms.T, out=to[:n, 1:])
                to[n:, 1:] = 0
            return out

        return run

    return load


def orienter() -> Callable[[np.ndarray], np.ndarray]:
    """An orientation model: a line stands on its head if its last row of cells has more ink than its first."""

    def run(tensor: np.ndarray) -> np.ndarray:
        out = np.zeros((len(tensor), 2), np.float32)
        for k, t in enumerate(tensor[:, 0]):
            dark = np.flatnonzero((t < 0).any(axis=1))
            if len(dark):
                ink, band = np.clip(1 - t, 0, 2), max(1, len(dark) // ROWS)
                first, last = ink[dark[0] : dark[0] + band].sum(), ink[dark[-1] - band + 1 : dark[-1] + 1].sum()
                out[k] = (0, 9) if last > first else (9, 0)
        return out

    return run
