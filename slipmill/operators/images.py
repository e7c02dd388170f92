"""Gray images (struct of width, height and pixels, one byte each in raster order): scaling, turning, cutting, tensors.

Images are rows; every step is a column function or a small NumPy kernel over one image, so nothing is shuffled.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAY = "struct<width:int,height:int,pixels:binary>"
_GRAY = T.StructType().add("width", T.IntegerType()).add("height", T.IntegerType()).add("pixels", T.BinaryType())
#: Mean and deviation of the three channels of detection input.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


class Room:
    """Arrays of a worker by name, used again for one image after another: the memory of a new large array takes longer to come by than the sums in it. What room(name)(shape)
    gives, with any contents, holds until that name is asked for again."""

    def __init__(self):
        self._held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, kind: type = np.float32) -> Callable[..., np.ndarray]:
        def empty(*shape: int) -> np.ndarray:
            size = math.prod(shape)
            if name not in self._held or len(self._held[name]) < size:
                self._held[name] = np.empty(size, kind)
            return self._held[name][:size].reshape(shape)

        return empty


#: For what does not leave the functions of this module.
_ROOM = Room()
Empty = Callable[..., np.ndarray]


def _new(*shape: int) -> np.ndarray:
    return np.empty(shape, np.float32)


@functools.lru_cache(128)
def _taps(size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """For each of n places: the two pixels of size that count, their weights and the weights' sum (None: always 1). Pixels further off have no weight."""
    centre = (np.arange(n, dtype=np.float32) + np.float32(0.5)) * np.float32(size / n) - np.float32(0.5)
    low = np.floor(centre).astype(np.int64)
    first, second = (np.maximum(np.float32(0), np.float32(1) - np.abs(centre - (low + k).astype(np.float32))) for k in range(2))
    mass = first + second
    return np.clip(low, 0, size - 1), np.clip(low + 1, 0, size - 1), first, second, None if (mass == 1).all() else mass


def scaled(a: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Bytes of a, n long along an axis: weights fall linearly to 0 one pixel from the mapped centre, edges repeat, fractions are cut."""
    size = a.shape[axis]
    if n == size:
        return a
    low, high, *weights = _taps(size, n)
    first, second, mass = (w if w is None or axis else w[:, None] for w in weights)
    shape = (a.shape[0], n) if axis else (n, a.shape[1])
    taken, total, term = _ROOM("taken", np.uint8)(*shape), _ROOM("total")(*shape), _ROOM("term")(*shape)
    for at, weight, out in ((low, first, total), (high, second, term)):
        out[:] = a.take(at, axis=axis, out=taken, mode="clip")
        out *= weight
    total += term
    if mass is not None:
        total /= mass
    return total.astype(np.uint8)


def resized(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Columns first, then rows of the cut result."""
    if width <= 0 or height <= 0:
        raise ValueError(f"size {width} x {height}")
    return scaled(scaled(a, width, 1), height, 0)


def turned_cut(a: np.ndarray, cx: float, cy: float, width: int, height: int, angle: float) -> np.ndarray:
    """width x height pixels around a centre, read along axes turned by minus the angle; bilinear, 0 outside."""
    width, height = max(width, 1), max(height, 1)
    f = np.float32
    x, y = np.meshgrid(np.arange(width, dtype=f) - f(width / 2), np.arange(height, dtype=f) - f(height / 2), sparse=True)
    c, s = f(np.cos(f(angle))), f(np.sin(f(angle)))
    h, w = a.shape
    if s == 0 and c == 1:
        return _level_cut(a, f(cx) + x[0], f(cy) + y[:, 0])
    sx, sy = f(cx) + x * c + y * s, f(cy) - x * s + y * c
    inside = (sx >= 0) & (sy >= 0) & (sx <= w - 1) & (sy <= h - 1)
    x0, y0 = np.where(inside, sx, 0).astype(int), np.where(inside, sy, 0).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    dx, dy, p = sx - x0, sy - y0, a.astype(f)
    value = p[y0, x0] * (1 - dx) * (1 - dy) + p[y0, x1] * dx * (1 - dy) + p[y1, x0] * (1 - dx) * dy + p[y1, x1] * dx * dy
    return np.where(inside, value, 0).astype(np.uint8)


def _level_cut(a: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """turned_cut() along the image's own axes: places are those of a column and of a row, so only rows and columns are weighed."""
    h, w = a.shape
    out = np.zeros((len(sy), len(sx)), np.uint8)
    across, down = np.flatnonzero((sx >= 0) & (sx <= w - 1)), np.flatnonzero((sy >= 0) & (sy <= h - 1))
    if not len(across) or not len(down):
        return out
    sx, sy = sx[across], sy[down]
    x0, y0 = sx.astype(int), sy.astype(int)
    dx, dy = sx - x0, (sy - y0)[:, None]
    upper, lower, x1 = a[y0], a[np.minimum(y0 + 1, h - 1)], np.minimum(x0 + 1, w - 1)
    # Shares that are whole 256ths leave nothing to round in single precision.
    exact = all((d * 256 % 1 == 0).all() for d in (dx, dy))
    kind, names = (np.float32, ("value", "share")) if exact else (np.float64, ("value64", "share64"))
    dx, dy = dx.astype(kind), dy.astype(kind)
    value, term = (_ROOM(name, kind)(len(down), len(across)) for name in names)
    value[:] = 0
    for row, column, by_x, by_y in ((upper, x0, 1 - dx, 1 - dy), (upper, x1, dx, 1 - dy), (lower, x0, 1 - dx, dy), (lower, x1, dx, dy)):
        if by_x.any() and by_y.any():
            term[:] = row.take(column, axis=1)
            term *= by_x
            term *= by_y
            value += term
    out[down[0] : down[-1] + 1, across[0] : across[-1] + 1] = value
    return out


def normalised(a: np.ndarray, width: int, height: int, mean: tuple = (0.5,) * 3, deviation: tuple = (0.5,) * 3, empty: Empty = _new) -> np.ndarray:
    """A 3 x height x width tensor with the image in its upper left corner, zeros elsewhere. Equal channels are one that is seen three times (read-only). empty: gives the
    array that the tensor is written to."""
    kinds = list(zip(mean, deviation, strict=True))
    out = empty(1 if len(set(kinds)) == 1 else 3, height, width)
    a = a[:height, :width]
    h, w = a.shape
    out[:, h:] = 0
    out[:, :h, w:] = 0
    part = _ROOM("part")(h, w)
    part[:] = a
    part /= np.float32(255)
    for to, (m, d) in zip(out, kinds):
        np.subtract(part, np.float32(m), out=to[:h, :w])
        to[:h, :w] /= np.float32(d)
    return out if len(out) == 3 else np.broadcast_to(out, (3, height, width))


def stacked(images: list[np.ndarray], height: int, empty: Empty = _new) -> np.ndarray:
    """Tensors of lines of one height, padded to the widest, its width rounded up to 8; equal channels and empty as in normalised()."""
    width = -(-max(i.shape[1] for i in images) // 8) * 8
    out = empty(len(images), 1, height, width)
    for to, i in zip(out, images, strict=True):
        normalised(i, width, height, empty=lambda *_, to=to: to)
    return np.broadcast_to(out, (len(images), 3, height, width))


def detection_tensor(a: np.ndarray, limit: int, fixed: tuple[int, int] | None = None, empty: Empty = _new) -> tuple[np.ndarray, float, float]:
    """A 3 x h x w tensor of an image, and the scales from it to the image (x, y): shrunk so that its longer side is at most limit, never grown; padded to
    multiples of 32, or cut and padded to fixed (h, w)."""
    h, w = a.shape
    ratio = limit / max(h, w) if max(h, w) > limit else 1.0
    nw, nh = max(round(w * ratio), 1), max(round(h * ratio), 1)
    if fixed:
        nh, nw = min(nh, fixed[0]), min(nw, fixed[1])
    ph, pw = fixed or (-(-nh // 32) * 32, -(-nw // 32) * 32)
    return normalised(resized(a, nw, nh), pw, ph, MEAN, DEVIATION, empty), w / nw, h / nh


def recognition_tensor(a: np.ndarray, height: int, most: int, fixed: bool = False, empty: Empty = _new) -> np.ndarray:
    """A 3 x height x w tensor of a line: as wide as its height asks for, at most most; padded to a multiple of 8, or to most if fixed."""
    width = min(max(round(a.shape[1] / (max(a.shape[0], 1) / height)), 1), most)
    return normalised(resized(a, width, height), most if fixed else -(-width // 8) * 8, height, empty=empty)


def orientation_tensor(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """A 3 x height x width tensor of a line, stretched."""
    return normalised(resized(a, width, height), width, height)


def luminance(a: np.ndarray) -> np.ndarray:
    """An h x w x 3 array whose channels are equal, as decoders of codes take it."""
    return np.repeat(a[:, :, None], 3, axis=2)


def part_of(a: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A part of an image, limited to the image; an empty part is the whole image."""
    part = a[y : y + h, x : min(x + w, a.shape[1])] if x >= 0 and y >= 0 and w > 0 and h > 0 else a[:0]
    return part if part.size else a


def pixels(image: dict) -> np.ndarray:
    return np.frombuffer(image["pixels"], np.uint8).reshape(int(image["height"]), int(image["width"]))


def has_pixels(image: dict | None) -> bool:
    """Whether a row of an image column (as pandas gives it, nulls as they come) is an image of at least one pixel."""
    return image is not None and isinstance(image["pixels"], bytes | bytearray) and len(image["pixels"]) > 0


def gray(a: np.ndarray) -> dict:
    return {"width": a.shape[1], "height": a.shape[0], "pixels": a.tobytes()}


def per_image(change: Callable[[np.ndarray, tuple], np.ndarray]) -> Callable[..., Column]:
    """A column function (image, *parameters) -> image from a NumPy function of one image's pixels and its row's parameters; rows without pixels stay without."""
    none = {"width": None, "height": None, "pixels": None}

    @F.pandas_udf(_GRAY)
    def run(image: pd.DataFrame, parameters: pd.DataFrame) -> pd.DataFrame:
        rows = zip(image.to_dict("records"), parameters.itertuples(index=False), strict=True)
        return pd.DataFrame([gray(change(pixels(i), tuple(p))) if has_pixels(i) else none for i, p in rows], columns=["width", "height", "pixels"])

    return lambda image, *parameters: run(image, F.struct(*(p.alias(f"p{k}") for k, p in enumerate(parameters))))


resize = per_image(lambda a, p: resized(a, int(p[0]), int(p[1])))
rotated_crop = per_image(lambda a, p: turned_cut(a, float(p[0]), float(p[1]), int(p[2]), int(p[3]), float(p[4])))


_half_turn = per_image(lambda a, p: a[::-1, ::-1])
_turned_if = per_image(lambda a, p: a[::-1, ::-1] if p[0] else a)
_cut = per_image(lambda a, p: part_of(a, *map(int, p)))


def half_turn(image: Column) -> Column:
    """Turned by 180 degrees."""
    return _half_turn(image, F.lit(0))


def turned_if(image: Column, flag: Column) -> Column:
    """Turned by 180 degrees where flag holds."""
    return _turned_if(image, flag)


def cut(image: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """A part of an image, limited to the image; an empty part is the whole image."""
    return _cut(image, x, y, w, h)


def code_regions(width: Column, height: Column) -> Column:
    """Where codes are looked for, in order: upper right, then upper left. A region wider than the image starts left of it, so
    for such an image nothing is found."""
    rw, rh = F.greatest(F.lit(64), F.ceil(width * 0.5)).cast("int"), F.greatest(F.lit(64), F.ceil(height * 0.35)).cast("int")
    region = lambda x: F.struct(x.cast("int").alias("x"), F.lit(0).alias("y"), rw.alias("w"), rh.alias("h"))
    return F.array(region(width - rw), region(F.lit(0)))
