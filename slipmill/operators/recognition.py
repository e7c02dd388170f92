"""Images to text boxes with plug-in models: detection, boxes in reading order, straightened lines, orientation, recognition.

A row is an image until its lines are straightened, then a line. Models are functions of arrays that ``engine.cached`` loads once in a Python worker. Score maps and
class scores do not leave the worker: boxes come out of detection, the run-length code of the best path out of recognition. Order, sizes, regions and decoding
are native columns. Nothing is shuffled. ``Settings.batched`` reads segments of lines in batches of like width over documents: each worker sorts those of the lines
it is given by width, POOL bytes at a time, and puts the lines together again.

Rows whose image is null or has no pixels have no boxes; ``pipeline.image_documents`` makes them error rows. ``Settings`` says how: detection_limit, line_width,
cell_threshold, component_mean, batched, regions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from slipmill.functions.dialect import settled
from slipmill.operators import geometry, images, lines, maps, sequences
from slipmill.operators.engine import Settings, cached

#: Size of an orientation model's input; confidence of lines that are read in batches; bytes that a worker holds before it hands rows on.
TURN_HEIGHT, TURN_WIDTH, BATCH_CONFIDENCE, HELD = 48, 192, 0.8, 4_000_000
#: Bytes of a batch that Spark sends to a worker; images are some 100 KB, and a worker holds several copies of a batch.
BATCH_BYTES = 4 << 20
#: Bytes of segments that a worker pools before it reads them, enough to fill buckets; bytes that a segment takes besides its pixels.
POOL, OBJECTS = 16_000_000, 1_000
_KEEP, _KEPT = ["doc_id", "line_no", "cx", "cy", "w", "h"], "doc_id string, line_no int, cx float, cy float, w float, h float"
_READ = f"{_KEPT}, paths array<array<int>>"
Frames = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_PLACED = "array<struct<w:double,h:double,a:int,cx:double,cy:double,x:double,y:double>>"


#: For inputs of models, which hold until a model's next call.
_ROOM = images.Room()


class _Segment(NamedTuple):
    """A part of a line: its width, the line's place in the pool, its pixels."""

    width: int
    row: int
    part: np.ndarray


def bounded(spark: SparkSession) -> None:
    """Lowers the session's spark.sql.execution.arrow.maxBytesPerBatch to BATCH_BYTES; a lower one stays. Only how rows are grouped on their way to workers depends on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.fullmatch(r"(-?\d+)([bkmg]?)b?", spark.conf.get(key).strip().lower()).groups()
    if not 0 < int(size) << 10 * "bkmg".index(unit or "b") <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _map(image: dict, model: Callable, limit: int) -> tuple[np.ndarray, float, float]:
    """The score map of an image, as large as the model's input, and the scales from it to the image."""
    tensor, x, y = images.detection_tensor(images.pixels(image), limit, empty=_ROOM("detection"))
    found = np.asarray(model(tensor[None]), np.float32)
    if found.ndim < 2:
        raise ValueError(f"a map of {found.ndim} dimensions")
    h, w = tensor.shape[1:]
    if found.shape[-2:] == (h, w):
        return found.reshape(-1, h, w)[0], x, y
    rows, cols = (np.minimum(np.arange(n) * size // n, size - 1) for n, size in ((h, found.shape[-2]), (w, found.shape[-1])))
    return found.reshape(-1, *found.shape[-2:])[0][rows][:, cols], x, y


def detected(pictures: DataFrame, load: Callable[[], Callable], settings: Settings = Settings()) -> DataFrame:
    """doc_id, image, h, w, scores, and scale_x and scale_y from map to image, for users of whole maps; recognise() does not need them. pictures: doc_id,
    image (gray); those without pixels are left out. load gives a function of a 1 x 3 x h x w tensor whose result's last two dimensions are the map."""
    get = cached(load)
    columns = ["doc_id", "image", "h", "w", "scores", "scale_x", "scale_y"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = get()
        for pdf in frames:
            out, held = [], 0
            for doc_id, image in zip(pdf["doc_id"], pdf["image"], strict=True):
                scores, x, y = _map(image, model, settings.detection_limit)
                out.append((doc_id, image, *scores.shape, scores.flatten(), x, y))  # a copy: models may use their maps again
                held += scores.nbytes
                if held > HELD:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns)

    some = pictures.select("doc_id", "image").where((F.length("image.pixels") > 0) & (F.col("image.width") > 0) & (F.col("image.height") > 0))
    return some.mapInPandas(run, f"doc_id string, image {images.GRAY}, h int, w int, scores array<float>, scale_x double, scale_y double")


def _in_order(found: DataFrame, settings: Settings, offset_x: float = 0.0, offset_y: float = 0.0) -> DataFrame:
    """quads of found (image, b: boxes in the map and scales, and other columns) instead of b."""
    rest = [c for c in found.columns if c != "b"]
    place = lambda p, b: F.struct(((p["x"] - offset_x) * b["x"]).alias("x"), ((p["y"] - offset_y) * b["y"]).alias("y"))
    quad = lambda b: F.transform(geometry.corners(b["cx"], b["cy"], b["w"] * maps.GROWTH, b["h"] * maps.GROWTH, F.radians(b["a"].cast("double"))), lambda p: place(p, b))
    out = found.select(*rest, F.transform("b", quad).alias("q"))
    if settings.regions:
        middle = lambda q: geometry.centre(q)
        out = out.withColumn("q", F.filter("q", lambda q: geometry.in_regions(middle(q)["x"], middle(q)["y"], F.col("image.width"), F.col("image.height"))))
    return out.select(*rest, F.transform(geometry.reading_order(F.col("q")), lambda i: F.get(F.col("q"), i)).alias("quads"))


def _kept(scores: np.ndarray, h: int, w: int, x: float, y: float, settings: Settings) -> list[dict]:
    found = maps.component_cells(scores, h, w, settings.cell_threshold)
    return [maps.least_box(c["cells"], w) | {"x": x, "y": y} for c in found if c["n"] >= maps.LEAST_CELLS and c["mean"] >= settings.component_mean]


def boxed(found: DataFrame, settings: Settings = Settings(), offset_x: float = 0.0, offset_y: float = 0.0) -> DataFrame:
    """doc_id, image and quads (in the image's pixels, in reading order) of detected()'s rows."""

    @F.pandas_udf(_PLACED)
    def boxes(scores: pd.Series, h: pd.Series, w: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_kept(np.asarray(s, np.float32), *rest, settings) for s, *rest in zip(scores, h, w, x, y, strict=True)])

    return _in_order(found.select("doc_id", "image", boxes("scores", "h", "w", "scale_x", "scale_y").alias("b")), settings, offset_x, offset_y)


def _finding(load: Callable[[], Callable], settings: Settings) -> Callable[[str], Column]:
    get = cached(load)

    @F.pandas_udf(_PLACED)
    def boxes(image: pd.DataFrame) -> pd.Series:
        out = []
        for i in image.to_dict("records"):
            if not images.has_pixels(i):
                out.append(None)
                continue
            scores, x, y = _map(i, get(), settings.detection_limit)
            out.append(_kept(scores.reshape(-1), *scores.shape, x, y, settings))
        return pd.Series(out, dtype=object)

    return boxes


def located(pictures: DataFrame, load: Callable[[], Callable], settings: Settings = Settings()) -> DataFrame:
    """boxed() of detected() in one call of the worker, which holds one map at a time and gives boxes; pictures without pixels have null quads."""
    return _in_order(pictures.select("doc_id", "image", _finding(load, settings)("image").alias("b")), settings)


def _places(boxes: DataFrame) -> DataFrame:
    """places (centre, sides and angle of every box of at least 2 x 2 pixels) of boxes (quads and other columns) instead of quads."""
    each = F.transform("quads", lambda q: F.struct(geometry.centre(q).alias("c"), geometry.size(q).alias("s"), geometry.angle(q).alias("a")))
    flat = F.transform(F.filter(each, lambda b: (b["s"]["w"] >= 2) & (b["s"]["h"] >= 2)), lambda b: F.array(b["c"]["x"], b["c"]["y"], b["s"]["w"], b["s"]["h"], b["a"]))
    return boxes.select(*(c for c in boxes.columns if c != "quads"), flat.alias("places"))


def _lines_of(image: dict, places: np.ndarray, turn: Callable | None) -> list[np.ndarray]:
    """The lines of an image, cut along their places; those that stand on their heads are turned."""
    a = images.pixels(image)
    parts = [images.turned_cut(a, cx, cy, int(w), int(h), angle) for cx, cy, w, h, angle in places]
    if turn and parts:
        scores = np.asarray(turn(images.stacked([images.resized(p, TURN_WIDTH, TURN_HEIGHT) for p in parts], TURN_HEIGHT, _ROOM("orientation"))), np.float64)
        parts = [p[::-1, ::-1] if sequences.turned(s) else p for p, s in zip(parts, scores, strict=True)]
    return parts


def _straightening(orient: Callable[[], Callable] | None) -> Frames:
    get = cached(orient) if orient else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out, held = [], 0
            for doc_id, image, places in zip(pdf["doc_id"], pdf["image"], pdf["places"], strict=True):
                if places is None or not len(places) or not images.has_pixels(image):
                    continue
                for k, (part, (cx, cy, w, h, _)) in enumerate(zip(_lines_of(image, places, get and get()), places, strict=True)):
                    out.append((doc_id, k, cx / image["width"], cy / image["height"], w / image["width"], h / image["height"], images.gray(part)))
                    held += part.size
                if held > HELD:
                    yield pd.DataFrame(out, columns=[*_KEEP, "line"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=[*_KEEP, "line"])

    return run


def straightened(boxes: DataFrame, orient: Callable[[], Callable] | None = None) -> DataFrame:
    """doc_id, line_no, cx, cy, w, h (in shares of the image) and line (a gray image) of every box of at least 2 x 2 pixels; the lines of an image are cut in
    one call. orient gives a function of an n x 3 x 48 x 192 tensor whose n x 2 scores say which lines stand on their heads; these are turned."""
    return _places(boxes).mapInPandas(_straightening(orient), f"{_KEPT}, line {images.GRAY}")


def _line_scores(model: Callable, a: np.ndarray, most: int) -> np.ndarray:
    return np.asarray(model(images.recognition_tensor(a, lines.HEIGHT, most, empty=_ROOM("line"))[None]), np.float32)[0]


def _reading(load: Callable[[], Callable], settings: Settings) -> Frames:
    get = cached(load)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = get()
        for pdf in frames:
            paths = [sequences.best_path(_line_scores(model, images.pixels(i), settings.line_width)) for i in pdf["line"]]
            yield pdf[_KEEP].assign(path=pd.Series(paths, pdf.index, dtype=object))  # an empty list would be a column of numbers

    return run


def read(straight: DataFrame, load: Callable[[], Callable], characters: list[str], settings: Settings = Settings()) -> DataFrame:
    """straightened()'s rows with text and confidence instead of line. load gives a function of an n x 3 x 48 x w tensor that returns n x steps x
    classes scores. Lines wider than line_width are squeezed to it; batched: they are cut in gaps between characters, segments of like width are
    read together whatever document of the worker's pool they come from, and the confidence is a constant."""
    if settings.batched:
        return _joined(straight.select(*_KEEP, "line").mapInPandas(_reading_together(load, settings.line_width, sequences.best_classes), _READ), characters)
    return _texts(straight.select(*_KEEP, "line").mapInPandas(_reading(load, settings), f"{_KEPT}, path {sequences.PATH}"), characters)


def _texts(rows: DataFrame, characters: list[str]) -> DataFrame:
    rows = rows.select(*_KEEP, sequences.decoded_path(F.col("path"), characters).alias("p"))
    return rows.select(*_KEEP, F.col("p.text").alias("text"), F.col("p.confidence").cast("float").alias("confidence"))


def _parts(a: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The segments of a line at the recognition height, each at most `most` wide."""
    scale = max(a.shape[0], 1) / lines.HEIGHT
    reach = a.shape[1] if round(a.shape[1] / scale) <= most else max(1, int(most * scale))
    start = 0
    for end in lines.segment_ends(a.shape[1], reach, lines.gap_centres(a)):
        part = a[:, start:end]
        yield images.resized(part, min(max(round(part.shape[1] / scale), 1), most), lines.HEIGHT)
        start = end


def _reading_together(load: Callable[[], Callable], most: int, best: Callable[[np.ndarray], list] = sequences.best_path) -> Frames:
    """Lines with what best makes of the scores of each of their segments."""
    get = cached(load)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = get()
        rows, pool, held = [], [], 0
        for pdf in frames:
            for row in pdf[[*_KEEP, "line"]].itertuples(index=False):
                for part in _parts(images.pixels(row.line), most):
                    pool.append(_Segment(part.shape[1], len(rows), part))
                    held += part.nbytes + OBJECTS
                rows.append(row[:-1])
                if held > POOL:
                    yield _read_pool(model, rows, pool, best)
                    rows, pool, held = [], [], 0
        yield _read_pool(model, rows, pool, best)

    return run


def _read_pool(model: Callable, rows: list[tuple], pool: list[_Segment], best: Callable[[np.ndarray], list]) -> pd.DataFrame:
    """rows with the best paths (or what else best gives) of their segments, in the order in which these stand in the pool."""
    return pd.DataFrame([(*row, p) for row, p in zip(rows, _pool_paths(model, len(rows), pool, best), strict=True)], columns=[*_KEEP, "paths"])


def _pool_paths(model: Callable, n: int, pool: list[_Segment], best: Callable[[np.ndarray], list] = sequences.best_path) -> list[list]:
    """The best paths, or another sum of the scores, of the segments of each of n lines."""
    paths: list = [None] * len(pool)
    order = sorted(range(len(pool)), key=lambda k: pool[k].width)
    at = iter(order)
    for bucket in lines.bucketed(pool[k] for k in order):
        scores = np.asarray(model(images.stacked([s.part for s in bucket], lines.HEIGHT, _ROOM("lines"))), np.float32)
        for _, s in zip(bucket, scores, strict=True):
            paths[next(at)] = best(s)
    of: list[list] = [[] for _ in range(n)]
    for segment, path in zip(pool, paths, strict=True):
        of[segment.row].append(path)
    return of


def _reading_images(load: Callable[[], Callable], orient: Callable[[], Callable] | None, settings: Settings) -> Frames:
    """Rows with lines (the classes that are read in each line's segments; null without pixels) instead of image and places. A batch of images (BATCH_BYTES) is a pool."""
    get, turn = cached(load), cached(orient) if orient else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = get()
        for pdf in frames:
            found, pool, n = [], [], 0
            for image, places in zip(pdf["image"], pdf["places"], strict=True):
                if not images.has_pixels(image):
                    found.append(None)
                    continue
                parts = _lines_of(image, places, turn and turn()) if places is not None else []
                if settings.batched:
                    pool += [_Segment(p.shape[1], n + k, p) for k, part in enumerate(parts) for p in _parts(part, settings.line_width)]
                    found.append(range(n, n + len(parts)))
                    n += len(parts)
                else:
                    found.append([[sequences.best_classes(_line_scores(model, part, settings.line_width))] for part in parts])
            if settings.batched:
                of = _pool_paths(model, n, pool, sequences.best_classes)
                found = [None if at is None else [of[k] for k in at] for at in found]
            yield pdf.drop(columns=["image", "places"]).assign(lines=pd.Series(found, pdf.index, dtype=object))

    return run


def _joined(rows: DataFrame, characters: list[str]) -> DataFrame:
    """Lines of _reading_together()'s rows of classes: the texts of a line's segments in order. The confidence is a constant, so no scores leave the worker."""
    return rows.select(*_KEEP, settled(sequences.spelled(F.flatten("paths"), characters)).alias("text"), F.lit(BATCH_CONFIDENCE).cast("float").alias("confidence"))


def recognise(pictures: DataFrame, detect: Callable[[], Callable], load: Callable[[], Callable], characters: list[str], orient: Callable[[], Callable] | None = None,
              settings: Settings = Settings()) -> DataFrame:
    """Boxes (doc_id, line_no, text, confidence, x, y, w, h; places in shares of the image) of pictures (doc_id, image): of all lines that hold text."""
    bounded(pictures.sparkSession)
    places, straight = _places(located(pictures, detect, settings)), _straightening(orient)
    # Lines are read where they are straightened: no third worker holds them.
    if settings.batched:
        together = _reading_together(load, settings.line_width, sequences.best_classes)
        read_ = _joined(places.mapInPandas(lambda frames: together(straight(frames)), _READ), characters)
    else:
        reading = _reading(load, settings)
        read_ = _texts(places.mapInPandas(lambda frames: reading(straight(frames)), f"{_KEPT}, path {sequences.PATH}"), characters)
    return read_.where(F.length("text") > 0).select("doc_id", "line_no", "text", "confidence", F.col("cx").alias("x"), F.col("cy").alias("y"), "w", "h")


def recogniser(*models, **how) -> Callable[[DataFrame], DataFrame]:
    """recognise() with everything but the pictures, for ``pipeline.image_documents``."""
    return lambda pictures: recognise(pictures, *models, **how)


def read_images(pictures: DataFrame, detect: Callable[[], Callable], load: Callable[[], Callable], characters: list[str], orient: Callable[[], Callable] | None = None,
                decode: Callable[[], Callable] | None = None, settings: Settings = Settings()) -> DataFrame:
    """recognise() and, with decode, codes() in one pass: the columns of pictures but the image, texts (of the lines that hold text, in reading order; null without
    pixels) and raw. Each image is made and moved once, a row stays a row, and nothing is joined or shuffled."""
    bounded(pictures.sparkSession)
    rest = [c for c in pictures.columns if c != "image"]
    raw = [_decoding(decode)("image", images.code_regions(F.col("image.width"), F.col("image.height"))).alias("raw")] if decode else []
    places = _places(_in_order(pictures.select(*rest, "image", *raw, _finding(detect, settings)("image").alias("b")), settings))
    kept = StructType([f for f in places.schema.fields if f.name not in ("image", "places")]).add("lines", ArrayType(ArrayType(ArrayType(IntegerType()))))
    read_ = places.mapInPandas(_reading_images(load, orient, settings), kept)
    text = lambda line: sequences.spelled(F.flatten(line), characters)
    return read_.withColumn("texts", settled(F.filter(F.transform("lines", text), lambda t: F.length(t) > 0))).drop("lines")


def page_reader(*models, **how) -> Callable[[DataFrame], DataFrame]:
    """read_images() with everything but the pictures, for ``pipeline.read_documents``."""
    return lambda pictures: read_images(pictures, *models, **how)


def _decoding(load: Callable[[], Callable]) -> Callable[..., Column]:
    get = cached(load)

    @F.pandas_udf("string")
    def decode(image: pd.DataFrame, regions: pd.Series) -> pd.Series:
        return pd.Series([_decoded(get(), i, r) for i, r in zip(image.to_dict("records"), regions, strict=True)], dtype=object)

    return decode


def codes(pictures: DataFrame, load: Callable[[], Callable]) -> DataFrame:
    """doc_id and raw (null: no code) of pictures (doc_id, image). load gives a function of an h x w x 3 array that returns a text or None. The
    regions where codes stand are tried in order, then the whole image; blank texts count as none; a fault of the decoder is no code."""
    bounded(pictures.sparkSession)
    return pictures.select("doc_id", _decoding(load)("image", images.code_regions(F.col("image.width"), F.col("image.height"))).alias("raw"))


def _decoded(model: Callable, image: dict, regions: list) -> str | None:
    if not images.has_pixels(image):
        return None
    a = images.pixels(image)
    for part in (*(images.part_of(a, *(int(r[c]) for c in "xywh")) for r in regions), a):  # a null in a batch makes pandas' numbers floats
        try:
            text = model(images.luminance(part))
        except Exception:  # noqa: BLE001  a decoder's fault must not stop the documents
            return None
        if text and text.strip():
            return text
    return None
