"""Plug-in recognition: a model loaded once per Python worker and applied to batches, and the settings and files it needs."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

LOG = logging.getLogger("slipmill")


class NotConfigured(Exception):
    """Model files or a dictionary are missing."""


@dataclass(frozen=True)
class Settings:
    """Recognition settings; ``regions`` reads only the parts of landscape receipts that hold fields and can misassign fields."""

    detection_limit: int = 1280
    line_width: int = 640
    cell_threshold: float = 0.3
    component_mean: float = 0.5
    provider: str = "auto"
    threads: int = 4
    batched: bool = False
    regions: bool = False
    model_dir: str = ""

    def __post_init__(self):
        object.__setattr__(self, "threads", min(16, max(1, self.threads)))
        if self.provider not in ("auto", "cpu", "cuda", "directml"):
            raise ValueError(f"unknown provider {self.provider!r}")


def model_files(settings: Settings, model_dir: str | None = None) -> dict[str, Path | None]:
    """det, rec, cls and dictionary of the folder given, else of the settings. The latter two are optional."""
    folder = next((d for d in (model_dir, settings.model_dir) if d and d.strip()), None)
    if folder is None:
        raise NotConfigured("未指定模型目录: no model folder was given")
    files = {name: Path(folder, f"{name}.onnx").absolute() for name in ("det", "rec", "cls")}
    for name in ("det", "rec"):
        if not files[name].is_file():
            raise NotConfigured(f"missing model file {files[name]}")
    dictionary = sorted(Path(folder).glob("*.txt"))
    return files | {"cls": files["cls"] if files["cls"].is_file() else None, "dictionary": dictionary[0] if dictionary else None}


def dictionary(stated: str | None, lines: list[str] | None, leading_blank: bool = True) -> list[str]:
    """Characters by class: those stated in the model, else the file's non-blank lines, an empty entry before them if leading_blank."""
    if stated:
        return stated.split("\n")
    if lines is None:
        raise NotConfigured("neither the model nor a file gives a dictionary")
    return [""] * leading_blank + [x for x in lines if x.strip()]


def stated_characters(metadata: Callable[[], dict]) -> str | None:
    """The dictionary that a model's metadata state under ``character``; None if there are none or they cannot be read."""
    try:
        return metadata().get("character") or None
    except Exception:  # noqa: BLE001  a model without metadata has no dictionary
        return None


#: Models of this Python worker, by the content of what loads them.
_LOADED: dict[str, object] = {}


def cached(load: Callable[[], object]) -> Callable[[], object]:
    """load, run at most once in a Python worker for as long as Spark reuses it, however many tasks it serves."""
    key = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    def get() -> object:
        if key not in _LOADED:
            _LOADED[key] = load()
        return _LOADED[key]

    return get


def per_worker(load: Callable[[], object], apply: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A DataFrame operator. load runs once in each Python worker, where the model then stays; apply maps a batch of rows."""
    get = cached(load)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = get()
        for pdf in frames:
            yield apply(model, pdf)

    return lambda df: df.mapInPandas(run, schema)


BOXES = "doc_id string, line_no int, text string, confidence float, x float, y float, w float, h float"


def fixed_text(texts: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    """A recogniser that knows the text of each document, for tests: one box a document."""

    def apply(known: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(i, 0, known[i], 1.0, 0.0, 0.0, 1.0, 1.0) for i in pdf["doc_id"] if i in known]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in BOXES.split(", ")])

    return per_worker(lambda: texts, apply, BOXES)


def nothing(df: DataFrame) -> DataFrame:
    """A recogniser that finds no text."""
    return df.sparkSession.createDataFrame([], BOXES)
