"""Texts of many rows put together in order, in a stream: rows are dealt out by key and sorted in their partitions, a task holds the text of one key."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of finished texts that a task holds before it hands them on.
HELD = 16_000_000


def joined(rows: DataFrame, key: str, order: list[Column], text: Column, separator: str, name: str = "text") -> DataFrame:
    """key and name: the non-null texts of each key's rows, in order, with a separator between them; the empty text for a key without any. Rows of a null key
    belong together. A key's rows are never gathered: what grows is its text alone."""
    dealt = rows.select(F.col(key).alias("key"), text.alias("text"), *(o.alias(f"o{k}") for k, o in enumerate(order))).repartition("key")
    kind = rows.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, `{name}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, some, buffer, done, held = None, False, None, [], 0

        def rows_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], arrow), pa.array([t for _, t in done], pa.string())], names=[key, name])

        arrow = None
        for batch in batches:
            arrow = batch.column(0).type
            runs = pc.run_end_encode(batch.column(0))
            start = 0
            for k, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if buffer is None or k != current:
                    if buffer is not None:
                        done.append((current, buffer.getvalue()))
                        held += buffer.tell()
                        if held > HELD:
                            yield rows_of()
                            done, held = [], 0
                    current, some, buffer = k, False, io.StringIO()
                parts = batch.column(1).slice(start, end - start).drop_null().to_pylist()
                if parts:
                    buffer.write(separator * some + separator.join(parts))
                    some = True
                start = end
        if buffer is not None:
            done.append((current, buffer.getvalue()))
            yield rows_of()

    return dealt.sortWithinPartitions("key", *(f"o{k}" for k in range(len(order))), "text").select("key", "text").mapInArrow(run, schema)
