"""Columns computed from whole texts, many documents at a time (Arrow in, Arrow out, no per-row Python objects)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tempora.llm._shared import beside, plain, ship

#: Bytes of text handled at once; one longer document is handled alone.
PACK_BYTES = 2 << 20
_LIBC = ctypes.CDLL(None)


def rest() -> None:
    """Give freed memory back to the system: workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def packs(data: np.ndarray, offsets: np.ndarray, most: int = PACK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, buffer, starts): rows first..last-1 laid end to end with a space after each; starts has one more entry."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        starts = offsets[i : j + 1] - offsets[i] + np.arange(j - i + 1)
        buf = np.full(int(starts[-1]), 32, np.uint8)
        for k in range(i, j):
            buf[starts[k - i] : starts[k - i + 1] - 1] = data[offsets[k] : offsets[k + 1]]
        yield i, j, buf, starts
        i = j


def append(df: DataFrame, text_col: str, fields: str, make: Callable[[], Callable], also: tuple[str, ...] = (), drop_text: bool = False) -> DataFrame:
    """df with further columns, given as DDL, which make()(buffer, starts, rows) computes for each pack of texts.

    make runs once in each task, so that models and indexes are unpacked there; rows has the pack's `also` columns.  A column of df that
    has the name of an added one stays under that name with _input.
    """
    ship(df.sparkSession)
    names, inner = df.columns, plain(df)
    added = _parse_datatype_string(f"struct<{fields}>")
    inside = StructType([StructField(f"a{k}", f.dataType) for k, f in enumerate(added)])
    text = f"c{names.index(text_col)}"
    inner = inner.withColumn(text, F.col(text).cast("string"))
    kept = [k for k, c in enumerate(names) if not (drop_text and c == text_col)]
    full = StructType([inner.schema[k] for k in kept] + inside.fields)
    arrow = to_arrow_schema(inside)
    asked = {c: names.index(c) for c in also}

    def run(batches):
        f = make()
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text))
            data, offsets = views(col)
            keep = [batch.column(k) for k in kept]
            rows = {c: batch.column(k) for c, k in asked.items()}
            for i, j, buf, starts in packs(data, offsets):
                got = f(buf, starts, {c: v.slice(i, j - i) for c, v in rows.items()})
                new = [x if isinstance(x, pa.Array) else pa.array(x, type=t.type) for x, t in zip(got, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*[k.slice(i, j - i) for k in keep], *new], names=full.names)
            del batch, col, data, offsets, keep, rows
            rest()

    return inner.mapInArrow(run, full).toDF(*beside([names[k] for k in kept], added.names), *added.names)
