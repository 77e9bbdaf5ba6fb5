"""Helpers for functions that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least_rows: int = 1, least_bytes: int = 1 << 62) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by a key without nulls.

    A table has least_rows rows or least_bytes bytes at least (the last may be smaller) and as much of the input as it
    takes to end a group, so memory is bounded by those and one group.
    """
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and (rows >= least_rows or size >= least_bytes):
            last = held[-1].column(key)[-1].as_py()
            cut = int(np.argmax(keys != last)) if (keys != last).any() else None
            if cut is not None:
                head = [batch.slice(0, cut)] if cut else []
                yield pa.Table.from_batches([*held, *head])
                batch, held, rows, size = batch.slice(cut), [], 0, 0
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def numpy_columns(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() if isinstance(table, pa.Table) else table.column(n).to_numpy(zero_copy_only=False) for n in names]


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary array without nulls, and the offsets of its values."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
