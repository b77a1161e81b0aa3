"""Arrow batches by groups of rows, for operators that run inside mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def batch_of(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names.split())


def grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows with the same first values, which follow one another; single rows are left out."""
    held, pieces = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in range(columns)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if held is None or tuple(keys[a]) != held:
                if sum(p.num_rows for p in pieces) > 1:
                    yield held, pa.Table.from_batches(pieces)
                held, pieces = tuple(keys[a]), []
            pieces.append(batch.slice(a, z - a))
    if sum(p.num_rows for p in pieces) > 1:
        yield held, pa.Table.from_batches(pieces)


def gathered(columns: Iterator[list], names: str, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Many short columns as few batches."""
    held, rows = [], 0
    for own in columns:
        held.append(own)
        rows += len(own[0])
        if rows > most:
            yield batch_of(names, *map(np.concatenate, zip(*held)))
            held, rows = [], 0
    if rows:
        yield batch_of(names, *map(np.concatenate, zip(*held)))
