"""Tables of encoded columns: a row per block of rows, a struct per column.

A scan reads the payloads of the columns it needs, skips blocks by their bounds, which the
Parquet reader does as well, and decodes and filters a block at once: rows outside the ranges
never leave the decoder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models as M

I, U = np.int64, np.uint64
COLUMN = "struct<model:string,params:array<double>,base:bigint,bits:int,vmin:bigint,vmax:bigint,payload:binary>"
_ARROW = pa.struct([("model", pa.string()), ("params", pa.list_(pa.float64())), ("base", pa.int64()), ("bits", pa.int32()),
                    ("vmin", pa.int64()), ("vmax", pa.int64()), ("payload", pa.binary())])


def encode_table(df: DataFrame, columns: list[str], order: list[str], size: int = 4096, model: str | None = None) -> DataFrame:
    """Blocks of integer columns in the given order of rows: dealt out by range, sorted within
    tasks, cut into ``size`` rows. ``model`` forces one model for every column; otherwise the
    cheapest up to a cubic is taken per block and column. Nulls raise an error."""
    rows = df.select(*(F.col(c).cast("long").alias(c) for c in columns))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def block(rows: pa.Table) -> pa.RecordBatch:
        cells = []
        for c in columns:
            if rows.column(c).null_count:
                raise ValueError(f"{c} holds a null")
            v = rows.column(c).to_numpy()
            b = M.encode_as(v.view(U), model, False) if model else M.encode_best(v.view(U), False, 3)
            cells.append({"model": b.model, "params": list(b.params), "base": b.base, "bits": b.bits,
                          "vmin": int(v.min()), "vmax": int(v.max()), "payload": b.payload})
        return pa.RecordBatch.from_arrays(
            [pa.array([rows.num_rows], pa.int64()), *(pa.array([x], _ARROW) for x in cells)], ["n", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while n + batch.num_rows - at >= size:
                yield block(pa.Table.from_batches([*held, batch.slice(at, size - n)]))
                at += size - n
                held, n = [], 0
            if at < batch.num_rows:
                held.append(batch.slice(at))
                n += batch.num_rows - at
        if n:
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(run, ", ".join(["n long", *(f"`{c}` {COLUMN}" for c in columns)]))


def blocks_where(blocks: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Blocks that can hold rows whose columns all lie in their ranges [low, high]."""
    for c, (low, high) in ranges.items():
        blocks = blocks.filter((F.col(f"{c}.vmax") >= low) & (F.col(f"{c}.vmin") <= high))
    return blocks


def scan(blocks: DataFrame, columns: list[str], ranges: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The rows of some columns, of rows within all ``ranges`` if given. A block's filter
    columns are decoded first, the others only if rows are left."""
    ranges = ranges or {}
    needed = list(dict.fromkeys([*ranges, *columns]))
    parts = ("model", "params", "base", "bits", "payload")
    cells = blocks_where(blocks, ranges).select(
        "n", *(F.struct(*(F.col(f"{c}.{p}").alias(p) for p in parts)).alias(c) for c in needed))

    def column(cell: dict, n: int) -> np.ndarray:
        return M.decode(cell["model"], tuple(cell["params"]), cell["base"], cell["bits"], cell["payload"], n).view(I)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, held = row["n"], {}
                kept = np.ones(n, dtype=bool)
                for c, (low, high) in ranges.items():
                    held[c] = column(row[c], n)
                    kept &= (held[c] >= low) & (held[c] <= high)
                    if not kept.any():
                        break
                if kept.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((held[c] if c in held else column(row[c], n))[kept]) for c in columns], columns)

    return cells.mapInArrow(run, ", ".join(f"`{c}` long" for c in columns))


def sizes(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """Per column its bytes as 32-bit values, as payloads, and the models taken."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("cell"), "n") for c in columns))).alias("x")
    rows = blocks.select(each)
    return rows.groupBy(F.col("x.name").alias("name")).agg(
        F.sum("x.n").alias("n_rows"), F.sum(F.col("x.n") * 4).alias("raw_bytes"),
        F.sum(F.octet_length("x.cell.payload") + 16).cast("long").alias("packed_bytes"),
        F.sort_array(F.collect_set("x.cell.model")).alias("models"))
