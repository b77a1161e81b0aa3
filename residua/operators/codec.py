"""The lossless column codec: a column becomes blocks, one row per partition, and back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import models as M

U, I = np.uint64, np.int64
SIGNED = ("int", "bigint", "smallint", "tinyint")
UNSIGNED = "decimal(20,0)"
BLOCKS = (
    "pid long, start long, end long, model string, params array<double>, base long, bits int, "
    "error_bound decimal(20,0), vmin decimal(20,0), vmax decimal(20,0), payload binary"
)
#: Positions whose partitions are looked for together, by the strategies that place them.
STRETCH = 65536


@dataclass(frozen=True)
class Config:
    """How to encode. ``strategy`` is FIXED, VARIANCE, VARIANCE_COST, COST_OPTIMAL or GREEDY; ``model`` forces
    one model instead of choosing by size; ``degree`` is the highest polynomial to try."""

    strategy: str = "COST_OPTIMAL"
    size: int = 2048
    least: int = 256
    most: int = 8192
    threshold: int = 2
    benefit: float = 0.05
    rounds: int = 4
    degree: int = 1
    model: str | None = None

    @classmethod
    def fixed(cls, size: int = 2048) -> Config:
        return cls(strategy="FIXED", size=size)

    @classmethod
    def high_compression(cls) -> Config:
        return cls(degree=3, least=128, benefit=0.01, rounds=8)

    @classmethod
    def high_throughput(cls) -> Config:
        return cls(strategy="FIXED", size=4096)

    @classmethod
    def variance_adaptive(cls) -> Config:
        return cls(strategy="VARIANCE")

    @classmethod
    def cost_optimal(cls) -> Config:
        return cls()

    def cuts(self, values: np.ndarray) -> list[tuple[int, int]]:
        """Partitions of one stretch. Where a strategy finds none, fixed ones serve."""
        if self.strategy == "VARIANCE":
            found = M.variance_sizes(values, self.size, least=self.least)
        elif self.strategy == "VARIANCE_COST":
            found = M.variance_cost(values, self.size, self.least)
        elif self.strategy == "COST_OPTIMAL":
            found = M.cost_optimal(values, self.least, self.most, self.threshold, self.benefit, self.rounds)
        elif self.strategy == "GREEDY":
            found = M.greedy(values, self.least, self.most)
        elif self.strategy == "FIXED":
            found = []
        else:
            raise ValueError(f"no strategy {self.strategy}")
        return found or [(a, min(a + self.size, len(values))) for a in range(0, len(values), self.size)]


def _patterns(column: pa.Array, unsigned: bool) -> np.ndarray:
    if unsigned:
        return np.array([int(v) for v in column.to_pylist()], dtype=U)
    return column.to_numpy(zero_copy_only=False).astype(I).view(U)


def _stretches(batches: Iterator[pa.RecordBatch], unsigned: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(stretch, positions, patterns) of rows sorted by stretch and position."""
    held, pos, val = None, [], []
    for batch in batches:
        ids = batch.column(0).to_numpy()
        p, v = batch.column(1).to_numpy(), _patterns(batch.column(2), unsigned)
        edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for a, z in zip(edges, edges[1:]):
            if z > a:
                if held is not None and ids[a] != held:
                    yield held, np.concatenate(pos), np.concatenate(val)
                    pos, val = [], []
                held = int(ids[a])
                pos.append(p[a:z]), val.append(v[a:z])
    if held is not None:
        yield held, np.concatenate(pos), np.concatenate(val)


def _dense(df: DataFrame, pos: str, first: int) -> None:
    """Raise an error unless the positions can be first, first + 1 and so on: from their
    number, least and greatest. Which are there twice shows when a stretch is encoded."""
    n, low, high = df.agg(F.count(F.lit(1)), F.min(pos), F.max(pos)).first()
    if n and (low != first or high - low + 1 != n):
        raise ValueError(f"{n} positions from {low} to {high} have gaps or repeats, or do not begin at {first}")


def _relative(ordered: np.ndarray) -> np.ndarray:
    """Distances from the least value, as signed numbers, for the search of partitions; where
    they reach 2^63, halves of them. What is encoded are the values themselves."""
    apart = ordered.view(U) - ordered.min().view(U)
    return (apart >> U(1) if apart.max() >= 1 << 63 else apart).view(I)


def encode(df: DataFrame, pos: str, value: str, config: Config = Config(), first: int = 0) -> DataFrame:
    """Blocks of a column. Values are integers or DECIMAL(20,0) below 2^64, over their whole
    range. Positions go from ``first`` on without gaps or repeats; others raise an error, and
    so do nulls. An empty column has no blocks.

    The extremes of the positions are looked up at once. Rows then shuffle once, by stretch of
    positions, and are encoded as they stream by, a stretch in memory at a time."""
    _dense(df, pos, first)
    kind = df.schema[value].dataType.simpleString()
    if kind not in (*SIGNED, UNSIGNED):
        raise TypeError(f"{value} is {kind}; the codec takes integers or {UNSIGNED}")
    unsigned = kind == UNSIGNED
    width = config.size if config.strategy == "FIXED" else STRETCH
    width = max(width, STRETCH // width * width)
    clean = F.when(F.col(value).isNull(), F.raise_error(F.lit(f"{value} holds a null"))).otherwise(
        F.col(value) if unsigned else F.col(value).cast("long"))
    rows = df.select(
        F.expr(f"{pos} div {width}").alias("stretch"), F.col(pos).cast("long").alias("pos"), clean.alias("value"))
    rows = rows.repartition("stretch").sortWithinPartitions("stretch", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: Decimal(int(x))
        for stretch, p, v in _stretches(batches, unsigned):
            if int(p[-1] - p[0]) + 1 != len(p) or len(np.unique(p)) != len(p):
                raise ValueError(f"positions {p[0]} to {p[-1]} have gaps or repeats")
            ordered = v if unsigned else v.view(I)
            out = []
            for k, (a, z) in enumerate(config.cuts(_relative(ordered))):
                b = (M.encode_as(v[a:z], config.model, unsigned) if config.model
                     else M.encode_best(v[a:z], unsigned, config.degree))
                own = ordered[a:z]
                out.append((stretch * STRETCH + k, int(p[0]) + a, int(p[0]) + z, b.model, list(b.params), b.base,
                            b.bits, number(b.error), number(own.min()), number(own.max()), b.payload))
            dec = pa.decimal128(20, 0)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int64(),
                     pa.int32(), dec, dec, dec, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             [c.split()[0] for c in BLOCKS.split(", ")])

    return rows.mapInArrow(run, BLOCKS)


def decode(blocks: DataFrame, kind: str = "bigint", pos: str = "pos", value: str = "value") -> DataFrame:
    """The column again: ``pos`` and ``value`` of the given type."""
    unsigned = kind == UNSIGNED
    schema = T.StructType([T.StructField(pos, T.LongType()), T.StructField(
        value, T.DecimalType(20, 0) if unsigned else T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = r["end"] - r["start"]
                v = M.decode(r["model"], tuple(r["params"]), r["base"], r["bits"], r["payload"], n)
                values = pa.array([Decimal(int(x)) for x in v], pa.decimal128(20, 0)) if unsigned else pa.array(v.view(I))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(r["start"], r["end"])), values], [pos, value])

    needed = blocks.select("start", "end", "model", "params", "base", "bits", "payload")
    out = needed.mapInArrow(run, schema)
    return out.withColumn(value, F.col(value).cast(kind)) if kind not in ("bigint", UNSIGNED) else out


def decode_where(blocks: DataFrame, low: object, high: object, kind: str = "bigint") -> DataFrame:
    """Positions and values in [low, high]. Only blocks whose bounds allow such values are
    decoded; of blocks in Parquet the reader skips the others."""
    from .partition import candidates

    return decode(candidates(blocks, low, high), kind).filter(F.col("value").between(low, high))


def decode_blocks(blocks: DataFrame, wanted: DataFrame, **options: str) -> DataFrame:
    """Only the blocks whose numbers are wanted."""
    return decode(blocks.join(wanted.select("pid").distinct(), "pid", "left_semi"), **options)


#: Positions whose blocks one task puts in order.
SPAN = STRETCH * 64


def _in_order(blocks: DataFrame, size: Column) -> DataFrame:
    """Blocks with ``before``, the sum of ``size`` over the blocks before, and ``expected``, the
    end of the block before. Blocks are put in order within spans of positions; of each span
    only a row of sums takes part in the total order."""
    rows = blocks.withColumn("_span", F.expr(f"start div {SPAN}")).withColumn("_size", size)
    own = Window.partitionBy("_span").orderBy("start", "end")
    spans = rows.groupBy("_span").agg(F.sum("_size").alias("_sum"), F.max(F.struct("start", "end")).alias("_last"))
    order = Window.orderBy("_span")
    spans = spans.select(
        "_span", F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_sum"),
        F.lag("_last.end", 1, 0).over(order).alias("_end"))
    rows = rows.withColumns({
        "_inside": F.coalesce(F.sum("_size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_lag": F.lag("end").over(own),
    })
    return rows.join(spans, "_span").withColumns({
        "before": (F.col("_sum") + F.col("_inside")).cast("long"), "expected": F.coalesce("_lag", "_end"),
    }).drop("_span", "_size", "_sum", "_end", "_inside", "_lag")


def offsets(blocks: DataFrame) -> DataFrame:
    """The bit at which each block would begin were the payloads one stream."""
    size = (F.col("end") - F.col("start")) * F.col("bits")
    return _in_order(blocks, size).withColumnRenamed("before", "bit_offset").drop("expected")


def _wrong() -> Column:
    return (F.col("start") != F.col("expected")) | (F.col("start") >= F.col("end"))


def problems(blocks: DataFrame) -> DataFrame:
    """Blocks that break the rules: begin at 0, no gap, no overlap, not empty. None is right."""
    return _in_order(blocks, F.lit(0)).filter(_wrong()).drop("before", "expected")


def block_rules(blocks: DataFrame) -> DataFrame:
    """One row: how many blocks break the rules, where the first begins and the last ends."""
    return _in_order(blocks.select("start", "end"), F.lit(0)).agg(
        F.count(F.when(_wrong(), 1)).alias("n_problems"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


def segment_sizes(blocks: DataFrame) -> DataFrame:
    """How many blocks have how many rows."""
    return blocks.groupBy((F.col("end") - F.col("start")).alias("n_rows")).agg(F.count(F.lit(1)).alias("n_blocks"))


def verify(df: DataFrame, blocks: DataFrame, pos: str, value: str) -> DataFrame:
    """How many positions differ after decoding, and how many there are."""
    from .relational import mismatches

    back = decode(blocks, df.schema[value].dataType.simpleString(), pos, value)
    return mismatches(df, back, pos, value)


def statistics(blocks: DataFrame, element_bytes: int = 8) -> DataFrame:
    """Sizes, ratio, number of blocks and mean bits per value."""
    n = F.sum(F.col("end") - F.col("start"))
    packed = F.sum(F.octet_length("payload")).cast("long")
    return blocks.agg(
        (n * element_bytes).alias("raw_bytes"), packed.alias("packed_bytes"),
        (n * element_bytes / (packed + 64 * F.count(F.lit(1)))).alias("ratio"),
        F.count(F.lit(1)).alias("n_blocks"),
        (F.sum((F.col("end") - F.col("start")) * F.col("bits")) / n).alias("mean_bits"),
    )


def runs(df: DataFrame, pos: str, value: str) -> DataFrame:
    """Run-length encoding: first position, length and value of each run of equal values.

    Runs are found within stretches of positions. A run that goes on over the edges of
    stretches is joined by one row per stretch, of its first and last values; nothing else
    takes part in a total order."""
    rows = df.select(F.col(pos).alias("pos"), F.col(value).alias("value"),
                     F.expr(f"{pos} div {STRETCH}").alias("stretch"))
    own = Window.partitionBy("stretch").orderBy("pos")
    rows = rows.withColumn("first", ~F.lag("value").over(own).eqNullSafe(F.col("value")) | F.lag("pos").over(own).isNull())
    rows = rows.withColumn("run", F.sum(F.col("first").cast("int")).over(own))
    local = rows.groupBy("stretch", "run").agg(
        F.min("pos").alias("start"), F.count(F.lit(1)).alias("length"), F.first("value").alias("value"))
    edges = local.groupBy("stretch").agg(
        F.max("run").alias("runs"), F.min(F.struct("run", "value")).alias("head"), F.max(F.struct("run", "value")).alias("tail"))
    order = Window.orderBy("stretch")
    edges = edges.withColumn("goes_on", F.lag("stretch").over(order).isNotNull()
                             & F.lag("tail.value").over(order).eqNullSafe(F.col("head.value")))
    # where the last run of a stretch begins: here, or where that of the stretch before does
    here = ~F.col("goes_on") | (F.col("runs") > 1)
    edges = edges.withColumn("begins", F.max(F.when(here, F.struct("stretch", "runs"))).over(
        order.rowsBetween(Window.unboundedPreceding, -1)))
    local = local.join(edges.filter("goes_on").select("stretch", F.lit(1).alias("run"), "begins"), ["stretch", "run"], "left")
    key = F.coalesce("begins", F.struct("stretch", F.col("run").alias("runs")))
    return local.groupBy(key.alias("joined")).agg(
        F.min("start").alias("start"), F.sum("length").alias("length"), F.first("value").alias("value")).drop("joined")


def expand(run_rows: DataFrame, pos: str = "pos", value: str = "value") -> DataFrame:
    """The column of its runs. A run is cut at stretches first, so no array is longer."""
    pieces = run_rows.select("start", (F.col("start") + F.col("length")).alias("end"), "value", F.explode(
        F.expr(f"sequence(start div {STRETCH}, (start + length - 1) div {STRETCH})")).alias("s"))
    return pieces.select(F.explode(F.expr(
        f"sequence(greatest(start, s * {STRETCH}), least(end, (s + 1) * {STRETCH}) - 1)")).alias(pos), F.col("value").alias(value))


def baseline_sizes(df: DataFrame, pos: str, value: str, size: int) -> DataFrame:
    """Bits a value needs per partition under the simple encodings: null suppression, frame of
    reference, delta, delta with frame, and runs."""
    from .partition import bit_length, with_pid

    rows = with_pid(df.select(F.col(pos).alias("p"), F.col(value).cast("long").alias("v")), "p", size)
    own = Window.partitionBy("pid").orderBy("p")
    rows = rows.withColumn("d", F.col("v") - F.lag("v").over(own))
    rows = rows.groupBy("pid").agg(
        F.count(F.lit(1)).alias("n"), F.max("v").alias("hi"), F.min("v").alias("lo"),
        F.max("d").alias("dhi"), F.min("d").alias("dlo"),
        (F.count(F.when(F.col("d") != 0, 1)) + 1).alias("n_runs"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "pid", "n", F.when(F.col("lo") < 0, 64).otherwise(bit_length(F.col("hi"))).alias("ns"),
        bit_length(F.col("hi") - F.col("lo")).alias("for_ns"),
        F.when(zero("dlo") < 0, 64).otherwise(bit_length(zero("dhi"))).alias("delta_ns"),
        bit_length(zero("dhi") - zero("dlo")).alias("delta_for_ns"), "n_runs",
    )
