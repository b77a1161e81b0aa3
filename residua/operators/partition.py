"""Partitions of an ordered column and what is known of each: bounds, spread, cost.

A column is a DataFrame with a position (dense, unique, from 0) and a value. Everything here
groups by partition number, so it needs one shuffle and no total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that the metadata of a partition costs in the cost model.
OVERHEAD = 64


def bit_length(x: Column) -> Column:
    """Bits of a number that is not negative; 0 has none."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def with_pid(df: DataFrame, pos: str, size: int) -> DataFrame:
    """Fixed partitions of ``size`` positions; the last one is shorter."""
    return df.withColumn("pid", F.expr(f"{pos} div {size}"))


def bounds(df: DataFrame, pos: str, value: str, size: int) -> DataFrame:
    """Zone map: start, end (exclusive), min and max of each fixed partition."""
    return with_pid(df, pos, size).groupBy("pid").agg(
        F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"),
        F.min(value).alias("vmin"), F.max(value).alias("vmax"),
    )


def candidates(blocks: DataFrame, low: object, high: object) -> DataFrame:
    """Partitions that can hold a value in [low, high]; those without bounds always can."""
    return blocks.filter(
        F.col("vmin").isNull() | F.col("vmax").isNull() | ((F.col("vmax") >= low) & (F.col("vmin") <= high))
    )


def candidates_for(blocks: DataFrame, value: object) -> DataFrame:
    return candidates(blocks, value, value)


def candidate_rows(blocks: DataFrame) -> DataFrame:
    """How many partitions and positions are left to look at."""
    return blocks.agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("n_rows"),
    )


def pruned_positions(df: DataFrame, blocks: DataFrame, pos: str, value: str, size: int,
                     low: object, high: object) -> DataFrame:
    """Positions of values in [low, high], looked for in candidate partitions only."""
    kept = candidates(blocks, low, high).select("pid")
    rows = with_pid(df, pos, size).join(kept, "pid", "left_semi")
    return rows.filter(F.col(value).between(low, high)).select(pos)


def linear_residuals(df: DataFrame, pos: str, value: str, clamp: bool = False) -> DataFrame:
    """Per row of partitions in ``pid``: local index, least-squares line, exact residual.

    Sums are exact integers, each division is a single one in double precision, predictions
    round half to even. A partition of one row, or any singular one, has slope 0. ``clamp`` is
    for columns without negative values: a prediction below 0 counts as 0."""
    own = Window.partitionBy("pid")
    big = lambda e: F.sum(F.expr(f"cast({e} as decimal(38,0))")).over(own)
    rows = df.withColumn("i", F.col(pos) - F.min(pos).over(own)).withColumn("y", F.col(value).cast("long"))
    rows = rows.withColumns({
        "n": F.count(F.lit(1)).over(own), "sx": F.sum("i").over(own), "sy": big("y"),
        "sxx": F.sum(F.expr("i * i")).over(own), "sxy": big("i * y"),
    })
    det = F.expr("n * sxx - sx * sx")
    slope = F.when(det == 0, F.lit(0.0)).otherwise(
        F.expr("cast(n * sxy - sx * sy as double)") / det.cast("double"))
    rows = rows.withColumn("slope", slope).withColumn(
        "intercept", F.expr("(cast(sy as double) - slope * cast(sx as double)) / cast(n as double)"))
    prediction = "cast(rint(intercept + slope * i) as bigint)"
    prediction = f"greatest({prediction}, 0L)" if clamp else prediction
    return rows.withColumn("residual", F.expr(f"y - {prediction}")).drop(
        "sx", "sy", "sxx", "sxy")


def residual_bits(rows: DataFrame, margin: int = 1) -> DataFrame:
    """Per partition the largest residual and its bits: 0 if all are zero, else the bits of
    its magnitude and ``margin`` more (1: sign; 2: the merge cost rule), 64 at most."""
    worst = F.max(F.abs("residual"))
    return rows.groupBy("pid").agg(
        F.count(F.lit(1)).alias("n"), worst.alias("max_residual"),
        F.min("residual").alias("lo"), F.max("residual").alias("hi"),
    ).withColumn("bits", F.when(F.col("max_residual") == 0, 0).otherwise(
        F.least(F.lit(64), bit_length(F.col("max_residual")) + margin)))


def breakpoints(bits: DataFrame, threshold: int = 2) -> DataFrame:
    """Blocks where the bits jump by ``threshold`` or more, and the segment of each block.

    ``bits`` has one small row per block, so this is the only place with a total order."""
    order = Window.orderBy("pid")
    before = F.lag("bits").over(order)
    rows = bits.withColumn(
        "is_break", before.isNull() | (F.abs(F.col("bits") - before) >= threshold))
    return rows.withColumn("segment", F.sum(F.col("is_break").cast("int")).over(order) - 1)


def merge_costs(df: DataFrame, pos: str, value: str, size: int) -> DataFrame:
    """What each partition saves by being merged with the next: refit of both together."""
    def cost(rows: DataFrame) -> DataFrame:
        bits = residual_bits(linear_residuals(rows, pos, value), margin=2)
        return bits.withColumn("cost", OVERHEAD + F.col("n") * F.col("bits") / 8)

    single = cost(with_pid(df, pos, size)).select("pid", F.least("cost", F.col("n") * 8.0).alias("cost"))
    # every row once as the left half of a pair, once as the right half
    both = with_pid(df, pos, size).withColumn("pid", F.explode(F.array("pid", F.col("pid") - 1)))
    merged = cost(both.filter("pid >= 0")).select("pid", F.col("cost").alias("merged"))
    after = single.select((F.col("pid") - 1).alias("pid"), F.col("cost").alias("next_cost"))
    return single.join(after, "pid").join(merged, "pid").select(
        "pid", (F.col("cost") + F.col("next_cost")).alias("apart"), "merged",
        ((F.col("cost") + F.col("next_cost") - F.col("merged")) / (F.col("cost") + F.col("next_cost"))).alias("benefit"),
    )


def mark_merges(costs: DataFrame, odd: int, least: float = 0.05) -> DataFrame:
    """Pairs to merge in one half-round: those that begin at an even (0) or odd (1) partition
    and save at least that share. Pairs of one half-round never overlap."""
    return costs.withColumn("merge", (F.col("pid") % 2 == odd) & (F.col("benefit") >= least))


def variance_buckets(df: DataFrame, pos: str, value: str, base: int = 256, multiplier: int = 4,
                     buckets: int = 3, least: int = 64) -> DataFrame:
    """Partition sizes by spread: calm stretches get large partitions, restless ones small.

    Blocks of base * multiplier positions are ranked by their population variance; the
    (i + 1) / (k + 1) quantiles part them into k + 1 buckets of sizes base shifted by k / 2 - i.
    Returns block, variance, bucket, size and the partitions' starts."""
    block = base * multiplier
    rows = with_pid(df, pos, block).groupBy("pid").agg(
        F.var_pop(value).alias("variance"), F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"))
    shares = [(i + 1) / (buckets + 1) for i in range(buckets)]
    cuts = rows.agg(F.percentile_approx("variance", shares, 100_000).alias("c")).first()["c"] or []
    bucket = sum(((F.col("variance") > c).cast("int") for c in cuts), F.lit(0))
    sizes = [max(least, base << (buckets // 2 - i) if buckets // 2 >= i else base >> (i - buckets // 2))
             for i in range(buckets + 1)]
    rows = rows.withColumn("bucket", bucket)
    rows = rows.withColumn("size", F.element_at(F.array(*map(F.lit, sizes)), F.col("bucket") + 1))
    return rows.withColumn("starts", F.expr("sequence(start, end - 1, cast(size as bigint))"))
