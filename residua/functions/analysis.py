"""What there is to know of a column before it is encoded. One small row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def basic(df: DataFrame, value: str) -> DataFrame:
    return df.agg(
        F.count(value).alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"),
        F.round(F.avg(value), 6).alias("mean"), F.countDistinct(value).alias("n_distinct"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _steps(df: DataFrame, pos: str, value: str, stretch: int = 65536) -> DataFrame:
    """Differences of neighbours. Each stretch is sorted on its own; the row before a stretch
    is handed to it as well, so that no difference is lost at its edge."""
    rows = df.select(F.col(pos).alias("p"), F.col(value).alias("v"))
    own = rows.withColumn("s", F.expr(f"p div {stretch}"))
    edge = rows.filter(f"p % {stretch} = {stretch - 1}").withColumn("s", F.expr(f"p div {stretch} + 1"))
    both = own.withColumn("own", F.lit(True)).unionByName(edge.withColumn("own", F.lit(False)))
    before = Window.partitionBy("s").orderBy("p")
    return both.withColumn("d", F.col("v") - F.lag("v").over(before)).filter("own and d is not null")


def deltas(df: DataFrame, pos: str, value: str) -> DataFrame:
    return _steps(df, pos, value).agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("lowest"), F.max("d").alias("highest"),
        F.count(F.when(F.col("d") == 0, 1)).alias("n_zero"))


def sortedness(df: DataFrame, pos: str, value: str) -> DataFrame:
    return _steps(df, pos, value).agg(
        F.count(F.when(F.col("d") >= 0, 1)).alias("n_rising"),
        F.count(F.when(F.col("d") < 0, 1)).alias("n_falling"))


def entropy(df: DataFrame, value: str) -> DataFrame:
    """Bits per value: -sum p log2 p."""
    counts = value_counts(df, value)
    return counts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("s")).select(
        F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("entropy"))


def estimate(df: DataFrame, pos: str, value: str, size: int) -> DataFrame:
    """Bytes of a column under frame of reference per fixed partition: packed bits in whole
    bytes, and eight bytes for the frame."""
    from ..operators.partition import bit_length, with_pid

    blocks = with_pid(df, pos, size).groupBy("pid").agg(
        F.count(F.lit(1)).alias("n"), (F.max(value) - F.min(value)).alias("spread"))
    bits = (F.col("n") * bit_length(F.col("spread"))).cast("long")
    return blocks.withColumn("bits", bits).agg(
        F.sum(F.col("n") * 8).alias("raw_bytes"), F.sum(F.expr("(bits + 7) div 8 + 8")).alias("packed_bytes"))


def limits(df: DataFrame, pos: str, value: str) -> DataFrame:
    """What a column could be at best as one piece: bytes under one frame of reference, and as
    differences of neighbours, unsigned if none falls, with a sign bit otherwise; eight bytes
    for the first value."""
    from ..operators.partition import bit_length

    frame = df.agg(F.count(F.lit(1)).alias("n"), (F.max(value) - F.min(value)).alias("spread"))
    step = _steps(df, pos, value).agg(F.min("d").alias("least"), F.max("d").alias("most"), F.max(F.abs("d")).alias("widest"))
    bits = F.when(F.col("least") >= 0, bit_length(F.col("most"))).otherwise(bit_length(F.col("widest")) + 1)
    # one row each
    both = frame.withColumn("one", F.lit(1)).join(step.withColumn("one", F.lit(1)), "one").withColumns({
        "frame_bits": F.coalesce(bit_length(F.col("spread")), F.lit(0)), "delta_bits": F.coalesce(bits, F.lit(0))})
    return both.select(
        "n", (F.col("n") * 8).alias("raw_bytes"), "frame_bits", F.expr("8 + n * frame_bits div 8").alias("frame_bytes"),
        "delta_bits", F.expr("8 + n * delta_bits div 8").alias("delta_bytes"))


def byte_entropy(df: DataFrame, value: str) -> DataFrame:
    """Bits per byte of the values' eight bytes, and the ratio that they allow at best."""
    each = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function(
        "shiftright", F.col(value).cast("long"), i * 8).bitwiseAND(F.lit(255)))
    counts = value_counts(df.select(F.explode(each).alias("byte")), "byte")
    return counts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("s")).select(
        F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("entropy"),
        F.round(8 / (F.log2("n") - F.col("s") / F.col("n")), 6).alias("ratio"))
