"""Sharding by proportional stratified interleaving. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, packed, ranked


def interleaved_shards(
    spark: SparkSession,
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Deal rows to shards so that every shard has each source in its share of all rows.

    Rows of a source are ranked in a seeded random order; a row of rank r among n has the
    fractional rank (2r + 1) / 2n. Sorting all rows by it spreads every source evenly along
    one line, which is cut into shards whose row counts differ by one at most. Both ranks are
    distributed (see ``ranked``): a source with a third of all rows is no single task.

    Null texts are empty, null sources are one source of their own, null identifiers hash
    like a value; rows alike in everything are interchangeable, so ties change nothing. An
    empty table gives no rows. Columns other than those named in ``carry`` are not read.

    Returns doc_id, source, size (UTF-8 bytes plus one), text_crc32, shard, slot, and carried
    (a struct of ``carry``).
    """
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(
        column(id_col).alias("doc_id"), column(source_col).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), column(id_col)).alias("key"),
        packed(carry).alias("carried"),
    )
    rows = ranked(scratch, rows, ["key", "doc_id", "text_crc32", "size"], "r", by="source")
    sums = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    l, n = rows.alias("l"), sums.alias("n")
    rows = l.join(n, F.col("l.source").eqNullSafe(F.col("n.source"))).select("l.*", "n.n")
    rows = rows.withColumn("at", (2 * F.col("r") + 1) / (2 * F.col("n")))
    rows = ranked(scratch, rows.drop("key", "n"), ["at", "source", "r"], "place")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    total = total.first()["total"]
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    return rows.withColumn("shard", shard.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", "shard",
        F.expr(f"place - (shard * {total}L + {shards - 1}) div {shards}").alias("slot"),
        "carried",
    )


def write_shards(
    spark: SparkSession, docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", **options: str | int,
) -> None:
    """Write every row, in the order of its slots, below ``path`` in folders by shard.

    Rows are numbered and written once, placed by number, and joined with their places by
    number, so null or repeated identifiers and rows alike in everything are rows like others.
    The folders are named ``shard=``, or with underscores behind it where a column of the table
    has that name. An empty table writes no folder."""
    scratch = Scratch(spark, "shards")
    rows = scratch.keep(docs.select(
        F.struct(*(column(c) for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("_row")), "rows")
    slim = rows.select(
        F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).alias("text"),
        F.col("row").getField(source_col).alias("source"), "_row")
    placed = interleaved_shards(spark, slim, shards, "id", "text", "source", carry=("_row",), **options)
    placed = placed.select(F.col("carried._row").alias("_row"), "shard", "slot")
    folder, taken = "shard", {c.lower() for c in docs.columns}
    while folder in taken:
        folder += "_"
    rows = rows.join(placed, "_row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.col("shard").alias(folder)).write.partitionBy(
        folder).parquet(path)
