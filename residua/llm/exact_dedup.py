"""Exact dedup as a stream over disk-backed keyed state that never expires."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, column

#: State on disk; without space set aside for each of many small stores.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _chunks(counts: list[tuple[str, int]], most: int) -> Iterator[tuple[list[str], int, int]]:
    """Files that hold at most so many hits together: (files, part, parts). A file that holds
    more by itself comes in several parts of its rows."""
    files, held = [], 0
    for file, n in counts:
        if n > most:
            parts = -(-n // most) * 2  # rows fall into parts by hash, so not quite evenly
            yield from (([file], part, parts) for part in range(parts))
            continue
        if held + n > most:
            yield files, 0, 1
            files, held = [], 0
        files.append(file)
        held += n
    if files:
        yield files, 0, 1


def _contents(located: DataFrame, hits: DataFrame, most: int) -> Iterator[DataFrame]:
    """The texts of hits (file, row, digest), fetched by their locators: a scan of some files at
    a time, with the locators of at most about ``most`` hits in them sent to its tasks, so no
    other text moves. Only a row per file goes to the driver."""
    counts = hits.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()
    for files, part, parts in _chunks(sorted((r["file"], r["n"]) for r in counts), most):
        some = F.col("file").isin(files)
        if parts > 1:
            some &= F.pmod(F.xxhash64("row"), F.lit(parts)) == part
        yield located.filter(some).join(F.broadcast(hits.filter(some)), ["file", "row"]).select(
            "digest", "doc_id", "file", "row", ascii_lower(F.col("text")).alias("norm"))


def exact_dedup(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 8,
    fetched: int = 500_000,
) -> DataFrame:
    """Group the rows of a Parquet table by equal text and say which one of each group stays.

    One pass reads the texts and writes an arrival per row: digest of the text (lower-cased
    A-Z, null as empty), identifier and locator. The arrivals are then read as a stream. A
    streaming aggregation keeps, per digest, one state row in RocksDB, without watermark or expiry:
    the stable identifier and the content locator (file, row in file) of the holder, and the
    number of rows. The state checkpoint lies in the shared folder, so a lost executor's
    share is loaded again from there. Every hit, that is every row whose digest has more than
    one row, is then fetched by its locator, with the locators of ``fetched`` hits at a time
    broadcast to the scan of their files, and its full bytes are compared: rows with one
    digest are grouped by the bytes themselves, combined on the map side. Where a digest has
    two or more texts, each of these is a group of its own, whatever the digest says. (The
    comparison follows the stream, in one scan of the table, since Parquet cannot be read
    row by row as hits arrive.)

    The row with the largest identifier stays; null sorts first; among rows with the same
    identifier the last by locator stays, so each group keeps exactly one row. An empty table
    gives no rows; other columns of the table are not read.

    Returns doc_id, keep_id, group_size, kept, text_sha256, file, row.
    """
    scratch = Scratch(spark, "exact-dedup")
    located = spark.read.parquet(path).select(
        column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    norm = ascii_lower(F.col("text"))
    own = [] if digest is sha256 else [sha256(norm).alias("sha256")]
    rows = scratch.keep(
        located.select("doc_id", "file", "row", digest(norm).alias("digest"), *own), "arrivals"
    )
    text_sha256 = F.lower(F.hex("sha256" if own else "digest"))
    result = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "file", "row"]
    if rows.isEmpty():
        return rows.withColumns({
            "keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True),
            "text_sha256": text_sha256,
        }).select(result)

    arrivals = (
        spark.readStream.schema(rows.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(rows._residua_path)
    )
    state = arrivals.groupBy("digest").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("holder"),
        F.count(F.lit(1)).alias("group_size"),
    )
    checkpoint = scratch.path("stream")
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        state.writeStream.format("noop").outputMode("update").option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    held = spark.read.format("statestore").load(checkpoint).select("key.*", "value.*").toDF(
        "digest", "holder", "group_size"
    )
    groups = scratch.keep(rows.join(held, "digest"), "groups")
    scratch.drop(rows)
    scratch.delete(checkpoint)

    def texts_of(content: DataFrame) -> DataFrame:
        return content.groupBy("digest", "norm").agg(
            F.max(F.struct("doc_id", "file", "row")).alias("own_holder"), F.count(F.lit(1)).alias("own_size"))

    hits = groups.filter("group_size > 1").select("file", "row", "digest")
    found = [scratch.keep(texts_of(content), "texts") for content in _contents(located, hits, fetched)]
    if found:
        variants = reduce(DataFrame.unionByName, found).groupBy("digest", "norm").agg(
            F.max("own_holder").alias("own_holder"), F.sum("own_size").alias("own_size"))
        clashing = variants.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
        clashing = scratch.keep(clashing, "clashing")
        if not clashing.isEmpty():
            variants = variants.join(clashing, "digest", "left_semi")
            again = _contents(located, hits.join(clashing, "digest", "left_semi"), fetched)
            apart = [
                scratch.keep(content.join(variants, ["digest", "norm"]).select("file", "row", "own_holder", "own_size"), "apart")
                for content in again
            ]
            groups = groups.join(reduce(DataFrame.unionByName, apart), ["file", "row"], "left").withColumns({
                "holder": F.coalesce("own_holder", "holder"),
                "group_size": F.coalesce("own_size", "group_size"),
            })
        scratch.drop(*found)
    kept = (F.col("holder.file") == F.col("file")) & (F.col("holder.row") == F.col("row"))
    return groups.withColumns(
        {"keep_id": F.col("holder.doc_id"), "kept": kept, "text_sha256": text_sha256}
    ).select(result)
