"""Columns that arrive as streams: blocks per micro-batch, and aggregates kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.codec import Config, encode


def encode_stream(stream: DataFrame, pos: str, value: str, path: str, checkpoint: str,
                  config: Config = Config.fixed()) -> StreamingQuery:
    """Encode what has arrived, micro-batch by micro-batch, each into a folder of its own below
    ``path``, and end. A batch that is run again after a failure replaces its folder, so every
    block is there once. Within a batch the positions must be dense from a multiple of the
    partition size on, as files of a column written in order are."""
    def one(batch: DataFrame, number: int) -> None:
        first = batch.agg(F.min(pos)).first()[0] or 0
        encode(batch, pos, value, config, first).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def zone_map_stream(stream: DataFrame, pos: str, value: str, size: int) -> DataFrame:
    """The zone map of a growing column, to be written in update mode: one state row per
    partition, whose bounds only widen."""
    return stream.groupBy(F.expr(f"{pos} div {size}").alias("pid")).agg(
        F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"),
        F.min(value).alias("vmin"), F.max(value).alias("vmax"))
