"""Access by position: requests are rows (ordinal, pos), results keep order and repeats.

A position that the column does not have gives null, never another row's value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codec import STRETCH, decode, decode_where


def fetch(column: DataFrame, requests: DataFrame, pos: str = "pos", value: str = "value") -> DataFrame:
    """Values at the requested positions: (ordinal, pos, value), one row per request."""
    own = column.select(F.col(pos).alias("pos"), F.col(value).alias("value"))
    return requests.select("ordinal", "pos").join(own, "pos", "left").select("ordinal", "pos", "value")


def find_block(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """The block of each request, or null: (ordinal, pos, pid).

    Blocks lie within stretches of positions, so this is an equi-join on the stretch and a
    comparison, not a join of every request with every block."""
    spots = blocks.select("pid", "start", "end", F.explode(
        F.expr(f"sequence(start div {STRETCH}, (end - 1) div {STRETCH})")).alias("stretch"))
    asked = requests.select("ordinal", "pos").withColumn("stretch", F.expr(f"floor(pos / {STRETCH})"))
    hit = asked.alias("a").join(
        spots.alias("s"), (F.col("a.stretch") == F.col("s.stretch")) & (F.col("a.pos") >= F.col("s.start"))
        & (F.col("a.pos") < F.col("s.end")), "left")
    return hit.select("ordinal", F.col("a.pos").alias("pos"), "pid")


def fetch_encoded(blocks: DataFrame, requests: DataFrame, kind: str = "bigint") -> DataFrame:
    """Values from the encoded column, of which only the blocks that are asked for are decoded."""
    asked = find_block(blocks, requests)
    wanted = asked.filter("pid is not null").select("pid").distinct()
    rows = decode(blocks.join(wanted, "pid", "left_semi"), kind)
    return fetch(rows, asked)


def fetch_known(blocks: DataFrame, requests: DataFrame, kind: str = "bigint") -> DataFrame:
    """As ``fetch_encoded`` for requests that name their block in ``pid``."""
    rows = decode(blocks.join(requests.select("pid").distinct(), "pid", "left_semi"), kind)
    return fetch(rows, requests)


def fetch_range(blocks: DataFrame, start: int, end: int, kind: str = "bigint") -> DataFrame:
    """Positions [start, end) and their values; blocks outside are not decoded."""
    near = blocks.filter((F.col("end") > start) & (F.col("start") < end))
    return decode(near, kind).filter((F.col("pos") >= start) & (F.col("pos") < end))


def fetch_where(column: DataFrame, requests: DataFrame, condition: Column | str,
                pos: str = "pos", value: str = "value") -> DataFrame:
    """Requested values that pass a predicate on ``value``."""
    return fetch(column, requests, pos, value).filter(condition)


def two_stage(table: DataFrame, condition: Column | str, pos: str, columns: list[str]) -> DataFrame:
    """Scan the filter's columns for positions, then gather other columns there."""
    spots = table.filter(condition).select(pos)
    return table.select(pos, *columns).join(spots, pos, "left_semi")


@dataclass(frozen=True)
class EncodedColumn:
    """An encoded column as something to look things up in. Requests meet the bounds of its
    blocks, which hold no payload; blocks are decoded only where something is asked of them."""

    blocks: DataFrame
    kind: str = "bigint"

    @property
    def bounds(self) -> DataFrame:
        return self.blocks.select("pid", "start", "end", "vmin", "vmax")

    def at(self, requests: DataFrame) -> DataFrame:
        """(ordinal, pos, value) of requests (ordinal, pos)."""
        asked = find_block(self.bounds, requests)
        wanted = asked.filter("pid is not null").select("pid").distinct()
        return fetch(decode(self.blocks.join(wanted, "pid", "left_semi"), self.kind), asked)

    def between(self, low: object, high: object) -> DataFrame:
        """(pos, value) of the values in [low, high]."""
        return decode_where(self.blocks, low, high, self.kind)

    def part(self, start: int, end: int) -> DataFrame:
        """(pos, value) of the positions [start, end)."""
        return fetch_range(self.blocks, start, end, self.kind)


def fetch_columns(columns: dict[str, EncodedColumn], requests: DataFrame) -> DataFrame:
    """Several columns at the requested positions: (ordinal, pos, one value per name)."""
    out = requests.select("ordinal", "pos")
    for name, column in columns.items():
        out = out.join(column.at(requests).select("ordinal", F.col("value").alias(name)), "ordinal")
    return out


def lookup_table(requests: DataFrame, size: int) -> DataFrame:
    """Requests per fixed partition: what a gather has to touch."""
    return requests.groupBy(F.expr(f"pos div {size}").alias("pid")).agg(
        F.count(F.lit(1)).alias("n_requests"), F.countDistinct("pos").alias("n_positions"))


def fetch_sorted(column: DataFrame, requests: DataFrame, pos: str = "pos", value: str = "value") -> DataFrame:
    """As ``fetch``, dealt out by position and returned in the order of the requests."""
    return fetch(column, requests.repartitionByRange("pos"), pos, value).orderBy("ordinal")
