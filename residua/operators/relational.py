"""Filters, joins and aggregations of the star schema engine, as DataFrame functions.

All of them are single declarative plans: Spark picks join sides and pushes filters down.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {
    "=": lambda c, v: c == v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
}


# --- filters

def compare(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    """Rows whose column compares so with the value. Null never does."""
    return df.filter(COMPARE[op](F.col(column), F.lit(value)))


def between(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """Rows with low <= column <= high."""
    return df.filter(F.col(column).between(low, high))


def all_of(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.filter(reduce(and_, conditions, F.lit(True)))


def any_of(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.filter(reduce(or_, conditions, F.lit(False)))


def one_of(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def positions(df: DataFrame, pos: str, *conditions: Column) -> DataFrame:
    """Positions of the rows that pass all conditions; nothing else is read."""
    return all_of(df, *conditions).select(pos)


def gather(df: DataFrame, wanted: DataFrame, pos: str) -> DataFrame:
    """The rows at the wanted positions; positions that do not occur give none."""
    return df.join(wanted.select(pos).distinct(), pos, "left_semi")


def scatter(df: DataFrame, target: DataFrame, pos: str, column: str, default: object = 0) -> DataFrame:
    """Every position of ``target`` with the column's value from ``df``, or the default."""
    values = df.select(pos, F.col(column).alias("_v"))
    return target.select(pos).join(values, pos, "left").select(
        pos, F.coalesce("_v", F.lit(default)).alias(column)
    )


# --- joins

def probe(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, payload: Sequence[str] = (),
          condition: Column | str | None = None) -> DataFrame:
    """Inner join from a foreign key to a dimension, filtered before it is built.

    A dimension key that occurs more than once joins with each of its rows."""
    rows = dim.filter(condition) if condition is not None else dim
    rows = rows.select(F.col(dim_key).alias("_key"), *payload)
    return fact.join(rows, F.col(fact_key) == F.col("_key")).drop("_key")


def member(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
           condition: Column | str | None = None) -> DataFrame:
    """Fact rows whose key the filtered dimension holds."""
    rows = dim.filter(condition) if condition is not None else dim
    rows = rows.select(F.col(dim_key).alias("_key"))
    return fact.join(rows, F.col(fact_key) == F.col("_key"), "left_semi")


def probe_all(fact: DataFrame, *dims: tuple[DataFrame, str, str, Sequence[str]]) -> DataFrame:
    """Star join of any number of dimensions, in the order given."""
    for dim, fact_key, dim_key, payload in dims:
        fact = probe(fact, dim, fact_key, dim_key, payload)
    return fact


def direct_address(df: DataFrame, key: str, base: int, slots: int) -> DataFrame:
    """The slot of each key in a table of ``slots`` cells: (key - base) mod slots."""
    return df.withColumn("slot", F.pmod(F.col(key) - F.lit(base), F.lit(slots)))


def direct_probe(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, base: int, slots: int,
                 payload: Sequence[str] = ()) -> DataFrame:
    """Inner join through a table of ``slots`` cells, in which keys of one cell are told apart.
    Rows meet by cell and key, so a cell that many keys share is no larger group."""
    cells = direct_address(dim.select(F.col(dim_key).alias("_key"), *payload), "_key", base, slots)
    rows = direct_address(fact, fact_key, base, slots).withColumnRenamed("slot", "_slot")
    return rows.join(cells, (F.col("_slot") == F.col("slot")) & (F.col(fact_key) == F.col("_key"))).drop("_key", "_slot", "slot")


def hashes(df: DataFrame, key: str) -> DataFrame:
    """Spark's two hash functions of a key: Murmur3 (32 bits) and xxHash64."""
    return df.withColumns({"murmur3": F.hash(key), "xx64": F.xxhash64(key)})


# --- aggregations

def group_sums(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Sum and count per group; groups of sum 0 stay, and none is out of range."""
    return df.groupBy(*keys).agg(
        F.sum(F.expr(measure)).alias("total"), F.count(F.lit(1)).alias("n_rows")
    )


def totals(groups: DataFrame, total: str = "total") -> DataFrame:
    """Of a grouped result: its number of groups, how many are not 0, and the grand total."""
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count(F.when(F.col(total) != 0, 1)).alias("n_nonzero"),
        F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("grand_total"),
    )


def regression_sums(df: DataFrame, pid: str, x: str, y: str) -> DataFrame:
    """Exact sums of a least-squares fit per group."""
    big = lambda e: F.sum(F.expr(f"cast({e} as decimal(38,0))")).cast("decimal(38,0)")
    return df.groupBy(pid).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        big(f"{x} * {x}").cast("long").alias("sxx"), big(f"{x} * {y}").cast("long").alias("sxy"),
    )


#: Sums of i, i^2 and so on for i from 0 to n - 1, in whole numbers.
POWER_SUMS = {k: f"({e}) div {d}" for k, d, e in (
    (1, 2, "n * (n - 1)"),
    (2, 6, "n * (n - 1) * (2 * n - 1)"),
    (3, 4, "n * n * (n - 1) * (n - 1)"),
    (4, 30, "n * (n - 1) * (2 * n - 1) * (3 * n * n - 3 * n - 1)"),
    (5, 12, "n * n * (n - 1) * (n - 1) * (2 * n * n - 2 * n - 1)"),
    (6, 42, "cast(n * (n - 1) * (2 * n - 1) as decimal(38,0)) * (3 * n * n * n * n - 6 * n * n * n + 3 * n + 1)"),
)}


def mismatches(left: DataFrame, right: DataFrame, pos: str, value: str) -> DataFrame:
    """How many positions hold different values or occur on one side only."""
    a = left.select(pos, F.col(value).alias("_a"))
    b = right.select(pos, F.col(value).alias("_b"))
    return a.join(b, pos, "full").agg(
        F.count(F.when(~F.col("_a").eqNullSafe(F.col("_b")), 1)).alias("n_mismatch"),
        F.count(F.lit(1)).alias("n_rows"),
    )
