"""The star schema (lineorder and four dimensions) over the fixture tables.

Every column is an integer or a string, so results are exact. Money is in cents, discounts
in percent, dates are YYYYMMDD. The same views exist as DuckDB text for the oracle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import probe

DATE_KEY = "year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)"
BRAND = "cast(substring(p_brand, 7) as bigint)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_with_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey as lo_custkey", "o_orderdate", f"{DATE_KEY} as lo_orderdate"
    )


#: What a date key says, by arithmetic; the week needs the calendar.
DATE_PARTS = {
    "d_year": "lo_orderdate div 10000", "d_yearmonthnum": "lo_orderdate div 100",
    "d_weeknuminyear": "(dayofyear(make_date(lo_orderdate div 10000, lo_orderdate div 100 % 100, lo_orderdate % 100)) - 1) div 7 + 1",
}


def with_date_parts(fact: DataFrame) -> DataFrame:
    """The fact with the columns of the date dimension, which follow from the key alone."""
    return fact.selectExpr("*", *(f"cast({e} as bigint) as {c}" for c, e in DATE_PARTS.items()))


def lineorder(spark: SparkSession, sf_dir: str, cost: bool = True) -> DataFrame:
    """Lines with their orders. ``cost`` adds lo_supplycost, which needs part as well."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber as lo_linenumber", "l_partkey as lo_partkey",
        "l_suppkey as lo_suppkey", "l_quantity", "cast(l_quantity as int) as lo_quantity",
        "cast(round(l_extendedprice * 100) as bigint) as lo_extendedprice",
        "cast(round(l_discount * 100) as bigint) as lo_discount",
    ).withColumn("lo_revenue", F.expr("lo_extendedprice * (100 - lo_discount) div 100"))
    out = lines.join(orders_with_dates(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    if cost:
        prices = table(spark, sf_dir, "part").selectExpr(
            "p_partkey as c_partkey",
            "cast(round(p_retailprice * 100) as bigint) * 6 div 10 as lo_supplycost",
        )
        out = out.join(prices, F.col("lo_partkey") == F.col("c_partkey")).drop("c_partkey")
    return out.drop("l_orderkey")


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part with the cost of supplying it, which the fact has in the standard schema."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{BRAND} as bn", "p_retailprice")
    return rows.selectExpr(
        "p_partkey", "concat('MFGR#', (bn - 1) div 5 + 1) as p_mfgr",
        "concat('MFGR#', (bn - 1) div 5 + 1, (bn - 1) % 5 + 1) as p_category",
        "(bn - 1) * 40 + p_partkey % 40 as p_brand1",
        "cast(round(p_retailprice * 100) as bigint) * 6 div 10 as lo_supplycost",
    )


def places(spark: SparkSession, sf_dir: str, prefix: str, name: str, key: str) -> DataFrame:
    """Supplier or customer with city, nation and region."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).selectExpr("n_nationkey", f"r_name as {prefix}_region")
    rows = table(spark, sf_dir, name).selectExpr(key, f"{prefix}_nationkey")
    return rows.join(nations, F.col(f"{prefix}_nationkey") == F.col("n_nationkey")).selectExpr(
        key, f"{prefix}_region", f"cast(n_nationkey as bigint) as {prefix}_nation",
        f"n_nationkey * 10 + {key} % 10 as {prefix}_city",
    )


supplier = partial(places, prefix="s", name="supplier", key="s_suppkey")
customer = partial(places, prefix="c", name="customer", key="c_custkey")


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per date that occurs."""
    return table(spark, sf_dir, "orders").selectExpr(
        f"{DATE_KEY} as d_datekey", "year(o_orderdate) as d_year",
        "year(o_orderdate) * 100 + month(o_orderdate) as d_yearmonthnum",
        "(dayofyear(o_orderdate) - 1) div 7 + 1 as d_weeknuminyear",
    ).distinct()


def _joined(fact: DataFrame, dim: DataFrame, condition: str | None = None, payload: Sequence[str] = (), *, key: tuple[str, str]) -> DataFrame:
    return probe(fact, dim, *key, payload, condition)


#: The fact with one dimension: (fact, dimension, filter of the dimension, its columns to add).
with_part = partial(_joined, key=("lo_partkey", "p_partkey"))
with_supplier = partial(_joined, key=("lo_suppkey", "s_suppkey"))
with_customer = partial(_joined, key=("lo_custkey", "c_custkey"))


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views for use from SQL."""
    for name, rows in (
        ("lineorder", lineorder(spark, sf_dir)), ("ssb_part", part(spark, sf_dir)),
        ("ssb_supplier", supplier(spark, sf_dir)), ("ssb_customer", customer(spark, sf_dir)),
        ("ssb_date", dates(spark, sf_dir)),
    ):
        rows.createOrReplaceTempView(name)


#: The same views in DuckDB's dialect, as common table expressions.
DUCK = """
o AS (SELECT o_orderkey, o_custkey AS lo_custkey,
  CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT) AS lo_orderdate,
  CAST(year(o_orderdate) AS BIGINT) AS d_year,
  CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS d_yearmonthnum,
  CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS BIGINT) AS d_weeknuminyear FROM orders),
l AS (SELECT l_orderkey, l_linenumber AS lo_linenumber, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey,
  CAST(l_quantity AS INT) AS lo_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS lo_extendedprice,
  CAST(round(l_discount * 100) AS BIGINT) AS lo_discount FROM lineitem),
p AS (SELECT p_partkey, CAST(substring(p_brand, 7) AS BIGINT) AS bn,
  CAST(round(p_retailprice * 100) AS BIGINT) * 6 // 10 AS lo_supplycost FROM part),
ssb_part AS (SELECT p_partkey, 'MFGR#' || ((bn - 1) // 5 + 1) AS p_mfgr,
  'MFGR#' || ((bn - 1) // 5 + 1) || ((bn - 1) % 5 + 1) AS p_category,
  (bn - 1) * 40 + p_partkey % 40 AS p_brand1 FROM p),
ssb_supplier AS (SELECT s_suppkey, r_name AS s_region, CAST(n_nationkey AS BIGINT) AS s_nation,
  CAST(n_nationkey * 10 + s_suppkey % 10 AS BIGINT) AS s_city FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ssb_customer AS (SELECT c_custkey, r_name AS c_region, CAST(n_nationkey AS BIGINT) AS c_nation,
  CAST(n_nationkey * 10 + c_custkey % 10 AS BIGINT) AS c_city FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ssb_date AS (SELECT DISTINCT lo_orderdate AS d_datekey, d_year, d_yearmonthnum, d_weeknuminyear FROM o),
lineorder AS (SELECT l.*, o.lo_custkey, o.lo_orderdate, p.lo_supplycost,
  lo_extendedprice * (100 - lo_discount) // 100 AS lo_revenue
  FROM l JOIN o ON l_orderkey = o_orderkey JOIN p ON lo_partkey = p_partkey)
"""
