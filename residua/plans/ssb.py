"""The thirteen star schema queries, each under several strategies with the same results.

``scan`` joins the filtered dimensions to the fact table and aggregates. ``pushdown`` first
turns what the date filter implies into ranges on stored columns, so that the Parquet reader
skips row groups, and so does the quantity filter. ``staged`` narrows the fact to the rows
that all dimensions keep, by semi-joins from the most selective one on, and joins the
payload afterwards.

The others read the fact from encoded columns (see ``operators.store``). ``decoded`` decodes
the needed columns whole and filters then. ``encoded`` skips blocks by their bounds, decodes
the filter columns of the others, and the rest of a block only where rows are left.
``bitpacked`` does the same on columns that are bit-packed without a model, ``planned`` on
columns whose blocks have the cheapest of the encodings without a model.

Dates are no join: year, month and week follow from the date key. Dimensions are not hinted
to be broadcast: Spark does so where their filtered size, which it measures, allows it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..sources import ssb
from ..sources.scratch import folder

RAW = ("scan", "pushdown", "staged")
STORED = ("decoded", "encoded", "bitpacked", "planned")
MODEL = {"bitpacked": "FOR", "planned": "PLANNED"}
STRATEGIES = RAW + STORED
FACT_KEY = {"part": "lo_partkey", "supplier": "lo_suppkey", "customer": "lo_custkey"}
DIM_KEY = {"part": "p_partkey", "supplier": "s_suppkey", "customer": "c_custkey"}
LOAD = {"part": ssb.part, "supplier": ssb.supplier, "customer": ssb.customer}
FACT = ["lo_orderdate", "lo_custkey", "lo_partkey", "lo_suppkey", "lo_quantity", "lo_extendedprice", "lo_discount", "lo_revenue"]
_stored: dict[tuple[str, str, str | None], str] = {}


def encoded_fact(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Blocks of the fact in the order of dates, encoded and written once per session."""
    key = spark.sparkContext.applicationId, sf_dir, model
    if key not in _stored:
        path = f"{folder(spark)}/lineorder"
        fact = ssb.lineorder(spark, sf_dir, cost=False)
        store.encode_table(fact, FACT, ["lo_orderdate", "lo_partkey"], model=model).write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


@dataclass(frozen=True)
class StarQuery:
    """A sum over the fact, grouped by dimension columns.

    ``dims`` maps a dimension to its filter, or None if it only gives a group column; the
    order is the order of joining; ``dates`` filters the fact itself. ``span`` is the range of order dates [from, to) that the
    date filter implies, ``quantity`` the exclusive bound that the fact filter implies.
    """

    measure: str
    name: str
    dims: dict[str, str | None]
    keys: tuple[str, ...] = ()
    fact: str | None = None
    span: tuple[date, date] | None = None
    quantity: tuple[int, int] | None = None
    cost: bool = field(default=False)

    def fact_rows(self, spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
        """The fact as the strategy reads it, with the parts of its dates."""
        if strategy in STORED:
            blocks = encoded_fact(spark, sf_dir, MODEL.get(strategy))
            ranges = {}
            if self.span and strategy != "decoded":
                first, last = self.span[0], self.span[1] - timedelta(days=1)
                ranges["lo_orderdate"] = tuple(d.year * 10000 + d.month * 100 + d.day for d in (first, last))
            if self.quantity and strategy != "decoded":
                ranges["lo_quantity"] = self.quantity
            used = f"{self.measure} {self.fact or ''}"
            columns = [c for c in FACT if c in used or c == "lo_orderdate" or c in (FACT_KEY.get(d) for d in self.dims)]
            fact = store.scan(blocks, columns, ranges)
        else:
            fact = ssb.lineorder(spark, sf_dir, cost=False)
            if strategy != "scan":
                if self.span:
                    fact = fact.filter((F.col("o_orderdate") >= F.lit(self.span[0]).cast("timestamp"))
                                       & (F.col("o_orderdate") < F.lit(self.span[1]).cast("timestamp")))
                if self.quantity:
                    fact = fact.filter(F.col("l_quantity").between(*map(float, self.quantity)))
        return ssb.with_date_parts(fact)

    def run(self, spark: SparkSession, sf_dir: str, strategy: str = "pushdown") -> DataFrame:
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy is one of {STRATEGIES}")
        fact = self.fact_rows(spark, sf_dir, strategy)
        for condition in (self.fact, self.dims.get("dates")):
            if condition:
                fact = fact.filter(condition)
        loaded = {}
        for dim, condition in self.dims.items():
            if dim != "dates":
                rows = LOAD[dim](spark, sf_dir)
                loaded[dim] = rows.filter(condition) if condition else rows
        payload = {
            dim: [c for c in rows.columns if c in self.keys or self.cost and c == "lo_supplycost"]
            for dim, rows in loaded.items()
        }
        if strategy == "staged":
            for dim, rows in loaded.items():
                if self.dims[dim]:
                    fact = fact.join(rows, F.col(FACT_KEY[dim]) == F.col(DIM_KEY[dim]), "left_semi")
        for dim, rows in loaded.items():
            if strategy == "staged" and not payload[dim]:
                continue
            rows = rows.select(DIM_KEY[dim], *payload[dim])
            fact = fact.join(rows, F.col(FACT_KEY[dim]) == F.col(DIM_KEY[dim]))
        total = F.sum(F.expr(self.measure)).cast("long").alias(self.name)
        if not self.keys:
            return fact.agg(total)
        return fact.groupBy(*(F.col(k).cast("long").alias(k) if k[0] in "dsc" or k == "p_brand1"
                              else F.col(k) for k in self.keys)).agg(total)

    def duck(self) -> str:
        """The same query as DuckDB text, from the standard formulation."""
        names = {"part": "ssb_part", "supplier": "ssb_supplier", "customer": "ssb_customer", "dates": "ssb_date"}
        left, right = FACT_KEY | {"dates": "lo_orderdate"}, DIM_KEY | {"dates": "d_datekey"}
        joins = " ".join(f"JOIN {names[d]} ON {left[d]} = {right[d]}" for d in self.dims)
        where = " AND ".join(f"({c})" for c in [*self.dims.values(), self.fact] if c) or "true"
        keys = ", ".join(self.keys)
        return (
            f"WITH {ssb.DUCK} SELECT {keys + ', ' if keys else ''}CAST(sum({self.measure}) AS BIGINT) AS {self.name} "
            f"FROM lineorder {joins} WHERE {where}" + (f" GROUP BY {keys}" if keys else "")
        )


def _years(first: int, last: int) -> tuple[date, date]:
    return date(first, 1, 1), date(last + 1, 1, 1)


_DISCOUNTED = {"measure": "lo_extendedprice * lo_discount", "name": "revenue"}
_REVENUE = {"measure": "lo_revenue", "name": "revenue"}
_PROFIT = {"measure": "lo_revenue - lo_supplycost", "name": "profit", "cost": True}

# The literals are those of the standard text, moved to the years, nations and brands that
# the fixtures hold.
QUERIES = {
    "ssb_q1_1": StarQuery(**_DISCOUNTED, dims={"dates": "d_year = 1996"}, span=_years(1996, 1996),
                          fact="lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25", quantity=(0, 25)),
    "ssb_q1_2": StarQuery(**_DISCOUNTED, dims={"dates": "d_yearmonthnum = 199701"},
                          span=(date(1997, 1, 1), date(1997, 2, 1)),
                          fact="lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35", quantity=(26, 36)),
    "ssb_q1_3": StarQuery(**_DISCOUNTED, dims={"dates": "d_weeknuminyear = 6 AND d_year = 1997"}, span=_years(1997, 1997),
                          fact="lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35", quantity=(26, 36)),
    "ssb_q2_1": StarQuery(**_REVENUE, keys=("d_year", "p_brand1"), dims={
        "part": "p_category = 'MFGR#12'", "supplier": "s_region = 'AMERICA'", "dates": None}),
    "ssb_q2_2": StarQuery(**_REVENUE, keys=("d_year", "p_brand1"), dims={
        "part": "p_brand1 BETWEEN 260 AND 267", "supplier": "s_region = 'ASIA'", "dates": None}),
    "ssb_q2_3": StarQuery(**_REVENUE, keys=("d_year", "p_brand1"), dims={
        "part": "p_brand1 = 247", "supplier": "s_region = 'EUROPE'", "dates": None}),
    "ssb_q3_1": StarQuery(**_REVENUE, keys=("c_nation", "s_nation", "d_year"), span=_years(1995, 2000), dims={
        "customer": "c_region = 'ASIA'", "supplier": "s_region = 'ASIA'", "dates": "d_year BETWEEN 1995 AND 2000"}),
    "ssb_q3_2": StarQuery(**_REVENUE, keys=("c_city", "s_city", "d_year"), span=_years(1995, 2000), dims={
        "customer": "c_nation = 21", "supplier": "s_nation = 21", "dates": "d_year BETWEEN 1995 AND 2000"}),
    "ssb_q3_3": StarQuery(**_REVENUE, keys=("c_city", "s_city", "d_year"), span=_years(1995, 2000), dims={
        "customer": "c_city IN (233, 238)", "supplier": "s_city IN (233, 238)",
        "dates": "d_year BETWEEN 1995 AND 2000"}),
    "ssb_q3_4": StarQuery(**_REVENUE, keys=("c_city", "s_city", "d_year"), span=(date(1995, 3, 1), date(1995, 4, 1)), dims={
        "dates": "d_yearmonthnum = 199503", "customer": "c_city IN (233, 238)",
        "supplier": "s_city IN (233, 238)"}),
    "ssb_q4_1": StarQuery(**_PROFIT, keys=("d_year", "c_nation"), dims={
        "customer": "c_region = 'AMERICA'", "supplier": "s_region = 'AMERICA'",
        "part": "p_mfgr IN ('MFGR#1', 'MFGR#2')", "dates": None}),
    "ssb_q4_2": StarQuery(**_PROFIT, keys=("d_year", "s_nation", "p_category"), span=_years(2000, 2001), dims={
        "customer": "c_region = 'AMERICA'", "supplier": "s_region = 'AMERICA'",
        "part": "p_mfgr IN ('MFGR#1', 'MFGR#2')", "dates": "d_year IN (2000, 2001)"}),
    "ssb_q4_3": StarQuery(**_PROFIT, keys=("d_year", "s_city", "p_brand1"), span=_years(2000, 2001), dims={
        "supplier": "s_nation = 21", "part": "p_category = 'MFGR#14'", "customer": "c_region = 'AMERICA'",
        "dates": "d_year IN (2000, 2001)"}),
}
