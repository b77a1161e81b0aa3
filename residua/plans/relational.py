"""Queries that show each relational operator on the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import ssb

QUERIES, SQL = {}, {}


def query(sql: str, star: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = (f"WITH {ssb.DUCK} " if star else "") + sql
        return f

    return add


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return ssb.table(spark, d, "lineitem")


def _compare(name: str, op: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.compare(_lines(spark, sf_dir), "l_quantity", op, 25.0).select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")

    run.__name__ = name
    query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity {op} 25")(run)


for _name, _op in (("filter_eq", "="), ("filter_gt", ">"), ("filter_ge", ">="), ("filter_lt", "<"), ("filter_le", "<=")):
    _compare(_name, _op)


@query("SELECT l_orderkey, l_partkey, l_discount FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.05")
def filter_between(spark, sf_dir):
    return R.between(_lines(spark, sf_dir), "l_discount", 0.03, 0.05).select("l_orderkey", "l_partkey", "l_discount")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R' AND l_linenumber = 2")
def filter_and(spark, sf_dir):
    return R.all_of(_lines(spark, sf_dir), F.col("l_quantity") < 10, F.col("l_returnflag") == "R",
                    F.col("l_linenumber") == 2).select("l_orderkey", "l_partkey")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity = 50 OR l_linenumber = 7")
def filter_or(spark, sf_dir):
    return R.any_of(_lines(spark, sf_dir), F.col("l_quantity") == 50, F.col("l_linenumber") == 7).select(
        "l_orderkey", "l_partkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')")
def filter_in(spark, sf_dir):
    return R.one_of(ssb.table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).select(
        "o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000")
def filter_positions(spark, sf_dir):
    return R.positions(ssb.table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_totalprice").between(100000.0, 120000.0))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-03-01'")
def filter_date_range(spark, sf_dir):
    day = lambda t: F.lit(t).cast("timestamp")
    return R.positions(ssb.table(spark, sf_dir, "orders"), "o_orderkey",
                       F.col("o_orderdate") >= day("1996-02-01"), F.col("o_orderdate") < day("1996-03-01"))


@query("""SELECT lo_orderdate, lo_linenumber, lo_partkey, lo_revenue FROM lineorder
  WHERE lo_orderdate BETWEEN 19960101 AND 19961231 AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25""", star=True)
def filter_three_predicates(spark, sf_dir):
    return R.all_of(ssb.lineorder(spark, sf_dir, cost=False), F.col("lo_orderdate").between(19960101, 19961231),
                    F.col("lo_discount").between(1, 3), F.col("lo_quantity") < 25).select(
        F.col("lo_orderdate").cast("long").alias("lo_orderdate"), "lo_linenumber", "lo_partkey", "lo_revenue")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN
  (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000) AND l_discount >= 0.05 AND l_quantity <= 20""")
def filter_secondary(spark, sf_dir):
    wanted = R.positions(ssb.table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_totalprice") > 400000)
    rows = R.gather(_lines(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey"), wanted, "o_orderkey")
    return R.all_of(rows, F.col("l_discount") >= 0.05, F.col("l_quantity") <= 20).select(
        F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey")


@query("""SELECT lo_partkey, lo_linenumber, lo_extendedprice * lo_discount AS discounted,
  lo_revenue - lo_supplycost AS profit FROM lineorder WHERE lo_quantity > 45""", star=True)
def computed_projection(spark, sf_dir):
    return ssb.lineorder(spark, sf_dir).filter("lo_quantity > 45").selectExpr(
        "lo_partkey", "lo_linenumber", "lo_extendedprice * lo_discount as discounted",
        "lo_revenue - lo_supplycost as profit")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def gather_rows(spark, sf_dir):
    wanted = R.compare(_lines(spark, sf_dir), "l_returnflag", "=", "R").withColumnRenamed("l_orderkey", "o_orderkey")
    return R.gather(ssb.table(spark, sf_dir, "orders"), wanted, "o_orderkey").select(
        "o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 3 THEN o_custkey ELSE 0 END AS o_custkey FROM orders")
def scatter_rows(spark, sf_dir):
    orders = ssb.table(spark, sf_dir, "orders")
    return R.scatter(orders.filter("o_custkey % 10 = 3"), orders, "o_orderkey", "o_custkey")


@query("""SELECT lo_linenumber, lo_partkey, lo_suppkey, p_category FROM lineorder JOIN ssb_part ON lo_partkey = p_partkey
  WHERE p_mfgr = 'MFGR#3'""", star=True)
def join_probe_payload(spark, sf_dir):
    fact = ssb.lineorder(spark, sf_dir, cost=False)
    return R.probe(fact, ssb.part(spark, sf_dir), "lo_partkey", "p_partkey", ["p_category"], "p_mfgr = 'MFGR#3'").select(
        "lo_linenumber", "lo_partkey", "lo_suppkey", "p_category")


@query("""SELECT lo_linenumber, lo_partkey, lo_suppkey FROM lineorder WHERE lo_suppkey IN
  (SELECT s_suppkey FROM ssb_supplier WHERE s_region = 'EUROPE')""", star=True)
def join_membership(spark, sf_dir):
    fact = ssb.lineorder(spark, sf_dir, cost=False)
    return R.member(fact, ssb.supplier(spark, sf_dir), "lo_suppkey", "s_suppkey", "s_region = 'EUROPE'").select(
        "lo_linenumber", "lo_partkey", "lo_suppkey")


@query("""SELECT c_region, s_region, p_mfgr, CAST(d_year AS BIGINT) AS d_year, count(*) AS n_rows FROM lineorder
  JOIN ssb_customer ON lo_custkey = c_custkey JOIN ssb_supplier ON lo_suppkey = s_suppkey
  JOIN ssb_part ON lo_partkey = p_partkey JOIN ssb_date ON lo_orderdate = d_datekey GROUP BY ALL""", star=True)
def join_four_dimensions(spark, sf_dir):
    return R.probe_all(
        ssb.lineorder(spark, sf_dir, cost=False),
        (ssb.customer(spark, sf_dir), "lo_custkey", "c_custkey", ["c_region"]),
        (ssb.supplier(spark, sf_dir), "lo_suppkey", "s_suppkey", ["s_region"]),
        (ssb.part(spark, sf_dir), "lo_partkey", "p_partkey", ["p_mfgr"]),
        (ssb.dates(spark, sf_dir), "lo_orderdate", "d_datekey", ["d_year"]),
    ).groupBy("c_region", "s_region", "p_mfgr", F.col("d_year").cast("long").alias("d_year")).agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT p_brand1, CAST(sum(lo_revenue) AS BIGINT) AS total, count(*) AS n_rows FROM lineorder
  JOIN ssb_part ON lo_partkey = p_partkey WHERE p_category = 'MFGR#21' AND lo_suppkey IN
  (SELECT s_suppkey FROM ssb_supplier WHERE s_region = 'ASIA') GROUP BY p_brand1""", star=True)
def join_staged(spark, sf_dir):
    fact = R.member(ssb.lineorder(spark, sf_dir, cost=False), ssb.supplier(spark, sf_dir), "lo_suppkey", "s_suppkey", "s_region = 'ASIA'")
    fact = R.probe(fact, ssb.part(spark, sf_dir), "lo_partkey", "p_partkey", ["p_brand1"], "p_category = 'MFGR#21'")
    return R.group_sums(fact, ["p_brand1"], "lo_revenue")


@query("SELECT c_custkey, (c_custkey - 7) - 100 * CAST(floor((c_custkey - 7) / 100.0) AS BIGINT) AS slot FROM customer")
def join_direct_address(spark, sf_dir):
    return R.direct_address(ssb.table(spark, sf_dir, "customer"), "c_custkey", 7, 100).select("c_custkey", "slot")


@query("""SELECT p_category, count(*) AS n_rows, CAST(sum(lo_revenue) AS BIGINT) AS total FROM lineorder
  JOIN ssb_part ON lo_partkey = p_partkey GROUP BY 1""", star=True)
def join_direct_address_probe(spark, sf_dir):
    fact = ssb.lineorder(spark, sf_dir, cost=False)
    rows = R.direct_probe(fact, ssb.part(spark, sf_dir), "lo_partkey", "p_partkey", 1, 1024, ["p_category"])
    return rows.groupBy("p_category").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("lo_revenue").alias("total"))


@query("""SELECT c_nation, d_year, CAST(sum(lo_revenue) AS BIGINT) AS total FROM lineorder JOIN ssb_customer ON lo_custkey = c_custkey
  JOIN ssb_supplier ON lo_suppkey = s_suppkey JOIN ssb_part ON lo_partkey = p_partkey JOIN ssb_date ON lo_orderdate = d_datekey
  WHERE s_region = 'ASIA' AND p_mfgr = 'MFGR#2' GROUP BY ALL""", star=True)
def join_named_dimensions(spark, sf_dir):
    fact = ssb.with_supplier(ssb.lineorder(spark, sf_dir, cost=False), ssb.supplier(spark, sf_dir), "s_region = 'ASIA'")
    fact = ssb.with_part(fact, ssb.part(spark, sf_dir), "p_mfgr = 'MFGR#2'")
    fact = ssb.with_customer(fact, ssb.customer(spark, sf_dir), payload=["c_nation"])
    return ssb.with_date_parts(fact).groupBy("c_nation", "d_year").agg(F.sum("lo_revenue").alias("total"))


@query("""SELECT s_nation, CAST(sum(lo_revenue) AS BIGINT) AS total, count(*) AS n_rows FROM lineorder
  JOIN ssb_supplier ON lo_suppkey = s_suppkey WHERE lo_orderdate BETWEEN 19960101 AND 19961231 GROUP BY 1""", star=True)
def join_fused_decode_probe(spark, sf_dir):
    from ..operators import store
    from .ssb import encoded_fact

    blocks = encoded_fact(spark, sf_dir)
    fact = store.scan(blocks, ["lo_suppkey", "lo_revenue"], {"lo_orderdate": (19960101, 19961231)})
    return R.group_sums(R.probe(fact, ssb.supplier(spark, sf_dir), "lo_suppkey", "s_suppkey", ["s_nation"]), ["s_nation"], "lo_revenue")


@query("""SELECT d_datekey, d_year, d_yearmonthnum, d_weeknuminyear FROM ssb_date""", star=True)
def join_date_cache(spark, sf_dir):
    keys = ssb.orders_with_dates(spark, sf_dir).select("lo_orderdate").distinct()
    return ssb.with_date_parts(keys).selectExpr("cast(lo_orderdate as bigint) as d_datekey", *ssb.DATE_PARTS)


@query("SELECT count(*) AS n_rows, CAST(sum(lo_orderdate // 10000) AS BIGINT) AS year_sum FROM lineorder", star=True)
def join_date_arithmetic(spark, sf_dir):
    return ssb.lineorder(spark, sf_dir, cost=False).selectExpr("lo_orderdate div 10000 as y").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("year_sum"))


def join_hash_functions(spark, sf_dir):
    return R.hashes(ssb.table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "murmur3", "xx64")


QUERIES["join_hash_functions"] = join_hash_functions


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS total, count(*) AS n_rows FROM lineitem WHERE l_quantity < 25")
def agg_sum_count(spark, sf_dir):
    return _lines(spark, sf_dir).filter("l_quantity < 25").agg(
        F.sum("l_linenumber").alias("total"), F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS total,
  count(*) AS n_rows FROM lineitem GROUP BY ALL""")
def agg_group_sum_count(spark, sf_dir):
    return R.group_sums(_lines(spark, sf_dir), ["l_returnflag", "l_linestatus"],
                        "cast(round(l_extendedprice * 100) as bigint)")


@query("SELECT CAST(sum(lo_extendedprice * lo_discount) AS BIGINT) AS revenue FROM lineorder WHERE lo_discount > 3", star=True)
def agg_filtered_revenue(spark, sf_dir):
    return ssb.lineorder(spark, sf_dir, cost=False).filter("lo_discount > 3").agg(
        F.sum(F.expr("lo_extendedprice * lo_discount")).alias("revenue"))


_PROFITS = """SELECT s_nation, p_category, CAST(sum(lo_revenue - lo_supplycost) AS BIGINT) AS total, count(*) AS n_rows
  FROM lineorder JOIN ssb_supplier ON lo_suppkey = s_suppkey JOIN ssb_part ON lo_partkey = p_partkey GROUP BY ALL"""


def _profits(spark, sf_dir):
    rows = R.probe_all(ssb.lineorder(spark, sf_dir), (ssb.supplier(spark, sf_dir), "lo_suppkey", "s_suppkey", ["s_nation"]),
                       (ssb.part(spark, sf_dir), "lo_partkey", "p_partkey", ["p_category"]))
    return R.group_sums(rows, ["s_nation", "p_category"], "lo_revenue - lo_supplycost")


@query(_PROFITS, star=True)
def agg_signed_profit(spark, sf_dir):
    return _profits(spark, sf_dir)


@query(f"""SELECT count(*) AS n_groups, count(*) FILTER (total <> 0) AS n_nonzero,
  CAST(sum(total) AS BIGINT) AS grand_total FROM ({_PROFITS})""", star=True)
def agg_totals(spark, sf_dir):
    return R.totals(_profits(spark, sf_dir))


@query("""SELECT o_orderkey // 512 AS pid, count(*) AS n, CAST(sum(o_orderkey % 512) AS BIGINT) AS sx,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS sy, CAST(sum((o_orderkey % 512) ** 2) AS BIGINT) AS sxx,
  CAST(sum((o_orderkey % 512) * CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS sxy FROM orders GROUP BY 1""")
def agg_regression_sums(spark, sf_dir):
    rows = ssb.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey div 512 as pid", "o_orderkey % 512 as x", "cast(round(o_totalprice * 100) as bigint) as y")
    return R.regression_sums(rows, "pid", "x", "y")


@query("""WITH n AS (SELECT count(*) AS n FROM orders GROUP BY o_orderkey // 512)
SELECT n, """ + ", ".join(f"(SELECT CAST(sum({' * '.join(['CAST(i AS HUGEINT)'] * k)}) AS BIGINT) FROM range(n) t(i)) AS s{k}" for k in range(1, 7)) + """
FROM n GROUP BY n""")
def agg_power_sums(spark, sf_dir):
    sizes = ssb.table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 512")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("n").distinct().select("n", *(F.expr(e).cast("long").alias(f"s{k}") for k, e in R.POWER_SUMS.items()))


@query("""SELECT event_id // 1024 AS pid, round(var_pop(user_id), 6) AS variance FROM events GROUP BY 1""")
def agg_variance(spark, sf_dir):
    return ssb.table(spark, sf_dir, "events").groupBy(F.expr("event_id div 1024").alias("pid")).agg(
        F.round(F.var_pop("user_id"), 6).alias("variance"))


@query("""SELECT count(*) FILTER (a.v IS DISTINCT FROM b.v) AS n_mismatch, count(*) AS n_rows FROM
  (SELECT o_orderkey AS k, o_custkey AS v FROM orders) a FULL JOIN
  (SELECT o_orderkey AS k, o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS v FROM orders) b USING (k)""")
def agg_mismatches(spark, sf_dir):
    a = ssb.table(spark, sf_dir, "orders").selectExpr("o_orderkey as pos", "o_custkey as value")
    b = a.withColumn("value", F.expr("value + if(pos % 50 = 0, 1, 0)"))
    return R.mismatches(a, b, "pos", "value")


def _strategy(name: str, strategy: str) -> None:
    from .ssb import QUERIES as STAR

    star = STAR[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return star.run(spark, sf_dir, strategy)

    QUERIES[f"{name}_{strategy}"] = run
    SQL[f"{name}_{strategy}"] = star.duck()


for _q in ("ssb_q1_1", "ssb_q2_1", "ssb_q3_1", "ssb_q4_3"):
    for _s in ("scan", "staged", "decoded", "bitpacked", "planned"):
        _strategy(_q, _s)

from .ssb import QUERIES as _STAR  # noqa: E402

for _q in _STAR:
    _strategy(_q, "encoded")
