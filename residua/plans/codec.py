"""Queries over partitions, models, the codec and positional access, with their SQL.

What is packed has no SQL twin, so those queries return the decoded column, and the oracle
is the source column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import codec as C
from ..operators import partition as P
from ..sources import files, ssb
from ..sources.scratch import folder

QUERIES, SQL = {}, {}
CENTS = "SELECT o_orderkey AS pos, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ssb.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as pos", "cast(round(o_totalprice * 100) as bigint) as value")


def order_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ssb.table(spark, sf_dir, "orders").selectExpr("o_orderkey as pos", "o_custkey as value")


def event_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ssb.table(spark, sf_dir, "events").selectExpr("event_id as pos", "user_id as value")


_saved: dict[tuple, str] = {}


def saved(spark: SparkSession, sf_dir: str, rows, config: C.Config) -> DataFrame:
    """Encoded blocks of a column, written once per session as a column store would hold them."""
    key = spark.sparkContext.applicationId, sf_dir, rows.__name__, config
    if key not in _saved:
        path = f"{folder(spark)}/blocks"
        column = rows(spark, sf_dir)
        files.save_encoded(C.encode(column, "pos", "value", config), path, column.schema["value"].dataType.simpleString(), config)
        _saved[key] = path
    return files.load_encoded(spark, _saved[key])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in disorder, with repeats, some beyond the end."""
    return ssb.table(spark, sf_dir, "events").selectExpr("event_id as ordinal", "event_id * 7919 % 200000 as pos")


ASKED = "SELECT event_id AS ordinal, event_id * 7919 % 200000 AS pos FROM events"

# --- partitions and zone maps

_BOUNDS = f"""SELECT pos // 512 AS pid, min(pos) AS start, max(pos) + 1 AS "end", min(value) AS vmin, max(value) AS vmax
  FROM ({CENTS}) GROUP BY 1"""


@query(_BOUNDS)
def partition_bounds(spark, sf_dir):
    return P.bounds(cents(spark, sf_dir), "pos", "value", 512)


@query("""SELECT o_orderkey // 8 AS pid, min(o_custkey) AS vmin, max(o_custkey) AS vmax FROM orders GROUP BY 1
  HAVING max(o_custkey) >= 10 AND min(o_custkey) <= 20""")
def zone_map_candidates(spark, sf_dir):
    rows = ssb.table(spark, sf_dir, "orders").selectExpr("o_orderkey as pos", "o_custkey as value")
    return P.candidates(P.bounds(rows, "pos", "value", 8), 10, 20).select("pid", "vmin", "vmax")


@query("SELECT o_orderkey // 8 AS pid FROM orders GROUP BY 1 HAVING max(o_custkey) >= 77 AND min(o_custkey) <= 77")
def zone_map_value(spark, sf_dir):
    rows = ssb.table(spark, sf_dir, "orders").selectExpr("o_orderkey as pos", "o_custkey as value")
    return P.candidates_for(P.bounds(rows, "pos", "value", 8), 77).select("pid")


@query("""SELECT count(*) AS n_blocks, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM orders
  GROUP BY o_orderkey // 8 HAVING max(o_custkey) >= 10 AND min(o_custkey) <= 20)""")
def zone_map_rows(spark, sf_dir):
    rows = ssb.table(spark, sf_dir, "orders").selectExpr("o_orderkey as pos", "o_custkey as value")
    return P.candidate_rows(P.candidates(P.bounds(rows, "pos", "value", 8), 10, 20))


@query("SELECT o_orderkey AS pos FROM orders WHERE o_custkey BETWEEN 10 AND 20")
def pushdown_positions(spark, sf_dir):
    blocks = saved(spark, sf_dir, order_customers, C.Config.fixed(64))
    return C.decode_where(blocks, 10, 20).select("pos")


@query("SELECT o_orderkey AS pos FROM orders WHERE o_custkey BETWEEN 10 AND 20")
def pushdown_raw_positions(spark, sf_dir):
    rows = order_customers(spark, sf_dir)
    return P.pruned_positions(rows, P.bounds(rows, "pos", "value", 8), "pos", "value", 8, 10, 20)


@query("""WITH b AS (SELECT event_id // 1024 AS pid, round(var_pop(user_id), 4) AS variance, min(event_id) AS s,
  max(event_id) + 1 AS e FROM events GROUP BY 1),
c AS (SELECT quantile_disc(variance, [0.25, 0.5, 0.75]) AS q FROM b),
k AS (SELECT b.*, CAST(variance > q[1] AS INT) + CAST(variance > q[2] AS INT) + CAST(variance > q[3] AS INT) AS bucket FROM b, c)
SELECT pid, bucket, [512, 256, 128, 64][bucket + 1] AS size,
  CAST(ceil((e - s) / [512, 256, 128, 64][bucket + 1]) AS BIGINT) AS n_parts FROM k""")
def partition_by_variance(spark, sf_dir):
    rows = P.variance_buckets(event_users(spark, sf_dir), "pos", "value")
    return rows.select("pid", "bucket", "size", F.size("starts").cast("long").alias("n_parts"))


# --- models and sizes

_FIT = f"""
s AS (SELECT *, pos // 256 AS pid, pos % 256 AS i FROM ({CENTS})),
m AS (SELECT pid, count(*) AS n, CAST(sum(i) AS HUGEINT) AS sx, CAST(sum(value) AS HUGEINT) AS sy,
  CAST(sum(i * i) AS HUGEINT) AS sxx, CAST(sum(CAST(i AS HUGEINT) * value) AS HUGEINT) AS sxy FROM s GROUP BY pid),
t AS (SELECT *, CASE WHEN n * sxx = sx * sx THEN 0.0 ELSE CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) END AS slope FROM m),
u AS (SELECT *, (CAST(sy AS DOUBLE) - slope * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE) AS intercept FROM t),
r AS (SELECT s.pid, pos, value - CAST(round_even(intercept + slope * i, 0) AS BIGINT) AS residual FROM s JOIN u USING (pid))"""
_BITS = "CASE WHEN max(abs(residual)) = 0 THEN 0 ELSE length(bin(max(abs(residual)))) + {} END"


@query(f"WITH {_FIT} SELECT pid, count(*) AS n, max(abs(residual)) AS max_residual, CAST({_BITS.format(1)} AS INT) AS bits FROM r GROUP BY pid")
def linear_fit_bits(spark, sf_dir):
    rows = P.linear_residuals(P.with_pid(cents(spark, sf_dir), "pos", 256), "pos", "value")
    return P.residual_bits(rows).select("pid", "n", "max_residual", "bits")


@query(f"WITH {_FIT} SELECT pid, min(residual) AS lo, max(residual) AS hi, length(bin(max(residual) - min(residual))) AS rebased_bits FROM r GROUP BY pid")
def residual_range(spark, sf_dir):
    rows = P.linear_residuals(P.with_pid(cents(spark, sf_dir), "pos", 256), "pos", "value")
    bits = P.bit_length(F.col("hi") - F.col("lo"))
    return P.residual_bits(rows).select("pid", "lo", "hi", bits.alias("rebased_bits"))


@query(f"""WITH {_FIT}, d AS (SELECT pid, CAST({_BITS.format(2)} AS INT) AS bits FROM r GROUP BY pid),
b AS (SELECT *, coalesce(abs(bits - lag(bits) OVER (ORDER BY pid)) >= 1, true) AS is_break FROM d)
SELECT pid, bits, is_break, CAST(sum(CAST(is_break AS INT)) OVER (ORDER BY pid) - 1 AS BIGINT) AS segment FROM b""")
def breakpoints(spark, sf_dir):
    rows = P.linear_residuals(P.with_pid(cents(spark, sf_dir), "pos", 256), "pos", "value")
    return P.breakpoints(P.residual_bits(rows, 2), 1).select("pid", "bits", "is_break", "segment")


_SPIKES = "SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 256 > 250 THEN 1000 + o_custkey % 9 ELSE 0 END AS value FROM orders"


@query(f"WITH {_FIT.replace(CENTS, _SPIKES).replace('value - CAST(round_even(intercept + slope * i, 0) AS BIGINT)', 'value - greatest(CAST(round_even(intercept + slope * i, 0) AS BIGINT), 0)')} SELECT pid, min(residual) AS lo, max(residual) AS hi FROM r GROUP BY pid")
def clamped_residual_range(spark, sf_dir):
    rows = ssb.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as pos", "if(o_orderkey % 256 > 250, 1000 + o_custkey % 9, 0) as value")
    rows = P.linear_residuals(P.with_pid(rows, "pos", 256), "pos", "value", clamp=True)
    return P.residual_bits(rows).select("pid", "lo", "hi")


_PAIR = f"""
base AS (SELECT pos // 256 AS pid, pos, value FROM ({CENTS})),
g AS (SELECT 2 * pid AS gid, * FROM base UNION ALL SELECT 2 * pid + 1, * FROM base
      UNION ALL SELECT 2 * (pid - 1) + 1, * FROM base WHERE pid > 0),
h AS (SELECT *, pos - min(pos) OVER (PARTITION BY gid) AS i FROM g),
m AS (SELECT gid, count(*) AS n, CAST(sum(i) AS HUGEINT) AS sx, CAST(sum(value) AS HUGEINT) AS sy,
  CAST(sum(i * i) AS HUGEINT) AS sxx, CAST(sum(CAST(i AS HUGEINT) * value) AS HUGEINT) AS sxy FROM h GROUP BY gid),
t AS (SELECT *, CASE WHEN n * sxx = sx * sx THEN 0.0 ELSE CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) END AS slope FROM m),
u AS (SELECT *, (CAST(sy AS DOUBLE) - slope * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE) AS intercept FROM t),
r AS (SELECT h.gid, u.n, value - CAST(round_even(intercept + slope * i, 0) AS BIGINT) AS residual FROM h JOIN u USING (gid)),
c AS (SELECT gid, 64 + any_value(n) * ({_BITS.format(2)}) / 8.0 AS cost, any_value(n) AS n FROM r GROUP BY gid),
a AS (SELECT gid // 2 AS pid, least(cost, n * 8.0) AS cost FROM c WHERE gid % 2 = 0),
j AS (SELECT gid // 2 AS pid, cost AS merged FROM c WHERE gid % 2 = 1),
f AS (SELECT a.pid, a.cost + b.cost AS apart, merged, round((a.cost + b.cost - merged) / (a.cost + b.cost), 9) AS benefit
  FROM a JOIN a b ON b.pid = a.pid + 1 JOIN j ON j.pid = a.pid)"""


def _costs(spark, sf_dir):
    return P.merge_costs(cents(spark, sf_dir), "pos", "value", 256).withColumn("benefit", F.round("benefit", 9))


@query(f"WITH {_PAIR} SELECT pid, CAST(apart AS DOUBLE) AS apart, CAST(merged AS DOUBLE) AS merged, CAST(benefit AS DOUBLE) AS benefit FROM f")
def merge_costs(spark, sf_dir):
    return _costs(spark, sf_dir)


@query(f"WITH {_PAIR} SELECT pid, pid % 2 = 0 AND benefit >= 0.01 AS merge FROM f")
def merge_marks(spark, sf_dir):
    return P.mark_merges(_costs(spark, sf_dir), 0, 0.01).select("pid", "merge")


@query(f"""WITH s AS (SELECT *, pos // 256 AS pid FROM ({CENTS})),
b AS (SELECT pid, count(*) AS n, CASE WHEN max(value) = min(value) THEN 0 ELSE length(bin(max(value) - min(value))) END AS bits FROM s GROUP BY pid)
SELECT pid, bits, CAST(coalesce(sum(n * bits) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bit_offset FROM b""")
def frame_of_reference_offsets(spark, sf_dir):
    blocks = C.encode(cents(spark, sf_dir), "pos", "value", C.Config(strategy="FIXED", size=256, model="FOR"))
    return C.offsets(blocks).select(F.expr("start div 256").alias("pid"), "bits", "bit_offset")


@query("""WITH s AS (SELECT *, pos // 512 AS pid FROM (SELECT event_id AS pos, user_id AS value FROM events)),
d AS (SELECT *, value - lag(value) OVER (PARTITION BY pid ORDER BY pos) AS d FROM s),
z AS (SELECT pid, count(*) AS n, max(value) AS hi, min(value) AS lo, coalesce(max(d), 0) AS dhi, coalesce(min(d), 0) AS dlo,
  count(*) FILTER (d <> 0) + 1 AS n_runs FROM d GROUP BY pid)
SELECT pid, n, CASE WHEN lo < 0 THEN 64 WHEN hi = 0 THEN 0 ELSE length(bin(hi)) END AS ns,
  CASE WHEN hi = lo THEN 0 ELSE length(bin(hi - lo)) END AS for_ns,
  CASE WHEN dlo < 0 THEN 64 WHEN dhi = 0 THEN 0 ELSE length(bin(dhi)) END AS delta_ns,
  CASE WHEN dhi = dlo THEN 0 ELSE length(bin(dhi - dlo)) END AS delta_for_ns, n_runs FROM z""")
def baseline_encoding_bits(spark, sf_dir):
    return C.baseline_sizes(event_users(spark, sf_dir), "pos", "value", 512)


@query("""WITH s AS (SELECT o_orderkey AS pos, o_orderkey // 37 % 3 AS value FROM orders),
f AS (SELECT *, CASE WHEN lag(value) OVER (ORDER BY pos) IS DISTINCT FROM value THEN 1 ELSE 0 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (ORDER BY pos) AS run FROM f)
SELECT min(pos) AS start, count(*) AS length, min(value) AS value FROM g GROUP BY run""")
def run_lengths(spark, sf_dir):
    rows = ssb.table(spark, sf_dir, "orders").selectExpr("o_orderkey as pos", "o_orderkey div 37 % 3 as value")
    return C.runs(rows, "pos", "value")


@query("SELECT o_orderkey AS pos, o_orderkey // 37 % 3 AS value FROM orders")
def run_lengths_expanded(spark, sf_dir):
    return C.expand(run_lengths(spark, sf_dir))


# --- round trips

def _roundtrip(name: str, config: C.Config) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.decode(C.encode(cents(spark, sf_dir), "pos", "value", config))

    run.__name__ = f"codec_roundtrip_{name}"
    query(CENTS)(run)


for _name, _config in {
    "fixed": C.Config.fixed(), "cost_optimal": C.Config.cost_optimal(), "variance": C.Config.variance_adaptive(),
    "high_compression": C.Config.high_compression(), "greedy": C.Config(strategy="GREEDY"), "variance_cost": C.Config(strategy="VARIANCE_COST"),
    "linear": C.Config(strategy="FIXED", model="LINEAR"), "poly2": C.Config(strategy="FIXED", model="POLY2"),
    "poly3": C.Config(strategy="FIXED", model="POLY3"), "frame": C.Config(strategy="FIXED", model="FOR"),
    "direct": C.Config(strategy="FIXED", model="DIRECT"), "null_suppression": C.Config(strategy="FIXED", model="NS"),
    "delta": C.Config(strategy="FIXED", model="DELTA"), "runs": C.Config(strategy="FIXED", model="RLE"),
    "planned": C.Config(strategy="FIXED", model="PLANNED"),
}.items():
    _roundtrip(_name, _config)


@query("SELECT event_id AS pos, CAST(18446744073709551615 - event_id * 1000003 AS VARCHAR) AS value FROM events")
def codec_roundtrip_unsigned(spark, sf_dir):
    rows = ssb.table(spark, sf_dir, "events").selectExpr(
        "event_id as pos", "cast(18446744073709551615BD - event_id * 1000003 as decimal(20,0)) as value")
    return C.decode(C.encode(rows, "pos", "value"), C.UNSIGNED).withColumn("value", F.col("value").cast("string"))


@query("SELECT 0 AS n_mismatch, count(*) AS n_rows FROM orders")
def codec_verify(spark, sf_dir):
    rows = cents(spark, sf_dir)
    return C.verify(rows, C.encode(rows, "pos", "value"), "pos", "value")


@query("SELECT 0 AS n_problems, 0 AS first_start, (SELECT max(o_orderkey) + 1 FROM orders) AS last_end")
def codec_block_rules(spark, sf_dir):
    blocks = C.encode(cents(spark, sf_dir), "pos", "value")
    return C.block_rules(blocks)


@query("SELECT o_orderkey AS pos, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders WHERE o_orderkey // 512 IN (1, 4)")
def codec_decode_blocks(spark, sf_dir):
    blocks = C.encode(cents(spark, sf_dir), "pos", "value", C.Config.fixed(512))
    return C.decode_blocks(blocks, blocks.filter("start in (512, 2048)"))


@query()
def codec_statistics(spark, sf_dir):
    return C.statistics(C.encode(cents(spark, sf_dir), "pos", "value"))


@query()
def codec_models_chosen(spark, sf_dir):
    blocks = C.encode(cents(spark, sf_dir), "pos", "value", C.Config.high_compression())
    return blocks.groupBy("model").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.col("end") - F.col("start")).alias("n_rows"))


@query("SELECT n AS n_rows, count(*) AS n_blocks FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey // 2048) GROUP BY n")
def codec_segment_sizes(spark, sf_dir):
    blocks = C.encode(cents(spark, sf_dir), "pos", "value", C.Config.fixed(2048))
    return C.segment_sizes(blocks)


# --- what the codec chose

_WIDE = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END"
_FRAMES = f"""b AS (SELECT pos // 512 AS pid, count(*) AS n, max(value) AS hi, min(value) AS lo FROM c GROUP BY 1),
d AS (SELECT pid, n, CASE WHEN hi = lo THEN 'CONSTANT' ELSE 'FOR' END AS model, {_WIDE.format("(hi - lo)")} AS bits, lo AS base FROM b)"""
_STAIRS = "SELECT o_orderkey AS pos, o_orderkey // 1500 * 1000 + CASE WHEN o_orderkey % 3000 < 1500 THEN 0 ELSE o_custkey % 90 END AS value FROM orders"


def stairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of one value and stretches of noise in turn."""
    return ssb.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as pos", "o_orderkey div 1500 * 1000 + if(o_orderkey % 3000 < 1500, 0, o_custkey % 90) as value")


@query(f"WITH c AS ({_STAIRS}), {_FRAMES} SELECT pid, n, model, bits, base FROM d")
def codec_frame_or_constant(spark, sf_dir):
    blocks = C.encode(stairs(spark, sf_dir), "pos", "value", C.Config(strategy="FIXED", size=512, degree=0))
    return blocks.select(F.expr("start div 512").alias("pid"), (F.col("end") - F.col("start")).alias("n"), "model",
                         F.col("bits").cast("long").alias("bits"), "base")


@query(f"""WITH c AS ({_STAIRS}), {_FRAMES} SELECT CAST(sum(n) * 8 AS BIGINT) AS raw_bytes,
  CAST(sum((n * bits + 31) // 32 * 4) AS BIGINT) AS packed_bytes,
  round(sum(n) * 8 / (sum((n * bits + 31) // 32 * 4) + 64 * count(*)), 9) AS ratio, count(*) AS n_blocks,
  round(sum(n * bits) / sum(n), 9) AS mean_bits FROM d""")
def codec_frame_statistics(spark, sf_dir):
    blocks = C.encode(stairs(spark, sf_dir), "pos", "value", C.Config(strategy="FIXED", size=512, degree=0))
    return C.statistics(blocks).withColumns({c: F.round(c, 9) for c in ("ratio", "mean_bits")})


_SHAPES = "SELECT o_orderkey AS pos, CASE o_orderkey // 4096 % 3 WHEN 0 THEN o_orderkey * 50 + o_custkey % 7 WHEN 1 THEN o_custkey ELSE 17 END AS value FROM orders"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, noise and constants in turn."""
    return ssb.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as pos", "case o_orderkey div 4096 % 3 when 0 then o_orderkey * 50 + o_custkey % 7 when 1 then o_custkey else 17 end as value")


@query(f"""WITH c AS ({_SHAPES}), s AS (SELECT *, pos // 512 AS pid, pos % 512 - CASE WHEN pos // 512 = 0 THEN (SELECT min(pos) FROM c) ELSE 0 END AS i FROM c),
m AS (SELECT pid, count(*) AS n, max(value) AS hi, min(value) AS lo, regr_slope(value, i) AS k, regr_intercept(value, i) AS y FROM s GROUP BY pid),
r AS (SELECT s.pid, max(value - round_even(y + k * i, 0)) - min(value - round_even(y + k * i, 0)) AS w FROM s JOIN m USING (pid) GROUP BY s.pid),
z AS (SELECT pid, 8 + n * {_WIDE.format("(hi - lo)")} / 8 AS frame, 16 + n * {_WIDE.format("CAST(w AS BIGINT)")} / 8 AS line, hi = lo AS flat FROM m JOIN r USING (pid))
SELECT pid, CASE WHEN flat THEN 'CONSTANT' WHEN line < 0.95 * frame THEN 'LINEAR' ELSE 'FOR' END AS model FROM z""")
def codec_adaptive_choice(spark, sf_dir):
    blocks = C.encode(shapes(spark, sf_dir), "pos", "value", C.Config.fixed(512))
    return blocks.select(F.expr("start div 512").alias("pid"), "model")


@query(f"""WITH s AS (SELECT *, pos // 512 AS pid FROM ({_STAIRS})),
e AS (SELECT *, value - lag(value) OVER w AS d, CASE WHEN lag(value) OVER w IS DISTINCT FROM value THEN 1 ELSE 0 END AS f FROM s WINDOW w AS (PARTITION BY pid ORDER BY pos)),
g AS (SELECT *, sum(f) OVER (PARTITION BY pid ORDER BY pos) AS run FROM e),
l AS (SELECT pid, max(k) AS longest FROM (SELECT pid, run, count(*) AS k FROM g GROUP BY ALL) GROUP BY pid),
z AS (SELECT pid, count(*) AS n, max(value) AS hi, min(value) AS lo, coalesce(max(d), 0) AS dhi, coalesce(min(d), 0) AS dlo, max(run) AS runs FROM g GROUP BY pid),
k AS (SELECT pid, n * {_WIDE.format("hi")} AS ns, 64 + n * {_WIDE.format("(hi - lo)")} AS fr,
  128 + (n - 1) * {_WIDE.format("(dhi - dlo)")} AS de, 128 + runs * ({_WIDE.format("(hi - lo)")} + {_WIDE.format("longest")}) AS rl FROM z JOIN l USING (pid))
SELECT pid, CASE least(ns, fr, de, rl) WHEN ns THEN 'NS' WHEN fr THEN 'FOR' WHEN de THEN 'DELTA' ELSE 'RLE' END AS encoding FROM k""")
def codec_planned_choice(spark, sf_dir):
    blocks = C.encode(stairs(spark, sf_dir), "pos", "value", C.Config(strategy="FIXED", size=512, model="PLANNED"))
    return blocks.select(F.expr("start div 512").alias("pid"), F.col("model").alias("encoding"))


@query("SELECT name, n_rows, n_rows * 4 AS raw_bytes, true AS smaller FROM (SELECT unnest(['lo_custkey', 'lo_discount', 'lo_extendedprice', 'lo_orderdate', 'lo_partkey', 'lo_quantity', 'lo_revenue', 'lo_suppkey']) AS name), (SELECT count(*) AS n_rows FROM lineitem)")
def codec_fact_sizes(spark, sf_dir):
    from ..operators import store
    from .ssb import FACT, encoded_fact

    sizes = store.sizes(encoded_fact(spark, sf_dir), FACT)
    return sizes.select("name", "n_rows", "raw_bytes", (F.col("packed_bytes") < F.col("raw_bytes")).alias("smaller"))


# --- access by position

_FETCH = f"SELECT ordinal, a.pos, value FROM ({ASKED}) a LEFT JOIN ({CENTS}) c ON a.pos = c.pos"


@query(_FETCH)
def access_many(spark, sf_dir):
    return A.fetch(cents(spark, sf_dir), requests(spark, sf_dir))


@query(_FETCH)
def access_encoded(spark, sf_dir):
    return A.fetch_encoded(saved(spark, sf_dir, cents, C.Config.fixed(512)), requests(spark, sf_dir))


@query(f"{_FETCH} WHERE c.pos IS NOT NULL")
def access_known_blocks(spark, sf_dir):
    blocks = saved(spark, sf_dir, cents, C.Config.fixed(512))
    asked = A.find_block(blocks, requests(spark, sf_dir)).filter("pid is not null")
    return A.fetch_known(blocks, asked)


@query(f"SELECT pos, value FROM ({CENTS}) WHERE pos >= 300 AND pos < 1100")
def access_range(spark, sf_dir):
    return A.fetch_range(saved(spark, sf_dir, cents, C.Config.fixed(512)), 300, 1100)


@query(f"SELECT ordinal, pos, CASE WHEN pos <= (SELECT max(o_orderkey) FROM orders) THEN pos // 512 END AS block FROM ({ASKED})")
def access_find_block(spark, sf_dir):
    blocks = saved(spark, sf_dir, cents, C.Config.fixed(512))
    starts = blocks.select("pid", F.expr("start div 512").alias("block"))
    return A.find_block(blocks, requests(spark, sf_dir)).join(starts, "pid", "left").select("ordinal", "pos", "block")


@query(f"{_FETCH} WHERE value > 30000000")
def access_with_predicate(spark, sf_dir):
    return A.fetch_where(cents(spark, sf_dir), requests(spark, sf_dir), "value > 30000000")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 400000")
def access_two_stage(spark, sf_dir):
    return A.two_stage(ssb.table(spark, sf_dir, "orders"), "o_totalprice > 400000", "o_orderkey", ["o_custkey", "o_orderstatus"])


@query(f"SELECT pos // 512 AS pid, count(*) AS n_requests, count(DISTINCT pos) AS n_positions FROM ({ASKED}) GROUP BY 1")
def access_lookup_table(spark, sf_dir):
    return A.lookup_table(requests(spark, sf_dir), 512)


@query(_FETCH)
def access_sorted(spark, sf_dir):
    return A.fetch_sorted(cents(spark, sf_dir), requests(spark, sf_dir))


@query(f"""SELECT ordinal, a.pos, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_custkey AS customer
  FROM ({ASKED}) a LEFT JOIN orders ON a.pos = o_orderkey""")
def access_columns(spark, sf_dir):
    columns = {
        name: A.EncodedColumn(saved(spark, sf_dir, rows, C.Config.fixed(512)))
        for name, rows in (("cents", cents), ("customer", order_customers))
    }
    return A.fetch_columns(columns, requests(spark, sf_dir))


@query("SELECT o_orderkey AS pos, o_custkey AS value FROM orders WHERE o_custkey BETWEEN 30 AND 40 AND o_orderkey >= 200 AND o_orderkey < 1200")
def access_part_and_range(spark, sf_dir):
    column = A.EncodedColumn(saved(spark, sf_dir, order_customers, C.Config.fixed(64)))
    return column.between(30, 40).join(column.part(200, 1200).select("pos"), "pos", "left_semi")
