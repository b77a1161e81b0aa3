"""Queries over strings, generators, files and the analysis functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import analysis as N
from ..functions import strings as S
from ..operators import codec as C
from ..sources import files, ssb
from ..sources.scratch import folder as _shared
from .codec import CENTS, cents, event_users

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _names(spark, sf_dir):
    return ssb.table(spark, sf_dir, "customer").selectExpr("c_custkey as pos", "c_name as value")


NAMES = "SELECT c_custkey AS pos, c_name AS value FROM customer"
MAIL = "lower(replace(p_name, ' ', '.')) || '@mail' || p_partkey % 7 || '.example.com'"


@query(f"""WITH n AS ({NAMES}), e AS (SELECT min(value) AS a, max(value) AS b FROM n)
SELECT substring(a, 1, CAST((SELECT count(*) FROM range(1, length(a) + 1) t(i) WHERE substring(a, 1, i) = substring(b, 1, i)) AS BIGINT)) AS prefix FROM e""")
def string_common_prefix(spark, sf_dir):
    return S.common_prefix(_names(spark, sf_dir), "value")


@query(f"SELECT min(ascii(c)) AS low, max(ascii(c)) AS high FROM (SELECT unnest(string_split(value, '')) AS c FROM ({NAMES}))")
def string_charset(spark, sf_dir):
    return S.charset(_names(spark, sf_dir), "value")


@query(f"""SELECT pos, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substring(value, 10), ''), lambda c: (ascii(c) - 48)::BIGINT)), lambda a, c: a * 16 + c) AS code FROM ({NAMES})""")
def string_shift_codes(spark, sf_dir):
    digits = S.StringConfig("Customer#", 48, 57, 4, 9)
    return _names(spark, sf_dir).select("pos", S.encode_shift(F.col("value"), digits).alias("code"))


@query(f"SELECT pos, CAST(substring(value, 10) AS BIGINT) AS code, value FROM ({NAMES})")
def string_base_codes(spark, sf_dir):
    rows = _names(spark, sf_dir).withColumn("digits", F.substring("value", 10, 9))
    letters = S.alphabet(rows, "digits")
    rows = rows.withColumn("code", S.encode_base(F.col("digits"), letters, 9))
    back = S.decode_base(F.col("code"), F.octet_length("digits"), letters, 9)
    return rows.select("pos", "code", F.concat(F.lit("Customer#"), back).alias("value"))


@query("SELECT p_partkey AS pos, p_name AS value FROM part")
def string_wide_roundtrip(spark, sf_dir):
    rows = ssb.table(spark, sf_dir, "part").selectExpr("p_partkey as pos", "p_name as value")
    config = S.auto_configure(rows, "value")
    coded = rows.select("pos", S.encode_wide(config)("value").alias("code"),
                        (F.octet_length("value") - len(config.prefix.encode())).alias("n"))
    return coded.select("pos", S.decode_wide(config)("code", "n").alias("value"))


@query("""SELECT c_custkey AS pos, rank() OVER (ORDER BY c_name) AS place FROM customer""")
def string_codes_keep_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = _names(spark, sf_dir)
    config = S.auto_configure(rows, "value")
    return rows.select("pos", S.encode_shift(F.col("value"), config).alias("code")).select(
        "pos", F.rank().over(Window.orderBy("code")).cast("long").alias("place"))


@query(NAMES)
def string_codec_roundtrip(spark, sf_dir):
    return S.decompress(*S.compress(_names(spark, sf_dir), "pos", "value"))


@query(f"SELECT event_id AS ordinal, event_id * 7919 % 3000 AS pos, c_name AS value FROM events LEFT JOIN customer ON c_custkey = event_id * 7919 % 3000")
def string_access(spark, sf_dir):
    asked = ssb.table(spark, sf_dir, "events").selectExpr("event_id as ordinal", "event_id * 7919 % 3000 as pos")
    return S.fetch_strings(*S.compress(_names(spark, sf_dir), "pos", "value"), asked)


def _parts(spark, sf_dir):
    return ssb.table(spark, sf_dir, "part").selectExpr("p_partkey as pos", "p_name as value")


@query("SELECT p_partkey AS pos, p_name AS value FROM part")
def string_codec_roundtrip_wide(spark, sf_dir):
    return S.decompress(*S.compress(_parts(spark, sf_dir), "pos", "value"))


@query("SELECT o_orderkey AS pos, o_orderpriority AS value FROM orders")
def string_codec_roundtrip_128(spark, sf_dir):
    rows = ssb.table(spark, sf_dir, "orders").selectExpr("o_orderkey as pos", "o_orderpriority as value")
    return S.decompress(*S.compress(rows, "pos", "value"))


@query("SELECT event_id AS ordinal, event_id * 7919 % 3000 AS pos, p_name AS value FROM events LEFT JOIN part ON p_partkey = event_id * 7919 % 3000")
def string_access_wide(spark, sf_dir):
    asked = ssb.table(spark, sf_dir, "events").selectExpr("event_id as ordinal", "event_id * 7919 % 3000 as pos")
    return S.fetch_strings(*S.compress(_parts(spark, sf_dir), "pos", "value"), asked)


@query("SELECT p_partkey AS pos, rank() OVER (ORDER BY p_name) AS place FROM part")
def string_wide_codes_keep_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = _parts(spark, sf_dir)
    code = S.encode_wide(S.auto_configure(rows, "value"))("value").alias("code")
    return rows.select("pos", code).select("pos", F.rank().over(Window.orderBy("code")).cast("long").alias("place"))


@query("SELECT n_nationkey AS pos, substring(n_name, 1, 8) AS value FROM nation")
def string_ascii_roundtrip(spark, sf_dir):
    rows = ssb.table(spark, sf_dir, "nation")
    return rows.select(F.col("n_nationkey").alias("pos"), S.decode_ascii(S.encode_ascii(F.col("n_name"))).alias("value"))


@query(f"""SELECT c_custkey AS pos, true AS inside FROM customer""")
def string_padding_bounds(spark, sf_dir):
    rows = _names(spark, sf_dir)
    config = S.auto_configure(rows, "value")
    low, high = S.padding_bounds(F.expr("substring(value, 1, length(value) - 2)"), config)
    return rows.select("pos", S.encode_shift(F.col("value"), config).between(low, high).alias("inside"))


@query(f"""SELECT p_partkey, array_to_string(list_reverse(string_split(split_part({MAIL}, '@', 2), '.')), '.') || '@' || split_part({MAIL}, '@', 1) AS reversed FROM part""")
def string_reverse_host(spark, sf_dir):
    rows = ssb.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{MAIL} as mail")
    return rows.select("p_partkey", S.reverse_host(F.col("mail")).alias("reversed"))


@query("SELECT p_partkey, lower(trim('  ' || p_name || ' ')) AS mail FROM part")
def string_normalize_address(spark, sf_dir):
    rows = ssb.table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('  ', p_name, ' ') as raw")
    return rows.select("p_partkey", S.normalize_address(F.col("raw")).alias("mail"))


# --- analysis

@query(f"""SELECT count(value) AS n, min(value) AS lowest, max(value) AS highest, round(avg(value), 6) AS mean,
  count(DISTINCT value) AS n_distinct FROM ({CENTS})""")
def analysis_basic(spark, sf_dir):
    return N.basic(cents(spark, sf_dir), "value")


@query("SELECT user_id AS value, count(*) AS n FROM events GROUP BY 1")
def analysis_value_counts(spark, sf_dir):
    return N.value_counts(event_users(spark, sf_dir), "value")


_STEP = f"(SELECT value - lag(value) OVER (ORDER BY pos) AS d FROM ({CENTS}))"


@query(f"SELECT count(d) AS n, min(d) AS lowest, max(d) AS highest, count(*) FILTER (d = 0) AS n_zero FROM {_STEP}")
def analysis_deltas(spark, sf_dir):
    return N.deltas(cents(spark, sf_dir), "pos", "value")


@query(f"SELECT count(*) FILTER (d >= 0) AS n_rising, count(*) FILTER (d < 0) AS n_falling FROM {_STEP}")
def analysis_sortedness(spark, sf_dir):
    return N.sortedness(cents(spark, sf_dir), "pos", "value")


@query("SELECT round(entropy(user_id), 6) AS entropy FROM events")
def analysis_entropy(spark, sf_dir):
    return N.entropy(event_users(spark, sf_dir), "value")


_SIZES = f"""SELECT count(*) AS n, CASE WHEN max(value) = min(value) THEN 0 ELSE length(bin(max(value) - min(value))) END AS w
  FROM ({CENTS}) GROUP BY pos // 2048"""


@query(f"SELECT CAST(sum(n * 8) AS BIGINT) AS raw_bytes, CAST(sum((n * w + 7) // 8 + 8) AS BIGINT) AS packed_bytes FROM ({_SIZES})")
def analysis_estimate(spark, sf_dir):
    return N.estimate(cents(spark, sf_dir), "pos", "value", 2048)


_ENDS = f"""(SELECT count(*) AS n, length(bin(max(value) - min(value))) AS frame_bits FROM ({CENTS})),
  (SELECT CASE WHEN min(d) >= 0 THEN length(bin(max(d))) ELSE length(bin(max(abs(d)))) + 1 END AS delta_bits FROM {_STEP})"""


@query(f"""SELECT n, n * 8 AS raw_bytes, frame_bits, 8 + n * frame_bits // 8 AS frame_bytes, delta_bits,
  8 + n * delta_bits // 8 AS delta_bytes FROM {_ENDS}""")
def analysis_limits(spark, sf_dir):
    return N.limits(cents(spark, sf_dir), "pos", "value")


@query("""WITH b AS (SELECT (user_id >> (8 * i)) & 255 AS byte FROM events, range(8) t(i)),
c AS (SELECT count(*) AS n FROM b GROUP BY byte), e AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM c)
SELECT round(e, 6) AS entropy, round(8 / e, 6) AS ratio FROM e""")
def analysis_byte_entropy(spark, sf_dir):
    return N.byte_entropy(event_users(spark, sf_dir), "value")


# --- sources and sinks


def _binary(spark, sf_dir, width: int) -> str:
    """A folder with the order prices as two binary files, one with its count before it, as a
    tool outside Spark would leave them."""
    path = f"{_shared(spark)}/binary{width}.bin"
    files.write_binary(cents(spark, sf_dir), "pos", "value", path, f"uint{8 * width}", counted=(False, True))
    return path


def _binary_source(name: str, width: int, kind: str) -> None:
    def run(spark, sf_dir):
        read = files.read_column(spark, _binary(spark, sf_dir, width), kind)
        return read.select("pos", F.col("value").cast("long").alias("value"))

    run.__name__ = name
    query(f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, value FROM ({CENTS})")(run)


_binary_source("source_binary_uint32", 4, "uint32")
_binary_source("source_binary_uint64", 8, "uint64")


@query("SELECT 2 AS n_files, count(*) * 4 + 8 AS n_bytes, count(*) AS n_values, 'uint32' AS kind FROM orders")
def source_dataset_info(spark, sf_dir):
    return files.dataset_info(spark, _binary(spark, sf_dir, 4), "uint32")


@query(CENTS)
def source_text_to_parquet(spark, sf_dir):
    path = _shared(spark)
    rows = cents(spark, sf_dir).repartitionByRange(4, "pos").sortWithinPartitions("pos")
    rows.select(F.col("value").cast("string")).write.text(f"{path}/text")
    files.text_to_parquet(spark, f"{path}/text", f"{path}/typed", "int64")
    return spark.read.parquet(f"{path}/typed")


@query("SELECT 'residua blocks' AS magic, 2 AS version, 'bigint' AS kind, count(*) AS n_blocks FROM (SELECT 1 FROM orders GROUP BY o_orderkey // 512)")
def source_header_facts(spark, sf_dir):
    path = f"{_shared(spark)}/blocks"
    files.load_or_encode(spark, path, cents(spark, sf_dir), "pos", "value", C.Config.fixed(512))
    return spark.read.parquet(path).groupBy("magic", "version", "kind").agg(F.count(F.lit(1)).alias("n_blocks"))

@query(CENTS)
def source_text_integers(spark, sf_dir):
    path = f"{_shared(spark)}/text"
    rows = cents(spark, sf_dir).repartitionByRange(4, "pos").sortWithinPartitions("pos")
    rows.select(F.col("value").cast("string")).write.text(path)
    return files.read_column(spark, path, "int64")


@query(CENTS)
def source_cached_blocks(spark, sf_dir):
    path = f"{_shared(spark)}/blocks"
    return C.decode(files.load_or_encode(spark, path, cents(spark, sf_dir), "pos", "value"))


@query("SELECT s_name AS s FROM supplier")
def source_strings(spark, sf_dir):
    path = f"{_shared(spark)}/strings"
    ssb.table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit("  "))).write.text(path)
    return files.read_strings(spark, path)


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def sink_json(spark, sf_dir):
    return files.as_json(ssb.table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS k, r_name AS v FROM region UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name FROM region")
def sink_csv(spark, sf_dir):
    path = f"{_shared(spark)}/csv"
    rows = ssb.table(spark, sf_dir, "region").selectExpr("r_regionkey as k", "r_name as v")
    for _ in range(2):
        files.append_csv(rows, path)
    return spark.read.option("header", True).csv(path)


def _generated(name: str, make) -> None:
    def run(spark, sf_dir):
        column = make(spark, 50_000)
        back = C.decode(C.encode(column, "pos", "value", C.Config(degree=3)))
        return column.join(back.withColumnRenamed("value", "back"), "pos").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") != F.col("back"), 1)).alias("n_mismatch"))

    run.__name__ = f"generator_{name}"
    query("SELECT 50000 AS n, 0 AS n_mismatch")(run)


for _name, _make in (("cosmos", files.cosmos), ("polylog", files.polylog), ("exponential", files.exponential), ("cubic", files.cubic)):
    _generated(_name, _make)

_U = "((({0}) % 1000003 * 1103515245 + {1} * 12345679) % 2147483648 / 2147483648.0::DOUBLE)"
_IN = "CAST({2} + floor(" + _U + " * ({3} - {2} + 1)) AS BIGINT)"


@query(f"""WITH s AS (SELECT i AS s, CASE WHEN i % 2 = 0 THEN {_IN.format("i", 1, 50000, 250000)} ELSE {_IN.format("i", 2, 10000, 120000)} END AS rise,
  {_IN.format("i", 3, 0, 50)} AS gap FROM range(60) t(i)),
b AS (SELECT s, rise, coalesce(sum(rise + gap) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s)
SELECT p AS pos, CAST(base + round_even(rise * CASE WHEN s % 2 = 0 THEN (p % 500 / 499.0::DOUBLE) * (p % 500 / 499.0::DOUBLE) ELSE ln(p % 500 + 1) / ln(500) END, 0) AS BIGINT) AS value
FROM range(30000) t(p) JOIN b ON s = p // 500""")
def generator_polylog_values(spark, sf_dir):
    return files.polylog(spark, 30_000)


@query(f"""WITH RECURSIVE d AS (SELECT i AS s, {_IN.format("i", 1, -50000000, 50000000)} AS step, {_U.format("i", 2)} * 2 - 1 AS s0, {_U.format("i", 3)} * 2 - 1 AS s1 FROM range(60) t(i)),
w AS (SELECT 0::BIGINT AS s, 1000000000::BIGINT AS y0, least(greatest(1000000000 + step, 0), 2000000000)::BIGINT AS y1 FROM d WHERE s = 0
  UNION ALL SELECT w.s + 1, w.y1, least(greatest(w.y1 + d.step, 0), 2000000000)::BIGINT FROM w JOIN d ON d.s = w.s + 1),
p AS (SELECT p AS pos, w.*, s0, s1, p % 500 / 499.0::DOUBLE AS u FROM range(30000) t(p) JOIN w ON w.s = p // 500 JOIN d ON d.s = w.s)
SELECT pos, CAST(least(greatest(round_even((2 * u * u * u - 3 * u * u + 1) * y0 + (u * u * u - 2 * u * u + u) * (s0 * 12500000.0::DOUBLE)
  + (-2 * u * u * u + 3 * u * u) * y1 + (u * u * u - u * u) * (s1 * 12500000.0::DOUBLE), 0), 0), 2000000000) AS BIGINT) AS value FROM p""")
def generator_cubic_values(spark, sf_dir):
    return files.cubic(spark, 30_000, block=500)
