"""Empty columns, nulls, gaps, ends, and that strategies agree."""

import pytest
from pyspark.sql import functions as F

from residua.functions import strings as S
from residua.operators import access as A
from residua.operators import codec as C
from residua.operators import partition as P
from residua.operators import store
from residua.plans import ssb as star
from residua.sources import files


def column(spark, values, kind="long"):
    return spark.createDataFrame(list(enumerate(values)), f"pos long, value {kind}")


@pytest.mark.parametrize("name", sorted(star.QUERIES))
def test_strategies_agree(spark, sf_dir, name):
    results = [sorted(map(tuple, star.QUERIES[name].run(spark, sf_dir, s).collect())) for s in star.STRATEGIES]
    assert all(r == results[0] for r in results[1:])


def test_pushdown_reaches_the_scan(spark, sf_dir):
    plan = star.QUERIES["ssb_q1_1"].run(spark, sf_dir)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThanOrEqual(l_quantity" in plan


@pytest.mark.parametrize("config", [C.Config.fixed(8), C.Config.cost_optimal(), C.Config.variance_adaptive()])
def test_empty_and_single(spark, config):
    empty = column(spark, [])
    assert C.encode(empty, "pos", "value", config).count() == 0
    assert C.decode(C.encode(empty, "pos", "value", config)).count() == 0
    one = column(spark, [-7])
    assert C.decode(C.encode(one, "pos", "value", config)).collect() == one.collect()


def test_stretches_and_block_rules(spark):
    n = 2 * C.STRETCH + 100
    rows = spark.range(n).selectExpr("id as pos", "id * id % 1000 as value")
    blocks = C.encode(rows, "pos", "value", C.Config.fixed(2048))
    assert C.problems(blocks).count() == 0
    assert C.verify(rows, blocks, "pos", "value").first() == (0, n)
    sizes = C.offsets(blocks).orderBy("start").collect()
    total = 0
    for r in sizes:
        assert r.bit_offset == total
        total += (r.end - r.start) * r.bits


def test_nulls_gaps_and_types_are_refused(spark):
    with pytest.raises(Exception, match="null"):
        C.encode(column(spark, [1, None]), "pos", "value").count()
    with pytest.raises(Exception, match="gaps"):
        C.encode(column(spark, [1, 2, 3]).filter("pos <> 1"), "pos", "value").collect()
    with pytest.raises(TypeError):
        C.encode(column(spark, [1.5], "double"), "pos", "value")


@pytest.mark.parametrize("wanted", [
    f"pos < {2 * C.STRETCH - 6} or pos > {2 * C.STRETCH + 4}",  # a gap over the edge of a stretch
    f"pos < {C.STRETCH - 6} or pos >= {C.STRETCH}",  # the end of a stretch
    f"pos < {C.STRETCH} or pos >= {2 * C.STRETCH}",  # a whole stretch
    "pos >= 5", "pos <> 70000",
])
def test_gaps_anywhere_are_refused(spark, wanted):
    rows = spark.range(3 * C.STRETCH).selectExpr("id as pos", "id % 7 as value")
    with pytest.raises(ValueError, match="gaps"):
        C.encode(rows.filter(wanted), "pos", "value")


def test_repeats_are_refused(spark):
    rows = spark.createDataFrame([(0, 1), (1, 2), (1, 3), (3, 4)], "pos long, value long")
    with pytest.raises(Exception, match="repeats"):
        C.encode(rows, "pos", "value").collect()


@pytest.mark.parametrize("strategy", ["COST_OPTIMAL", "VARIANCE", "VARIANCE_COST", "GREEDY"])
def test_one_large_value_changes_no_strategy(spark, strategy):
    """Partitions are found for values of the whole range, not replaced by fixed ones."""
    import numpy as np

    i = np.arange(8192, dtype=np.int64)
    values = np.where(i < 4096, 3 * i, np.random.default_rng(1).integers(0, 1 << 20, 8192))
    far = values + np.where(i == 5000, 1 << 60, 0) + (1 << 62)
    config = C.Config(strategy=strategy)
    cuts = [config.cuts(C._relative(v)) for v in (far, far.astype(np.uint64) + np.uint64(1 << 63), far - (1 << 62))]
    assert cuts[0] == cuts[1] == cuts[2] and cuts[0] != C.Config.fixed().cuts(far)
    rows = column(spark, far.tolist())
    assert C.verify(rows, C.encode(rows, "pos", "value", config), "pos", "value").first() == (0, 8192)


def test_total_orders_take_a_row_per_span_only(spark):
    rows = spark.range(3 * C.SPAN // 1000).selectExpr("id * 1000 as start", "id * 1000 + 1000 as end", "int(id % 9) as bits", "id as pid")
    assert C.problems(rows).count() == 0
    broken = rows.filter("pid <> 5000").union(rows.filter("pid = 7000"))
    assert sorted(r.start for r in C.problems(broken).collect()) == [5_001_000, 7_000_000]
    ours = C.offsets(rows).filter("pid = 12000").first().bit_offset
    assert ours == sum(1000 * (i % 9) for i in range(12000))
    last = C.block_rules(rows).first()
    assert (last.n_problems, last.first_start, last.last_end) == (0, 0, 3 * C.SPAN // 1000 * 1000)


def test_long_runs_are_joined_and_expanded(spark):
    n = 4 * C.STRETCH + 17
    rows = spark.range(n).selectExpr("id as pos", f"if(id < 10 or id >= {3 * C.STRETCH + 5}, id % 2, 7) as value")
    runs = sorted((r.start, r.length, r.value) for r in C.runs(rows, "pos", "value").collect())
    assert (10, 3 * C.STRETCH - 5, 7) in runs and sum(r[1] for r in runs) == n
    back = C.expand(C.runs(rows, "pos", "value"))
    assert back.exceptAll(rows).count() == 0 and back.count() == n


def test_encoded_tables(spark):
    rows = spark.range(10_000).selectExpr("id as k", "id * 3 - 7 as a", "id % 11 as b", "9 as c").repartition(3)
    for model in (None, "FOR", "PLANNED", "DIRECT"):
        blocks = store.encode_table(rows, ["k", "a", "b", "c"], ["k"], 512, model)
        got = store.scan(blocks, ["k", "a", "b", "c"])
        assert got.exceptAll(rows.selectExpr("k", "a", "b", "cast(c as long) as c")).count() == 0 and got.count() == 10_000
        some = store.scan(blocks, ["b", "k"], {"a": (0, 300), "b": (3, 5)})
        want = rows.filter("a between 0 and 300 and b between 3 and 5").select("b", "k")
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, want.collect()))
        assert store.scan(blocks, ["k"], {"a": (1 << 40, 1 << 41)}).count() == 0
    assert store.blocks_where(blocks, {"k": (0, 100)}).count() < blocks.count()
    with pytest.raises(Exception, match="null"):
        store.encode_table(rows.withColumn("a", F.lit(None)), ["a"], ["k"]).collect()
    assert store.scan(store.encode_table(rows.limit(0), ["a"], ["a"]), ["a"]).count() == 0


def test_encoded_scans_read_the_columns_they_need(spark, sf_dir):
    query = star.QUERIES["ssb_q1_1"].run(spark, sf_dir, "encoded")._jdf.queryExecution()
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(query, "formatted")
    assert "GreaterThanOrEqual(lo_orderdate.vmax,19960101)" in plan and "lo_custkey" not in plan


@pytest.mark.parametrize("words", [["a", "bc", "", "äöü" * 5], ["word" * k for k in range(9)], ["", ""], ["x" * 64]])
def test_wide_strings_come_back(spark, words):
    rows = column(spark, words, "string")
    assert sorted(S.decompress(*S.compress(rows, "pos", "value")).collect()) == sorted(rows.collect())


def test_wide_codes_keep_nulls_and_order(spark):
    words = ["pear", "peach" * 4, "plum", "p", "pz" * 9]
    config = S.auto_configure(column(spark, words, "string"), "value")
    rows = column(spark, [*words, None], "string").withColumn("code", S.encode_wide(config)("value"))
    back = rows.withColumn("back", S.decode_wide(config)("code", F.octet_length("value") - len(config.prefix)))
    got = back.collect()
    assert all(r.value == r.back for r in got) and got[-1].code is None
    assert [r.value for r in sorted(got[:-1], key=lambda r: r.code)] == sorted(words)


def test_base_codes_clamp_unknown_letters(spark):
    rows = column(spark, ["bad", "cab", "", "zoo", "a!a"], "string")
    letters = [97, 98, 99, 100]
    got = {r.value: r.code for r in rows.withColumn("code", S.encode_base(F.col("value"), letters, 3)).collect()}
    assert got == {"bad": 1 * 16 + 0 + 3, "cab": 2 * 16 + 1, "": 0, "zoo": 63, "a!a": 0}
    with pytest.raises(ValueError):
        S.encode_base(F.lit("a"), letters, 32)


def test_unsigned_values_beyond_signed(spark):
    from decimal import Decimal

    top = [Decimal((1 << 64) - 1 - i) for i in range(5)] + [Decimal(0)]
    rows = column(spark, top, "decimal(20,0)")
    assert sorted(C.decode(C.encode(rows, "pos", "value"), C.UNSIGNED).collect()) == sorted(rows.collect())


def test_positions_out_of_range_give_null(spark):
    rows = column(spark, [10, 20, 30])
    blocks = C.encode(rows, "pos", "value", C.Config.fixed(2))
    asked = spark.createDataFrame([(0, 2), (1, 2), (2, 3), (3, -1), (4, 0)], "ordinal long, pos long")
    want = [(0, 2, 30), (1, 2, 30), (2, 3, None), (3, -1, None), (4, 0, 10)]
    assert sorted(map(tuple, A.fetch_encoded(blocks, asked).collect())) == want
    assert list(map(tuple, A.fetch_sorted(rows, asked).collect())) == want
    assert A.fetch_range(blocks, 1, 9).count() == 2 and A.fetch_range(blocks, 5, 9).count() == 0


def test_zone_map_without_bounds_keeps_the_block(spark):
    blocks = P.bounds(column(spark, [None, None, 5, 6]), "pos", "value", 2)
    assert P.candidates(blocks, 100, 200).count() == 1


def test_runs_join_over_stretches(spark):
    n = C.STRETCH + 10
    rows = spark.range(n).selectExpr("id as pos", "if(id < 5, null, 1) as value")
    got = sorted((r.start, r.length, r.value) for r in C.runs(rows, "pos", "value").collect())
    assert got == [(0, 5, None), (5, n - 5, 1)]


def test_strings(spark):
    frame = lambda *s: spark.createDataFrame([(x,) for x in s], "s string")
    assert S.common_prefix(frame("abc"), "s").first()[0] == "abc"
    assert S.common_prefix(frame("abc", "abd", ""), "s").first()[0] == ""
    assert S.common_prefix(frame(), "s").first()[0] == ""
    assert S.shift_bits(65, 65) == 1 and S.shift_bits(65, 68) == 2
    with pytest.raises(ValueError):
        S.StringConfig("", 0, 255, 8, 40).width
    words = frame("käse", "kä", "kat", "k", "kä z")
    config = S.auto_configure(words, "s")
    out = words.withColumn("code", S.encode_shift(F.col("s"), config)).withColumn(
        "back", S.decode_shift(F.col("code"), F.octet_length("s") - len(config.prefix), config))
    assert all(r.s == r.back for r in out.collect())
    assert S.reverse_host(F.lit("a@b.c")) is not None


def test_binary_columns(spark, tmp_path):
    import numpy as np

    v = np.arange(1000, dtype="<u4") * 3
    (tmp_path / "a.bin").write_bytes(v[:600].tobytes())
    (tmp_path / "b.bin").write_bytes((400).to_bytes(8, "little") + v[600:].tobytes())
    got = files.read_binary(spark, str(tmp_path), "uint32", expected=1000)
    assert [r.value for r in got.orderBy("pos").collect()] == v.tolist()
    with pytest.raises(ValueError):
        files.read_binary(spark, str(tmp_path), "uint32", expected=999)
    info = files.dataset_info(spark, str(tmp_path), "uint32").first()
    assert (info.n_files, info.n_bytes, info.n_values) == (2, 4008, 1000)
    (tmp_path / "c.bin").write_bytes(b"12345")
    with pytest.raises(ValueError, match="no whole number"):
        files.read_binary(spark, str(tmp_path), "uint32")


@pytest.mark.parametrize("kind,n", [("uint32", 100_003), ("uint64", 50_000), ("int32", 7), ("int64", 1), ("uint32", 0)])
def test_a_large_binary_column_is_split(spark, tmp_path, kind, n):
    import numpy as np

    dtype = files.TYPES[kind][0]
    v = (np.arange(n) * 40_503 - (5 if kind[0] == "i" else 0)).astype(dtype)
    if kind == "uint64" and n:
        v[-1] = (1 << 64) - 1
    (tmp_path / "x.bin").write_bytes(n.to_bytes(8, "little") + v.tobytes())
    got = files.read_column(spark, str(tmp_path / "x.bin"), kind).orderBy("pos").collect()
    assert [int(r.value) for r in got] == v.tolist() and [r.pos for r in got] == list(range(n))


@pytest.mark.parametrize("kind,n", [("uint32", 65_535), ("uint64", 65_538)])
def test_a_binary_column_of_a_prime_length_is_read(spark, tmp_path, kind, n):
    """Records are of one value then, shorter than the count of 32-bit values and as long as that
    of 64-bit ones; their batches hold many of them."""
    import numpy as np

    v = np.arange(n, dtype=files.TYPES[kind][0]) * 40_503
    (tmp_path / "x.bin").write_bytes(n.to_bytes(8, "little") + v.tobytes())
    length = (tmp_path / "x.bin").stat().st_size
    assert files._record(length, v.itemsize) == v.itemsize
    got = files.read_column(spark, str(tmp_path / "x.bin"), kind).orderBy("pos").collect()
    assert [int(r.value) for r in got] == v.tolist() and [r.pos for r in got] == list(range(n))


@pytest.mark.parametrize("kind,n,most,counted", [
    ("uint32", 5000, 700, (False, True)), ("uint64", 5000, 64, (False, True)), ("int64", 1000, 1 << 18, (False, True, False)),
    ("int32", 999, 10, (True,)), ("uint32", 1, 10, (False, True)), ("uint64", 0, 10, (False, True))])
def test_binary_columns_are_written_whole(spark, tmp_path, kind, n, most, counted):
    """Whatever the bytes are, and wherever the runs of tasks and the files are cut."""
    import numpy as np

    dtype, sql = files.TYPES[kind]
    v = np.random.default_rng(n).integers(np.iinfo(dtype).min, np.iinfo(dtype).max, n, dtype=dtype, endpoint=True)
    rows = spark.createDataFrame([(i, str(x)) for i, x in enumerate(v.tolist())][::-1], "pos long, value string")
    path = tmp_path / "x.bin"
    files.write_binary(rows.withColumn("value", F.col("value").cast(sql)), "pos", "value", str(path), kind, counted, most)
    assert sorted(p.name for p in path.iterdir() if p.name[0] != ".") == [f"{c}.bin" for c in "abc"[:len(counted)]]
    for i, head in enumerate(counted):
        part = v[n * i // len(counted):n * (i + 1) // len(counted)]
        assert (path / f"{'abc'[i]}.bin").read_bytes() == (len(part).to_bytes(8, "little") if head else b"") + part.tobytes()


@pytest.mark.parametrize("kind,bad", [("uint32", None), ("uint32", -1), ("uint32", 1 << 32), ("uint64", -1)])
def test_binary_columns_hold_what_fits(spark, tmp_path, kind, bad):
    with pytest.raises(Exception, match="null|[Ii]nteger value|out of bounds|range"):
        files.write_binary(column(spark, [1, bad, 3]), "pos", "value", str(tmp_path / "x.bin"), kind)


BOUNDED = """
import sys
sys.path.insert(0, sys.argv[1])
from residua import catalog
from residua.session import session
spark = session("bounded", "local[4]", **{
    "spark.driver.maxResultSize": "1m", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
    "spark.checkpoint.dir": sys.argv[2] + "/shared", "spark.sql.warehouse.dir": sys.argv[2] + "/warehouse"})
for name in sys.argv[3:]:
    catalog.queries()[name](spark, sys.argv[2]).write.parquet(sys.argv[2] + "/out/" + name)
"""


def test_binary_sources_do_not_pass_through_the_driver(tmp_path):
    """More orders than the driver takes in results."""
    import subprocess
    import sys
    from pathlib import Path

    import duckdb
    from residua import catalog

    names = ["source_binary_uint32", "source_binary_uint64", "source_dataset_info"]
    with duckdb.connect() as duck:
        duck.sql(f"""COPY (SELECT i * 7919 % 400000 AS o_orderkey, hash(i) % 50000000 / 100.0 AS o_totalprice
            FROM range(400000) t(i)) TO '{tmp_path}/orders.parquet'""")
        run = subprocess.run([sys.executable, "-c", BOUNDED, str(Path(__file__).resolve().parent.parent), str(tmp_path), *names],
                             capture_output=True, text=True, timeout=300)
        assert run.returncode == 0, "\n".join(x for x in run.stderr.split("\n") if not x.startswith("\tat "))[-3000:]
        duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
        for name in names:
            ours, theirs = f"SELECT * FROM '{tmp_path}/out/{name}/*.parquet'", f"SELECT * FROM ({catalog.oracle_sql()[name]})"
            assert duck.sql(f"({ours} EXCEPT ALL {theirs}) UNION ALL ({theirs} EXCEPT ALL {ours})").fetchall() == [], name


def test_the_cache_follows_its_column_and_config(spark, tmp_path):
    path, one, two = str(tmp_path / "cache"), column(spark, [1, 5, 9]), column(spark, [1, 5, 8])
    load = lambda rows, config: files.load_or_encode(spark, path, rows, "pos", "value", config)
    assert sorted(C.decode(load(one, C.Config.fixed(2))).collect()) == sorted(one.collect())
    assert load(one, C.Config.fixed(2)).count() == 2 and load(one, C.Config.fixed(8)).count() == 1
    assert sorted(C.decode(load(two, C.Config.fixed(8))).collect()) == sorted(two.collect())
    assert load(two, C.Config.fixed(8)).first().kind == "bigint"


def test_damaged_cache_is_noticed(spark, tmp_path):
    blocks = C.encode(column(spark, [1, 5, 9]), "pos", "value")
    files.save_encoded(blocks, str(tmp_path / "x"), "bigint")
    rows = spark.read.parquet(str(tmp_path / "x")).withColumn("checksum", F.lit(1).cast("long"))
    rows.write.parquet(str(tmp_path / "y"))
    with pytest.raises(Exception, match="damaged"):
        files.load_encoded(spark, str(tmp_path / "y")).collect()
