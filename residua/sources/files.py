"""Raw column files, caches of encoded columns, generators and result sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.codec import Config, encode

TYPES = {"uint32": ("<u4", "long"), "int32": ("<i4", "long"), "uint64": ("<u8", "decimal(20,0)"), "int64": ("<i8", "long")}
MAGIC, VERSION = "residua blocks", 2


def _listed(spark: SparkSession, path: str, width: int) -> list[tuple[str, int, int]]:
    """(file, length, bytes of header) of the files of a column, in the order of their names.
    The first eight bytes of each are read here, on the driver: a column has few files."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in fs.listStatus(top):
        name, length = status.getPath().getName(), status.getLen()
        if status.isDirectory() or name[0] in "._":
            continue
        header = 0
        if length >= 8:
            stream = fs.open(status.getPath())
            try:
                count = int.from_bytes((stream.readLong() & (1 << 64) - 1).to_bytes(8, "big"), "little")
            finally:
                stream.close()
            header = 8 if count * width + 8 == length else 0
        if (length - header) % width:
            raise ValueError(f"{name} has {length} bytes, no whole number of values of {width}")
        out.append((status.getPath().toString(), length, header))
    return sorted(out)


def _record(length: int, width: int, most: int = 1 << 18) -> int:
    """The largest number of bytes up to ``most`` that a file is a multiple of, in whole values."""
    values = length // width
    return width * next((d for d in range(min(values, most // width), 0, -1) if values % d == 0), 1)


def read_binary(spark: SparkSession, path: str, kind: str = "uint32", expected: int | None = None) -> DataFrame:
    """(pos, value) of headerless or counted binary columns: a file begins with its count of
    values exactly if 8 + count * width is its length. A column is a file or a folder of
    files, whose positions follow the order of their names. ``expected`` is the number of
    values there should be; another one raises an error.

    Files are read in records of a fixed number of bytes, which Spark splits among tasks, so a
    large file is many tasks; a record becomes values in Arrow batches."""
    dtype, sql = TYPES[kind]
    width = np.dtype(dtype).itemsize
    files = _listed(spark, path, width)
    total = sum((length - header) // width for _, length, header in files)
    if expected is not None and total != expected:
        raise ValueError(f"{path} holds {total} values, not {expected}")
    wide = sql.startswith("decimal")
    rows, first = [], 0
    for file, length, header in files:
        if length > header:
            record = _record(length, width)
            pairs = spark.sparkContext.newAPIHadoopFile(
                file.replace(",", "\\,"), "org.apache.spark.input.FixedLengthBinaryInputFormat",
                "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
                conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(record)})
            rows.append(spark.createDataFrame(pairs, "record long, content binary").select(
                (F.col("record") * record).alias("at"), F.lit(header).cast("long").alias("header"),
                F.lit(first).cast("long").alias("first"), "content"))
            first += (length - header) // width
    if not rows:
        return spark.createDataFrame([], f"pos long, value {sql}")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a file of an unlucky length has records of a value each: many of them make one batch
        for batch in batches:
            size = len(batch.column(3)[0].as_py()) if batch.num_rows else 1
            for i in range(0, batch.num_rows, step := max(1, (1 << 18) // size)):
                some = batch.slice(i, step)
                at, header, begin = (some.column(j).to_numpy()[:, None] for j in range(3))
                byte = at + np.arange(0, size, width)
                held = byte >= header
                v = np.frombuffer(b"".join(some.column(3).to_pylist()), dtype=dtype)[held.ravel()]
                pos = (begin + (byte - header) // width)[held]
                out = pa.array(v).cast(pa.decimal128(20, 0)) if wide else pa.array(v.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(pos), out], ["pos", "value"])

    return reduce(DataFrame.unionByName, rows).mapInArrow(values, f"pos long, value {sql}")


def read_text(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """Integers in text, parted by white space: (pos, value). Positions count
    through the files by name, their lines, and the places within a line; other words raise
    an error."""
    lines = spark.read.text(path).select(
        "value", F.monotonically_increasing_id().alias("line"),
        F.struct("_metadata.file_path", "_metadata.file_block_start").alias("part"))
    words = lines.select("part", "line", F.posexplode(
        F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).alias("at", "word")).filter("word <> ''")
    inside = Window.partitionBy("part").orderBy("line", "at")
    words = words.withColumn("i", F.row_number().over(inside) - 1)
    sizes = words.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return words.join(sizes, "part").select(
        (F.col("first") + F.col("i")).alias("pos"), F.col("word").cast(kind).alias("value"))


def read_column(spark: SparkSession, path: str, kind: str = "uint32") -> DataFrame:
    """Binary for names in .bin, text otherwise."""
    if path.rstrip("/").endswith(".bin"):
        return read_binary(spark, path, kind)
    return read_text(spark, path, TYPES[kind][1])


def dataset_info(spark: SparkSession, path: str, kind: str = "uint32") -> DataFrame:
    """Files, bytes and values of a binary column, from the listing and the headers alone."""
    width = np.dtype(TYPES[kind][0]).itemsize
    files = _listed(spark, path, width)
    row = (len(files), sum(n for _, n, _ in files), sum((n - h) // width for _, n, h in files), kind)
    return spark.createDataFrame([row], "n_files long, n_bytes long, n_values long, kind string")


def text_to_parquet(spark: SparkSession, source: str, target: str, kind: str = "uint32") -> None:
    """Text integers as a typed Parquet column."""
    read_text(spark, source, TYPES[kind][1]).write.mode("overwrite").parquet(target)


def save_encoded(blocks: DataFrame, path: str, kind: str, config: Config | None = None, content: str = "") -> None:
    """Blocks with the facts a reader needs to trust them: what they are, how and of what they
    were made."""
    blocks.select(
        "*", F.lit(MAGIC).alias("magic"), F.lit(VERSION).alias("version"), F.lit(kind).alias("kind"),
        F.lit(repr(config)).alias("config"), F.lit(content).alias("content"), F.crc32("payload").alias("checksum"),
    ).write.mode("overwrite").parquet(path)


def load_encoded(spark: SparkSession, path: str) -> DataFrame:
    """Blocks as they were saved, with the ``kind`` of their values; a wrong magic word, version
    or checksum raises an error."""
    rows = spark.read.parquet(path)
    sound = (F.col("magic") == MAGIC) & (F.col("version") == VERSION) & (F.crc32("payload") == F.col("checksum"))
    payload = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit(f"{path} is damaged")))
    return rows.withColumn("payload", payload).drop("magic", "version", "checksum", "config", "content")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load_or_encode(spark: SparkSession, path: str, df: DataFrame, pos: str, value: str, config: Config = Config()) -> DataFrame:
    """The cached blocks if they were made of this column in this way, or else those of the
    column, which are cached then. What the column holds is told by the number of its rows and
    a sum of their hashes, one scan without a shuffle of rows."""
    kind = df.schema[value].dataType.simpleString()
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(pos, value).cast("decimal(38,0)"))).first()
    content = f"{n} rows, {total}"
    if exists(spark, f"{path}/_SUCCESS"):
        held = spark.read.parquet(path).select("kind", "config", "content").first()
        if held is None and not n or held is not None and tuple(held) == (kind, repr(config), content):
            return load_encoded(spark, path)
    save_encoded(encode(df, pos, value, config), path, kind, config, content)
    return load_encoded(spark, path)


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """Lines without the white space at their ends; empty ones go."""
    return spark.read.text(path).select(F.rtrim(F.regexp_replace("value", r"[\r\n\t ]+$", "")).alias("s")).filter("s <> ''")


# --- generators

def cosmos(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Two sines and normal noise, in units of a millionth."""
    x = F.expr("(pos + 10) / (60 * pi())")
    wave = (F.sin(x) + 0.1 * F.sin(3 * x)) * 1e6
    return spark.range(n).select(F.col("id").alias("pos")).withColumn(
        "value", F.rint(wave + 100 * F.randn(seed)).cast("long"))


def _drawn(number: Column, salt: int) -> Column:
    """A number from 0 up to 1 that seems random, for each segment number and purpose; whole
    numbers of 31 bits stand behind it, so any engine draws the same."""
    return (F.pmod(number, F.lit(1_000_003)) * 1_103_515_245 + salt * 12_345_679) % (1 << 31) / float(1 << 31)


def _within(number: Column, salt: int, low: int, high: int) -> Column:
    """A drawn whole number from low to high."""
    return (low + F.floor(_drawn(number, salt) * (high - low + 1))).cast("long")


def _running(segments: DataFrame, size: Column, span: int = 4096) -> DataFrame:
    """Segments with ``base``, the sum of ``size`` over those before, put in order within spans
    of segments; of each span only a row takes part in the total order."""
    rows = segments.withColumn("_size", size).withColumn("_span", F.expr(f"segment div {span}"))
    sums = rows.groupBy("_span").agg(F.sum("_size").alias("_sum"))
    before = lambda w: F.coalesce(F.sum(w[0]).over(w[1].rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_span", before(("_sum", Window.orderBy("_span"))).alias("_before"))
    inside = before(("_size", Window.partitionBy("_span").orderBy("segment")))
    return rows.withColumn("_inside", inside).join(sums, "_span").withColumn(
        "base", F.col("_before") + F.col("_inside")).drop("_span", "_size", "_before", "_inside")


def _segments(spark: SparkSession, n: int, length: int) -> DataFrame:
    """Segments of ``length`` positions, the last one shorter, with their ``size``."""
    return spark.range(-(-n // length)).select(
        F.col("id").alias("segment"), F.least(F.lit(length), F.lit(n) - F.col("id") * length).alias("size"))


def _rows(spark: SparkSession, n: int, length: int, segments: DataFrame) -> DataFrame:
    """Positions with the local index ``i`` and ``u``, from 0 to 1 within their segment."""
    rows = spark.range(n).select(F.col("id").alias("pos"), F.expr(f"id div {length}").alias("segment"), F.expr(f"id % {length}").alias("i"))
    return rows.join(segments, "segment").withColumn("u", F.col("i") / F.greatest(F.col("size") - 1, F.lit(1)))


def polylog(spark: SparkSession, n: int, segment: int = 500, poly: tuple[int, int] = (50_000, 250_000),
            log: tuple[int, int] = (10_000, 120_000), gap: tuple[int, int] = (0, 50), seed: int = 0) -> DataFrame:
    """Segments that rise by a square and by a logarithm in turn, by drawn amounts, each from a
    drawn gap above where the one before ended."""
    parts = _segments(spark, n, segment)
    at = F.col("segment") + seed
    rise = F.when(F.col("segment") % 2 == 0, _within(at, 1, *poly)).otherwise(_within(at, 2, *log))
    parts = parts.withColumn("rise", F.when(F.col("size") > 1, rise).otherwise(F.lit(0)))
    parts = _running(parts, F.col("rise") + _within(at, 3, *gap))
    shape = F.when(F.col("segment") % 2 == 0, F.col("u") * F.col("u")).otherwise(
        F.log1p(F.col("i")) / F.log1p(F.greatest(F.col("size") - 1, F.lit(1))))
    return _rows(spark, n, segment, parts).select("pos", (F.col("base") + F.rint(F.col("rise") * shape).cast("long")).alias("value"))


def exponential(spark: SparkSession, n: int, block: int = 10_000, height: tuple[float, float] = (8.0, 13.0),
                curve: tuple[float, float] = (1.0, 12.0), gap: tuple[int, int] = (0, 1000), seed: int = 0) -> DataFrame:
    """Blocks that rise exponentially, by a drawn amount (a power of ten of ``height``) with a
    drawn curvature, each from a drawn gap above the one before."""
    between = lambda salt, x: x[0] + _drawn(F.col("segment") + seed, salt) * (x[1] - x[0])
    parts = _segments(spark, n, block).withColumns({
        "rise": F.rint(F.pow(F.lit(10.0), between(1, height))).cast("long"), "k": between(2, curve)})
    parts = parts.withColumn("rise", F.when(F.col("size") > 1, F.col("rise")).otherwise(F.lit(0)))
    parts = _running(parts, F.col("rise") + _within(F.col("segment") + seed, 3, *gap))
    share = (F.exp(F.col("k") * F.col("u")) - 1) / (F.exp("k") - 1)
    return _rows(spark, n, block, parts).select("pos", (F.col("base") + F.rint(share * F.col("rise")).cast("long")).alias("value"))


def cubic(spark: SparkSession, n: int, block: int = 10_000, start: int = 1_000_000_000, step: int = 50_000_000,
          steep: float = 0.25, bounds: tuple[int, int] = (0, 2_000_000_000), seed: int = 0) -> DataFrame:
    """Hermite cubics from knot to knot with drawn slopes, clamped to ``bounds``. Knots walk by
    drawn steps that stop at the bounds, one after the other in one task: a row per block."""
    low, high = bounds
    at = F.col("segment") + seed
    drawn = _segments(spark, n, block).select("segment", "size", _within(at, 1, -step, step).alias("step"),
                                              (_drawn(at, 2) * 2 - 1).alias("s0"), (_drawn(at, 3) * 2 - 1).alias("s1"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = start
        for batch in batches:
            ends = []
            for size, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                z = min(max(y + d, low), high) if size > 1 else y
                ends.append((y, z))
                y = z
            y0, y1 = (pa.array(c, pa.int64()) for c in zip(*ends)) if ends else (pa.array([], pa.int64()),) * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, y0, y1], [*batch.schema.names, "y0", "y1"])

    parts = drawn.repartition(1).sortWithinPartitions("segment").mapInArrow(
        walk, "segment long, size long, step long, s0 double, s1 double, y0 long, y1 long")
    u, most = F.col("u"), F.lit(step * steep)
    y = ((2 * u * u * u - 3 * u * u + 1) * F.col("y0") + (u * u * u - 2 * u * u + u) * (F.col("s0") * most)
         + (-2 * u * u * u + 3 * u * u) * F.col("y1") + (u * u * u - u * u) * (F.col("s1") * most))
    value = F.greatest(F.lit(low), F.least(F.lit(high), F.rint(y))).cast("long")
    return _rows(spark, n, block, parts).select("pos", value.alias("value"))


# --- sinks

def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def _slices(rows: DataFrame, pos: str, value: str, path: str, kind: str, most: int) -> None:
    """The packed values in the order of ``pos``, as parts of a folder by Spark's writer of text:
    runs of ``most`` values (the last of a part may be shorter), each with a byte after it."""
    dtype = np.dtype(TYPES[kind][0])
    whole, size = pa.from_numpy_dtype(dtype), most * dtype.itemsize

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()
        for batch in batches:
            if batch.column(0).null_count:
                raise ValueError("a binary column holds no null")
            held += batch.column(0).cast(whole).to_numpy(zero_copy_only=False).astype(dtype).tobytes()
            while len(held) >= size:
                yield pa.RecordBatch.from_arrays([pa.array([bytes(held[:size])])], ["content"])
                del held[:size]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(held)])], ["content"])

    at = F.col(pos).asc_nulls_last()
    ranges = rows.repartitionByRange(max(1, -(-rows.count() // most)), at).sortWithinPartitions(at)
    # a cast to string keeps bytes as they are
    ranges.select(value).mapInArrow(packed, "content binary").select(F.col("content").cast("string")).write.option(
        "compression", "none").mode("overwrite").text(path)


def write_binary(rows: DataFrame, pos: str, value: str, path: str, kind: str = "uint32",
                 counted: Sequence[bool] = (False,), most: int = 1 << 18) -> None:
    """``value`` in the order of ``pos`` as one binary file for each of ``counted``, a.bin, b.bin
    and so on, which share the values evenly; where True, the count comes first. Nulls and values
    that the kind has no room for raise an error.

    Tasks sort, check and pack ranges of ``most`` values or so. A file is one stream, so the
    driver's JVM strings the packed ranges together, of which it holds a buffer at a time."""
    sc, width = rows.sparkSession.sparkContext, np.dtype(TYPES[kind][0]).itemsize
    jvm = sc._jvm
    where = jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(sc._jsc.hadoopConfiguration())
    parts = f"{path}/_slices"
    _slices(rows, pos, value, parts, kind, most)
    found = {s.getPath().getName(): s.getLen() for s in fs.listStatus(where(parts)) if s.getPath().getName().startswith("part-")}
    # (part, where a run begins, its bytes)
    runs = [(name, at, min(most * width, found[name] - at - 1))
            for name in sorted(found, key=lambda n: (int(n.split("-")[1]), n))
            for at in range(0, found[name], most * width + 1)]
    n, begins = sum(size for _, _, size in runs) // width, 0
    cuts = [n * i // len(counted) * width for i in range(len(counted) + 1)]
    todo = iter(runs)
    name, at, size = next(todo, ("", 0, 0))
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        out = fs.create(where(f"{path}/{chr(ord('a') + i)}.bin"))
        try:
            if counted[i]:
                out.write(((high - low) // width).to_bytes(8, "little"))
            while low < high:
                if begins + size <= low:
                    begins += size
                    name, at, size = next(todo)
                take = min(begins + size, high) - low
                part = fs.open(where(f"{parts}/{name}"))
                try:
                    part.seek(at + low - begins)
                    jvm.org.apache.commons.io.IOUtils.copyLarge(part, out, 0, take)
                finally:
                    part.close()
                low += take
        finally:
            out.close()
    fs.delete(where(parts), True)

