"""Shared pieces of the training-data operators: scratch tables, text normal forms, ranks.

Intermediate tables live in the folder that ``spark.checkpoint.dir`` names, which every
executor can read, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space as the word rule ``[^\x20\x09-\x0D]+`` sees it.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that are sent to a Python worker at once; operators multiply them by a small factor.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Stands for a null identifier: sorts after every other one.
LAST_ID = 9223372036854775807


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, which the built-in lower() does not stop at."""
    return F.translate(text, UPPER, UPPER.lower())


def column(name: str) -> Column:
    """A top-level column by its plain name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is configured."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="residua-")
        sc.setCheckpointDir(folder)
    return folder


def packed(names: list[str] | tuple[str, ...]) -> Column:
    """Some columns as one, whatever their names; a struct needs a field at least."""
    return F.struct(*map(column, names)) if names else F.struct(F.lit(0).alias("_"))


def small_batches(spark: SparkSession) -> None:
    """Send less at once to Python workers than Spark does where nobody set a number."""
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "2m")


def cleaned(write: Callable) -> Callable:
    """Let Spark drop the shuffles behind a table as soon as it is written. Of the arguments
    the first DataFrame names the session."""
    @wraps(write)
    def run(*args):
        conf = next(x for x in args if isinstance(x, DataFrame)).sparkSession.conf
        before = conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            return write(*args)
        finally:
            conf.set(CLEANUP, before)

    return run


class Scratch:
    """Tables of one run under the shared folder. They go when dropped or when Python ends."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/residua-{label}-{uuid.uuid4().hex}"
        self._n = 0
        small_batches(spark)
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread: cuts the lineage, computes the rows once."""
        path = self.path(name)
        cleaned(lambda df: df.write.parquet(path))(df)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._residua_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self.delete(table._residua_path)

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.delete(self.root)
        except Exception:  # the session may be gone already, and the folder with it
            return


def ranked(
    scratch: Scratch, df: DataFrame, order: list[str], rank: str, by: str | None = None,
    size: str | None = None,
) -> DataFrame:
    """Add ``rank``: the 0-based place of each row in ``order``, counted within ``by``.

    With ``size`` it is the sum of that column over the rows before. No task holds a whole
    group: rows are dealt out by range, places inside a range come from their write order,
    and one small row per range (and ``by`` value) carries the offsets.
    """
    keys = ([by] if by else []) + order
    rows = scratch.keep(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_m", F.monotonically_increasing_id())
        .withColumn("_p", F.shiftrightunsigned("_m", 33)),
        rank,
    )
    grp = F.col(by) if by else F.lit(0)
    rows = rows.withColumn("_g", F.hash(grp.isNull(), grp) if by else F.lit(0))
    weight = F.sum(size) if size else F.count(F.lit(1))
    names = ["_p", "_g"] + ([by] if by else [])
    ranges = rows.groupBy(*names).agg(weight.alias("_w"), F.min("_m").alias("_lo"))
    before = Window.partitionBy(*([by] if by else [])).orderBy("_p").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranges = ranges.withColumn("_off", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    l, r = rows.alias("l"), ranges.alias("r")
    same = (F.col("l._p") == F.col("r._p")) & (F.col("l._g") == F.col("r._g"))
    if by:
        same &= F.col(f"l.{by}").eqNullSafe(F.col(f"r.{by}"))
    joined = l.join(r, same).select("l.*", "r._lo", "r._off")
    if size:
        inside = Window.partitionBy(*names).orderBy("_m").rowsBetween(
            Window.unboundedPreceding, -1
        )
        place = F.col("_off") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    else:
        place = F.col("_off") + F.col("_m") - F.col("_lo")
    return joined.withColumn(rank, place).drop("_m", "_p", "_g", "_lo", "_off")
