"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, SPACE, Scratch, ascii_lower, cleaned, column, packed

HASH = ["h1", "h2"]


class SortedRuns:
    """Line hashes with their holders, as an LSM tree: runs bucketed and sorted by hash.

    A new run enters at level 0. Once a level has ``fanout`` runs they are compacted into one
    run of the next level, so n batches leave at most fanout * log(n) runs to anti-join.
    All runs have the same buckets, so an anti-join never shuffles a run.
    """

    def __init__(self, scratch: Scratch, fanout: int) -> None:
        self.scratch, self.fanout = scratch, fanout
        self.buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = [[]]

    @cleaned
    def _write(self, df: DataFrame, name: str) -> tuple[str, str]:
        path = self.scratch.path(name)
        table = path[len(self.scratch.root) - 32:].replace("/", "_").replace("-", "_")
        table = f"run_{table}"
        (df.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH)
         .sortBy(*HASH).option("path", path).format("parquet").saveAsTable(table))
        return table, path

    def _read(self, run: tuple[str, str]) -> DataFrame:
        return self.scratch.spark.table(run[0])

    def unseen(self, keys: DataFrame) -> DataFrame:
        for level in self.levels:
            for run in level:
                keys = keys.join(self._read(run).select(HASH), HASH, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        self.levels[0].append(self._write(keys, "run"))
        for i in range(len(self.levels)):
            if len(self.levels[i]) < self.fanout:
                break
            merged = self._write(self._union(self.levels[i]), f"level{i + 1}")
            for run in self.levels[i]:
                self._forget(run)
            self.levels[i] = []
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(merged)

    def _union(self, runs: list[tuple[str, str]]) -> DataFrame:
        out = self._read(runs[0])
        for run in runs[1:]:
            out = out.unionByName(self._read(run))
        return out

    def _forget(self, run: tuple[str, str]) -> None:
        self.scratch.spark.sql(f"DROP TABLE {run[0]}")
        self.scratch.delete(run[1])

    def holders(self) -> DataFrame:
        """Every hash once, with the smallest document that holds it."""
        return self._union([run for level in self.levels for run in level])

    def close(self) -> None:
        for level in self.levels:
            for run in level:
                self._forget(run)


def line_dedup(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    batches: int = 4,
    fanout: int = 2,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Drop each line that a document with a smaller identifier holds already.

    A line's key is the line stripped of white space and lower-cased (A-Z); keys under
    ``min_chars`` code points never drop. Documents arrive in ``batches`` by rising
    identifier. Each batch is reduced to one row per key (map-side combining, so a line that
    a third of all documents share costs one row per task), anti-joined with the runs, and
    what is left becomes a new run. A document's lines are dropped where the runs name
    another holder: an anti-join on hash and document, whose keys no common line can skew.
    Hashes have 128 bits.

    Null text is one empty line. A null identifier counts as the largest. Rows with the same
    identifier are one document: what its rows share, all of them keep. An empty table gives
    no rows. Columns other than those named in ``carry`` are not read.

    Returns doc_id, text (what is left), n_lines, n_dropped, carried (a struct of ``carry``).
    """
    scratch = Scratch(spark, "line-dedup")
    text = F.coalesce(column(text_col), F.lit(""))
    base = docs.select(
        column(id_col).alias("doc_id"),
        F.coalesce(column(id_col).cast("long"), F.lit(LAST_ID)).alias("sid"),
        text.alias("text"), F.xxhash64(text).alias("tk"),
        packed(carry).alias("carried"),
    )
    key = ascii_lower(F.btrim(F.col("line"), F.lit(SPACE)))
    lines = scratch.keep(
        base.select("sid", "tk", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .filter(F.length(F.btrim(F.col("line"), F.lit(SPACE))) >= min_chars)
        .withColumn("key", key)
        .select("sid", "tk", "pos", F.xxhash64("key").alias("h1"),
                F.xxhash64(F.lit("second"), "key").alias("h2")),
        "lines",
    )
    cuts = lines.select(
        F.percentile_approx("sid", [i / batches for i in range(1, batches)], 10000).alias("c")
    ).first()["c"] or []
    cuts = sorted(set(cuts))
    runs = SortedRuns(scratch, fanout)
    try:
        for low, high in zip([None, *cuts], [*cuts, None]):
            batch = lines
            if low is not None:
                batch = batch.filter(F.col("sid") > low)
            if high is not None:
                batch = batch.filter(F.col("sid") <= high)
            keys = batch.groupBy(*HASH).agg(F.min("sid").alias("sid"))
            runs.add(runs.unseen(keys))

        gone = lines.join(runs.holders(), [*HASH, "sid"], "left_anti")
        gone = gone.groupBy("sid", "tk").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
        gone = scratch.keep(gone, "gone")
    finally:
        runs.close()
    scratch.drop(lines)

    docs = base.withColumn("lines", F.split("text", "\n"))
    docs = docs.select("doc_id", "sid", "tk", "lines", "carried").join(gone, ["sid", "tk"], "left")
    # what is left: the stretches between dropped lines, each copied once
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("gone", i) + 1)
    end = lambda i: F.when(i == F.size("gone"), F.size("lines")).otherwise(
        F.element_at("gone", i + 1)
    )
    left = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("gone")),
        lambda i: F.slice("lines", start(i) + 1, end(i) - start(i)),
    ))
    return docs.select(
        "doc_id",
        F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(left), "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), "carried",
    )
