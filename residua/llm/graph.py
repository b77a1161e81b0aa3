"""Connected components of links between identifiers, without collecting any of them."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Smallest identifier reachable, for each one that has a link.

    ``links`` has the long columns a and b. Large-star and small-star steps alternate: the
    first links larger neighbours of a node to its smallest one, the second the smaller ones,
    until only stars are left, which takes a logarithmic number of rounds. The links never
    become more. Joins are plain equi-joins that Spark may split where a node has very many
    links.

    Returns v, component.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = scratch.keep(edges.filter("a <> b").distinct(), "links")
    for i in count():
        middle = edges.select("b").join(edges.select(F.col("a").alias("b")), "b", "left_semi")
        twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if middle.isEmpty() and twice.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.distinct(), f"large{i}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").filter("b <> m").toDF("a", "b")
        small = small.unionByName(least.toDF("a", "b")).distinct()
        before, edges = edges, scratch.keep(small, f"small{i}")
        scratch.drop(before, large)
    roots = edges.select(F.col("b").alias("v")).distinct().withColumn("component", F.col("v"))
    return edges.toDF("v", "component").unionByName(roots)
