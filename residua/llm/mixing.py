"""Mixing sources to target weights by Sainte-Lague apportionment of words."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, column, packed, ranked

BLANKS = r"[\x20\x09-\x0D]*"


def capped_targets(sizes: list[int], weights: list[int], total: Fraction, cap: int) -> list[Fraction]:
    """Share ``total`` by weight; no target over ``cap`` times its size; share the excess again."""
    targets = [Fraction(0)] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = Fraction(total)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / w
            break
        for i in over:
            targets[i] = Fraction(cap * sizes[i])
            left -= targets[i]
        free = [i for i in free if i not in over]
    return targets


def sainte_lague(votes: list[Fraction], most: list[int], shards: int, total_seats: int) -> list[list[int]]:
    """Quotas of each shard: seats go one by one to the highest votes / (2 got + 1).

    The seats of a shard continue those of the shards before, so all quotas together are the
    apportionment of the whole as well. No source gets over ``most`` seats. What a source is
    sure to get is not dealt seat by seat, so that a seat can be as small as a word.
    """
    total = sum(votes)
    running = sum(v > 0 for v in votes)
    quotas, before = [], [0] * len(votes)
    for shard in range(1, shards + 1):
        seats = total_seats * shard // shards
        # all quotients of the seats given reach total / (2 seats + running) at least; one seat of slack
        got = [
            min(most[i], max(0, int(v * (2 * seats - running) / (2 * total)) - 1)) if v > 0 else 0
            for i, v in enumerate(votes)
        ]
        heap = [(-v / (2 * got[i] + 1), i) for i, v in enumerate(votes) if v > 0 and got[i] < most[i]]
        heapq.heapify(heap)
        for _ in range(seats - sum(got)):
            if not heap:
                break
            _, i = heapq.heappop(heap)
            got[i] += 1
            if got[i] < most[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
        quotas.append([n - o for n, o in zip(got, before)])
        before = got
    return quotas


@dataclass(frozen=True)
class Quotas:
    """How many blocks of ``block`` words each shard takes from each source."""

    block: int
    targets: list[Fraction]
    shards: list[list[int]]

    def bounds(self, source: int) -> list[int]:
        """Words of the source taken before each shard, and in all."""
        out = [0]
        for quotas in self.shards:
            out.append(out[-1] + quotas[source] * self.block)
        return out


def apportion(
    sizes: list[int], weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), cap: int = 2,
    shards: int = 8, block: int = 1024, finest: int = 256,
) -> Quotas:
    """Quotas of sources with so many words each, which have the weights in turn.

    Blocks have ``block`` words, or fewer if the smallest target has not ``finest`` times as
    many, down to single words: so every source is within a block, and so within 1 / finest,
    of its target, whatever the size of the corpus."""
    targets = capped_targets(
        sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), cap)
    least = min((int(t) for t in targets if t > 0), default=0)
    block = max(1, min(block, least // finest))
    seats = int(sum(targets)) // block
    most = [cap * n // block for n in sizes]
    return Quotas(block, targets, sainte_lague(targets, most, shards, seats))


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: Fraction = Fraction(3, 2),
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 29,
    shards: int = 8,
    block: int = 1024,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Say how many words of each document a mix of sources takes, and which ones.

    Sources in order of their names (UTF-8 bytes, which is code point order; null last) have
    the ``weights`` in turn. The mix has ``share`` of all words. Sainte-Lague allocates blocks
    of equal length to the sources, shard after shard (see ``apportion``), so every shard has
    the mixture. A source's documents stand in a seeded order, one after the other, again and
    again; its blocks are cut from this line, and each shard selects as many as its quota,
    those after the shard before. Within a shard the blocks of a source follow one another,
    so documents are taken whole but where a shard's part begins or ends. Only one row per
    source goes to the driver.

    Null text has no words; null sources are one source; repeated rows count each. An empty
    table, or one without words, takes nothing. Columns other than those named in ``carry``
    are not read.

    Returns doc_id, source, size, source_size, target, taken, block, ranges: the words taken
    as (shard, pass, from, to) with an exclusive end, and the columns of ``carry``.
    """
    scratch = Scratch(spark, "mixing")
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(
        column(id_col).alias("doc_id"), column(source_col).alias("source"),
        F.xxhash64(text).alias("tk"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), column(id_col)).alias("key"),
        packed(carry).alias("carried"),
    )
    rows = ranked(scratch, rows, ["key", "doc_id", "tk", "size"], "start", by="source", size="size")
    rows = scratch.keep(rows.drop("key", "tk"), "placed")
    sums = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sums.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    quotas = apportion([r.n or 0 for r in sums], weights, share, cap, shards, block)
    plan = spark.createDataFrame(
        [(r.source, r.n or 0, float(t), quotas.bounds(i)) for i, (r, t) in enumerate(zip(sums, quotas.targets))],
        "p_source string, source_size long, target double, bounds array<long>",
    )
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")))

    def taken(at: Column) -> Column:
        shard, turn = at % shards, F.floor(at / shards)
        begin = F.col("start") + turn * F.col("source_size")
        first = F.element_at("bounds", shard + 1)
        return F.struct(
            shard.alias("shard"), turn.alias("pass"),
            F.greatest(F.lit(0).cast("long"), first - begin).alias("from"),
            F.least(F.col("size"), F.element_at("bounds", shard + 2) - begin).alias("to"),
        )

    ranges = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap * shards - 1)), taken), lambda x: x["to"] > x["from"])
    joined = joined.withColumn("ranges", ranges)
    return joined.select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"]).alias("taken"),
        F.lit(quotas.block).alias("block"), "ranges", *(F.col("carried")[c].alias(c) for c in carry),
    )


def mixed_documents(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", **options: int,
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per document and pass that takes
    words of it. A pass that takes all words keeps the text as it is; one that takes some, of
    one document a source at most, has the text up to its last word, white space as it was.
    Documents the mix takes nothing of go.

    Rows are numbered and written once; the plan is made of their numbers and sizes, and
    joined with the texts by number, so rows alike in everything remain apart. Nulls, repeats
    and empty tables are as in ``mix_sources``."""
    scratch = Scratch(spark, "mixed")
    rows = scratch.keep(docs.select(
        F.struct(*(column(c) for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("_row")), "rows")
    slim = rows.select(
        F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).alias("text"),
        F.col("row").getField(source_col).alias("source"), "_row")
    plan = mix_sources(spark, slim, id_col="id", text_col="text", source_col="source", carry=("_row",), **options)
    passes = plan.filter("taken > 0").select("_row", "size", F.explode(
        F.expr("transform(array_distinct(transform(ranges, r -> r.pass)), p -> filter(ranges, r -> r.pass = p))")).alias("ranges"))
    passes = passes.select(
        "_row", "size", F.array_min("ranges.from").alias("from"), F.array_max("ranges.to").alias("to"))
    rows = rows.join(passes, "_row")
    text = F.col("row").getField(text_col)
    # each word with the white space before it; the parts that shards take of a pass adjoin
    words = F.regexp_extract_all(text, F.lit(f"{BLANKS}{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int")), "")
    new = F.when(F.col("to") - F.col("from") == F.col("size"), text).otherwise(cut)
    return rows.withColumn("new", new).select(
        *((F.col("new") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns)
    )
