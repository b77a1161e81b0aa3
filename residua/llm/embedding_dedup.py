"""Near-dedup of embeddings by E8 lattice hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import gathered, grouped
from .common import Scratch, column
from .graph import components
from .hashing import U, mix

PROBES = 4  # the home cell, and its neighbours in one half, the other, and both
LINKS, EDGE = 0, 1


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    f = np.rint(x)
    gap = x - f
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    worst = np.abs(gap[odd]).argmax(axis=1)
    f[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def shortest_e8() -> np.ndarray:
    """The 240 shortest vectors of E8: steps to the neighbouring cells."""
    eye = np.eye(8)
    whole = [s * eye[i] + t * eye[j] for i in range(8) for j in range(i + 1, 8) for s in (1, -1) for t in (1, -1)]
    signs = 0.5 - (np.arange(256)[:, None] >> np.arange(8) & 1)
    return np.array(whole + [v for v in signs if (v < 0).sum() % 2 == 0])


_STEPS = shortest_e8()


def cells(x: np.ndarray, tables: int, width: float, seed: int) -> np.ndarray:
    """Cell keys of unit vectors: per table the home cell's, then the probed neighbours'.

    A table projects onto 16 random directions, two blocks of 8 coordinates in units of
    ``width``; each block is decoded to a lattice point. A neighbour is one step from it
    along the shortest lattice vector that points best to where the vector lies."""
    d = x.shape[1]
    directions = np.random.default_rng([seed, d]).normal(size=(tables * 16, d))
    y = x @ directions.T / width
    out = np.zeros((len(x), tables, PROBES), dtype=U)
    for t in range(tables):
        options = []
        for block in (0, 8):
            part = y[:, t * 16 + block : t * 16 + block + 8]
            home = nearest_e8(part)
            step = _STEPS[((part - home) @ _STEPS.T).argmax(axis=1)]
            options.append([(2 * p).astype(np.int64).astype(U) for p in (home, home + step)])
        for probe, (i, j) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
            key = np.full(len(x), (t << 20) + d, dtype=U)
            for coordinate in np.concatenate([options[0][i], options[1][j]], axis=1).T:
                key = mix(key ^ coordinate)
            out[:, t, probe] = key
    return out


def _unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(vectors: list) -> Iterator[np.ndarray]:
    lengths = np.array([len(v) for v in vectors])
    for d in np.unique(lengths):
        yield np.flatnonzero(lengths == d)


def _index(tables: int, width: float, seed: int):
    """A row per class and cell: is it the class's home there?"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for own in _by_length(vectors):
                keys = cells(_unit([vectors[i] for i in own]), tables, width, seed).astype(np.int64)
                cls = np.repeat(ids[own], tables * PROBES)
                home = np.tile(np.arange(PROBES) == 0, len(own) * tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(cls), pa.array(home)], ["key", "cls", "home"]
                )

    return run


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of cell keys, the home cell in which each pair counts: the first where one
    has its home and the other has its home or a probe."""
    out = np.zeros(len(a), dtype=U)
    open_ = np.ones(len(a), dtype=bool)
    for t in range(a.shape[1]):
        at_a = (b[:, t] == a[:, t, :1]).any(axis=1)
        at_b = (a[:, t] == b[:, t, :1]).any(axis=1)
        out = np.where(open_ & at_a, a[:, t, 0], np.where(open_ & at_b, b[:, t, 0], out))
        open_ &= ~(at_a | at_b)
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest linked member of each of n, by repeated passing on."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All components, and where each vector's begin (one more entry than vectors)."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.flatten().to_numpy(), np.append(0, np.cumsum(whole.value_lengths().to_numpy()))


def _verify(tables: int, width: float, seed: int, cosine: float, tile: int = 512):
    """Rows sorted by cell and pair of blocks: counts of links, and edges of a forest. Cosines
    are computed a tile of rows against all later ones at a time."""

    def group(held, rows):
        key, first, second = held
        ids, mult, block = (rows.column(c).to_numpy() for c in ("cls", "mult", "own"))
        values, begin = _vectors(rows.column("v"))
        lengths = np.diff(begin)
        for d in np.unique(lengths):
            own = np.flatnonzero(lengths == d)
            if len(own) < 2:
                continue
            x = _unit(values[begin[own][:, None] + np.arange(d)])
            pairs = []
            for at in range(0, len(own), tile):
                i, j = np.nonzero(x[at:at + tile] @ x[at:].T >= cosine)
                pairs.append(np.stack([i, j])[:, i < j] + at)
            i, j = np.concatenate(pairs, axis=1)
            if first != second:
                cross = block[own][i] != block[own][j]
                i, j = i[cross], j[cross]
            if not len(i):
                continue
            used = np.unique(np.concatenate([i, j]))
            keys = np.zeros((len(own), tables, PROBES), dtype=U)
            keys[used] = cells(x[used], tables, width, seed)
            counted = first_meeting(keys[i], keys[j]) == U(int(key) & (1 << 64) - 1)
            i, j = i[counted], j[counted]
            n = np.bincount(i, mult[own][j], len(own)) + np.bincount(j, mult[own][i], len(own))
            root = _forest(len(own), i, j)
            linked, moved = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(own)))
            kinds = np.repeat(np.array([LINKS, EDGE], dtype=np.int32), [len(linked), len(moved)])
            yield [kinds, ids[own[np.append(linked, moved)]], np.append(n[linked].astype(np.int64), ids[own[root[moved]]])]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for held, rows in grouped(batches, 3):
            yield from group(held, rows)

    return lambda batches: gathered(found(batches), "kind a b")


def near_embeddings(
    spark: SparkSession,
    table: DataFrame,
    cosine: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = 8,
    width: float = 2.0,
    block: int = 4096,
    seed: int = 5,
) -> DataFrame:
    """Links between vectors of at least ``cosine``, and components of the links.

    Equal vectors are one class with a count (combined on the map side, so a vector that a
    third of all rows share is one row). Each class has, in every table, a home cell of the
    E8 lattice and three probed neighbours. Classes meet in a cell where one has its home
    and the other its home or a probe; there their cosine is computed in double precision.
    A pair that meets in several cells counts in the first of them only, so no pair is ever
    written out: a cell gives its members' numbers of links and a forest of edges. A cell of
    more than ``block`` classes is dealt out by pairs of blocks. With the given tables and
    width over 0.99 of the pairs at cosine 0.95 meet, more above; none below links.

    Null or zero vectors and those with null or non-finite components, and rows without
    identifier, link with nothing; so do vectors of different lengths with each other. Rows
    with the same identifier count each. An empty table gives no rows. Other columns are not
    read.

    Returns vec_id, n_links, component_id, kept.
    """
    scratch = Scratch(spark, "near-embeddings")
    rows = table.select(column(id_col).alias("vec_id"), column(vector_col).cast("array<double>").alias("v"))
    sound = F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False),
    )
    rows = rows.withColumn("sound", sound)
    valid = rows.filter("sound").select("vec_id", "v")
    classes = scratch.keep(
        valid.groupBy("v").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("mult")), "classes"
    )
    rule = (tables, width, seed)
    places = scratch.keep(
        classes.select("cls", "v").mapInArrow(_index(*rule), "key long, cls long, home boolean"), "cells"
    )
    crowded = places.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.max("home").alias("homes")
    ).filter("m > 1 and homes").withColumn("blocks", F.expr(f"(m - 1) div {block} + 1")).select("key", "blocks")
    members = places.join(crowded, "key").withColumn("own", F.expr("pmod(xxhash64(cls), blocks)"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "own"
    )
    members = members.join(classes, "cls").select("key", "i", "j", "cls", "mult", "own", "v")
    members = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cls")
    found = scratch.keep(members.mapInArrow(_verify(*rule, cosine), "kind int, a long, b long"), "found")
    links = found.filter(F.col("kind") == LINKS).groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("n"))
    parts = components(scratch, found.filter(F.col("kind") == EDGE).select("a", "b"))
    parts = parts.withColumnRenamed("v", "node")
    known = classes.join(links, "cls", "left").join(parts, F.col("cls") == F.col("node"), "left")
    known = known.select(
        "v", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component", "cls").alias("component_id"),
    )
    linked = valid.join(known, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not sound").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
