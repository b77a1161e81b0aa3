"""N-gram Jaccard self-join by PartEnum signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import batch_of, gathered, grouped
from .common import Scratch, column
from .graph import components
from .hashing import U, mix, shingle_sets, slices

SETS = "id long, n long, d long, e long"
#: Signatures held in memory before those that repeat among them are combined.
HELD = 1 << 17


class Bands:
    """Size bands for a similarity of ``num / den``: sets that similar lie in the same band or
    in neighbouring ones. Instance i of the signature scheme serves pairs within band i and
    pairs of one set in band i and one in band i + 1."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.low = [1]

    def _grow(self, i: int) -> None:
        while len(self.low) <= i + 2:
            self.low.append(self.low[-1] * self.den // self.num + 1)

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self._grow(len(self.low))
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def apart(self, a: int, b: int) -> int:
        """Most elements in which similar sets of these sizes can differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def differing(self, instance: int, n: int | None = None) -> int:
        """Most elements in which two similar sets that the instance serves can differ, one of
        ``n`` elements if given."""
        self._grow(instance + 1)
        top, above = self.low[instance + 1] - 1, self.low[instance + 2] - 1
        if n is None:
            n = top
        return self.apart(n, top if n > top else min(n * self.den // self.num, above))


@cache
def _subsets(n: int, left_out: int) -> np.ndarray:
    """All subsets of n without ``left_out`` of them, as rows of 0 and 1."""
    out = np.ones((math.comb(n, left_out), n), dtype=U)
    for row, gone in zip(out, combinations(range(n), left_out)):
        row[list(gone)] = 0
    return out


@cache
def scheme(k: int, top: int, least: int, k_least: int) -> tuple[int, int, int]:
    """Partitions n1 and n2 of the two levels and the number k2 left out of each subset, for
    sets of ``least`` to ``top`` elements that differ in at most k (k_least for the smallest).

    Where no scheme does, the subsets are single partitions of one part.

    n1 is k div (k2 + 1) + 1 and some more, so one part at least differs in k2 elements at
    most, and in it one subset of n2 - k2 partitions agrees. Taken is what makes the fewest
    signatures, dearer ones if their projections are small, among the schemes in which few
    sets must send signatures of empty projections (see ``signatures``)."""
    if not k:
        return 1, 1, 0
    best = (math.inf, 1, k + 1, k)
    for k2 in range(1, min(k, 4) + 1):
        need = k // (k2 + 1) + 1
        for n2 in range(k2 + 2, 2 * k2 + 3):
            for extra in range(need + 8):
                n1 = need + extra
                if all(_rarely(size / n1, n1 - 1 - most // (k2 + 1), n1, n2, k2) for size, most in ((top, k), (least, k_least))):
                    mass = top * (n2 - k2) / (n1 * n2)
                    cost = n1 * math.comb(n2, k2) * (1 + 25 * 0.6**mass)
                    best = min(best, (cost, n1, n2, k2))
                    break
    return best[1:]


def _rarely(mean: float, spare: int, n1: int, n2: int, k2: int) -> bool:
    """Do more than ``spare`` of n1 parts of ``mean`` elements occupy k2 of their n2
    partitions at most in few sets only, as sums of a normal law have it?"""
    full = 1 - math.exp(-mean / n2)
    weak = sum(math.comb(n2, i) * full**i * (1 - full) ** (n2 - i) for i in range(k2 + 1))
    return n1 * weak + 2.5 * math.sqrt(n1 * weak) <= spare + 0.75


def signatures(features: np.ndarray, bands: Bands) -> np.ndarray:
    """PartEnum signatures of a set of hashed features.

    For each of the set's two instances the feature domain is divided by hash into n1 parts,
    each of them into n2 partitions, and in each part every subset of n2 - k2 partitions is
    enumerated: a signature is the set's projection onto one subset. Of two similar sets,
    k div (k2 + 1) parts at most differ in more than k2 elements; in any other part one subset
    agrees. So they share a signature.

    Projections of no element would be shared by sets that have nothing in common. A part is
    strong if the set's elements in it occupy more than k2 partitions; none of its
    projections is empty. With more than k div (k2 + 1) strong parts, a strong one agrees
    with any similar set, so the set's empty projections are needed only if it has no more.
    """
    band = bands.of(len(features))
    out = []
    for instance in {band, max(band - 1, 0)}:
        k = bands.differing(instance)
        top, least = bands.low[instance + 1] - 1, bands.low[instance]
        n1, n2, k2 = scheme(k, top, least, bands.differing(instance, least))
        h = mix(features ^ U(instance + 1))
        cell = ((h >> U(32)) % U(n1) * U(n2) + (h & U(0xFFFFFFFF)) % U(n2)).astype(np.int64)
        value = mix(features + U(77))
        # sums of 64 bits that wrap, as two sums of 32 bits
        low = np.bincount(cell, (value & U(0xFFFFFFFF)).astype(np.float64), n1 * n2).astype(U)
        high = np.bincount(cell, (value >> U(32)).astype(np.float64), n1 * n2).astype(U)
        sums = (low + (high << U(32))).reshape(n1, n2)
        held = (np.bincount(cell, minlength=n1 * n2) > 0).reshape(n1, n2)
        subsets = _subsets(n2, k2)
        projections = sums @ subsets.T
        wanted = (held @ subsets.T) > 0
        strong = int((held.sum(axis=1) > k2).sum())
        if strong <= bands.differing(instance, len(features)) // (k2 + 1):
            wanted[:] = True
        name = np.arange(projections.size, dtype=U).reshape(projections.shape) + U(instance << 40)
        out.append(mix(projections ^ mix(name + U(5000)))[wanted])
    return np.concatenate(out)


def _digests(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    return int(s.sum().astype(np.int64)), int(mix(s).sum().astype(np.int64))


def _texts(batch: pa.RecordBatch | pa.Table, at: int | str) -> list[bytes]:
    return batch.column(at).cast(pa.binary()).to_pylist()


def _sets(width: int):
    """Size and digests of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch, 1)
            found = np.zeros((3, len(texts)), dtype=np.int64)
            for at, end in slices(texts):
                for i, s in enumerate(shingle_sets(texts[at:end], width), at):
                    if len(s):
                        found[:, i] = len(s), *_digests(s)
            yield batch_of("id n d e", batch.column(0), *found)

    return run


def _emit(width: int, num: int, den: int):
    """Signatures with the digest of their set, in the columns key and a. Sets that repeat
    within a batch are left out; a signature that repeats leaves once, and its other sets as
    pairs (a, b) of its smallest one and themselves, whose key spreads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            texts, seen = _texts(batch, 0), set()
            tokens, owners, held = [], [], 0
            for at, end in slices(texts):
                for s in shingle_sets(texts[at:end], width):
                    name = (len(s), *_digests(s)) if len(s) else None
                    if name is None or name in seen:
                        continue
                    seen.add(name)
                    tokens.append(signatures(s, bands))
                    owners.append(np.full(len(tokens[-1]), name[1], dtype=np.int64))
                    held += len(tokens[-1])
                if held > HELD:
                    yield from _runs(np.concatenate(tokens), np.concatenate(owners))
                    tokens, owners, held = [], [], 0
            if held:
                yield from _runs(np.concatenate(tokens), np.concatenate(owners))

    return run


def _runs(token: np.ndarray, owner: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    first = np.append(True, token[1:] != token[:-1])
    starts = np.flatnonzero(first)
    yield batch_of("key a b", token[starts].astype(np.int64), owner[starts], pa.nulls(len(starts), pa.int64()))
    rest = ~first
    rest &= (center := np.repeat(owner[starts], np.diff(np.append(starts, len(token))))) != owner
    if rest.any():
        a, b = np.unique(np.stack([center[rest], owner[rest]]), axis=1)
        yield batch_of("key a b", mix(b.astype(U)).astype(np.int64), a, b)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: signatures of two or more sets become pairs of the smallest one,
    their center, and each other; pairs pass."""
    last, center = None, 0
    for batch in batches:
        token = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        key, a = (batch.column(i).to_numpy() for i in (0, 1))
        if not token.all():
            b = batch.column(2).filter(pa.array(~token)).to_numpy()
            yield batch_of("star a b", np.zeros(len(b), dtype=bool), a[~token], b)
        key, a = key[token], a[token]
        if not len(key):
            continue
        first = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(first)
        centers = a[starts].copy()
        if last is not None and key[0] == last:
            centers[0] = center
            first[0] = False
        spread = np.repeat(centers, np.diff(np.append(starts, len(key))))
        at = ~first & (spread != a)
        if at.any():
            pairs = np.unique(np.stack([spread[at], a[at]]), axis=1)
            yield batch_of("star a b", np.ones(pairs.shape[1], dtype=bool), *pairs)
        last, center = key[-1], spread[-1]


def intersections(sets: list[np.ndarray], width: int = 8192, tile: int = 1024) -> Iterator[tuple[int, np.ndarray]]:
    """Sizes of the intersections of some sets with all, as (first of them, table), a tile of
    rows after the other: products of 0/1 matrices over stretches of the elements that two or
    more sets hold."""
    n = len(sets)
    # whole numbers that floats of the type hold
    kind = np.float32 if max(map(len, sets)) < 1 << 24 else np.float64
    elements, row = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(elements, kind="stable")
    elements, row = elements[order], row[order]
    first = np.append(True, elements[1:] != elements[:-1])
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    edges = np.zeros(1, dtype=np.int64)
    if len(column):
        column = np.cumsum(np.append(False, column[1:] != column[:-1]))
        width = max(64, min(width, (1 << 22) // n))
        edges = np.searchsorted(column, np.arange(0, column[-1] + width + 1, width))
    for at in range(0, n, tile):
        out = np.zeros((min(tile, n - at), n), dtype=kind)
        for k, (a, z) in enumerate(zip(edges, edges[1:])):
            held = np.zeros((n, width), dtype=kind)
            held[row[a:z], column[a:z] - k * width] = 1
            out += held[at:at + tile] @ held.T
        yield at, out


def sketch(features: np.ndarray, k: int) -> bytes:
    """A byte for each of 4k to 8k partitions of the feature domain: the exclusive or of a byte
    of each element in it. An element that only one of two sets holds changes one byte at most,
    so sets whose sketches differ in more bytes than the sets may differ in elements are not
    similar. The two halves of a sketch, combined, are the sketch of half as many bytes."""
    size = 1 << max(3, (4 * k).bit_length())
    h = mix(features ^ U(31))
    out = np.zeros(size, dtype=np.uint8)
    np.bitwise_xor.at(out, (h & U(size - 1)).astype(np.int64), (h >> U(56)).astype(np.uint8))
    return out.tobytes()


def _sketches(width: int, num: int, den: int):
    """Digest, size and sketch of each document beside its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch, 1)
            n, d, drawn = [], [], []
            for at, end in slices(texts):
                for s in shingle_sets(texts[at:end], width):
                    n.append(len(s))
                    d.append(_digests(s)[0])
                    drawn.append(sketch(s, 2 * len(s) * (den - num) // (den + num)))
            yield batch_of("id d n sketch text", batch.column(0), pa.array(d, pa.int64()),
                         pa.array(n, pa.int64()), pa.array(drawn, pa.binary()), batch.column(1))

    return run


class Sketches:
    """Sketches of a group, folded to each length that occurs, so that any two documents are
    compared at the length of the shorter one, whoever else is in the group."""

    def __init__(self, raw: list[bytes], n: np.ndarray, num: int, den: int) -> None:
        self.n, self.num, self.den = n, num, den
        self.size = np.array([len(x) for x in raw])
        self.folded = {}
        for size in np.unique(self.size):
            longer = np.flatnonzero(self.size >= size)
            table = np.zeros((len(longer), size), dtype=np.uint8)
            for k, i in enumerate(longer):
                table[k] = np.bitwise_xor.reduce(np.frombuffer(raw[i], dtype=np.uint8).reshape(-1, size), axis=0)
            place = np.zeros(len(raw), dtype=np.int64)
            place[longer] = np.arange(len(longer))
            self.folded[size] = place, table

    def near(self, at: int, other: np.ndarray) -> np.ndarray:
        """Of the rows ``other`` those that sizes and sketches do not rule out to be similar to
        row ``at``."""
        n, num, den = self.n, self.num, self.den
        other = other[den * np.minimum(n[at], n[other]) >= num * np.maximum(n[at], n[other])]
        common, out = np.minimum(self.size[at], self.size[other]), [other[:0]]
        for size in np.unique(common):
            own, (place, table) = other[common == size], self.folded[size]
            differ = (table[place[own]] != table[place[at]]).sum(axis=1)
            out.append(own[(den + num) * differ <= (den - num) * (n[at] + n[own])])
        return np.concatenate(out)


def _near_center(num: int, den: int):
    """Rows sorted by group, centers first: centers and the members that may be similar to one."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for key, rows in grouped(batches, 2):
            member, ids, d, n = (rows.column(c).to_numpy() for c in ("member", "id", "d", "n"))
            sketches, others = Sketches(rows.column("sketch").to_pylist(), n, num, den), np.flatnonzero(member)
            kept = np.zeros(len(ids), dtype=bool)
            for at in np.flatnonzero(~member):
                near = sketches.near(at, others)
                kept[near] = True
                kept[at] = len(near) > 0
            if kept.any():
                yield [np.full(kept.sum(), k, dtype=np.int64) for k in key] + [member[kept], ids[kept], d[kept]]

    return lambda batches: gathered(found(batches), "a chunk member id d")


def _center_links(width: int, num: int, den: int):
    """Rows sorted by group, centers first: links of each center and its similar members."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for _, rows in grouped(batches, 2):
            member, ids = (rows.column(c).to_numpy() for c in ("member", "id"))
            texts = _texts(rows, "text")
            for at in np.flatnonzero(~member):
                (center,) = shingle_sets([texts[at]], width)
                for a, z in slices(texts):
                    sets = shingle_sets(texts[a:z], width)
                    sizes = np.array([len(s) for s in sets])
                    row = np.repeat(np.arange(z - a), sizes)
                    both = np.bincount(row[np.isin(np.concatenate(sets), center)], minlength=z - a)
                    similar = member[a:z] & (den * both >= num * (sizes + len(center) - both))
                    yield [np.full(similar.sum(), ids[at], dtype=np.int64), ids[a:z][similar]]

    return lambda batches: gathered(found(batches), "a b")


def _part(num: int, den: int):
    """Part each group into those that their sketches do not rule out to be linked. Those who
    are in one part already, or joined before, are not compared."""

    def parts(sketches: Sketches, joined: np.ndarray) -> np.ndarray:
        label = np.unique(joined, return_inverse=True)[1]
        for i in range(len(joined) - 1):
            other = np.flatnonzero(label[i + 1:] != label[i]) + i + 1
            near = label[sketches.near(i, other)]
            if len(near):
                every = np.append(near, label[i])
                label[np.isin(label, every)] = every.min()
        return label

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for key, rows in grouped(batches, 3):
            ids, d, n, joined = (rows.column(c).to_numpy() for c in ("id", "d", "n", "label"))
            label = parts(Sketches(rows.column("sketch").to_pylist(), n, num, den), joined)
            # parts of documents that are all joined before have nothing new
            ends = np.full((2, label.max() + 1), joined[0])
            ends[0, label] = joined
            np.maximum.at(ends[1], label, joined)
            np.minimum.at(ends[0], label, joined)
            kept = (ends[0] != ends[1])[label]
            if kept.any():
                yield [np.full(kept.sum(), k, dtype=np.int64) for k in key] + [label[kept], ids[kept], d[kept]]

    return lambda batches: gathered(found(batches), "a i j part id d")


def _compare(width: int, num: int, den: int, pivots: int = 4):
    """Rows sorted by group: the members of a group against each other, on their whole sets,
    all against some first; when these do not join the group, all against all. Gives each
    member that has similar ones a link to the smallest it is joined with."""

    def labels(texts: list[bytes]) -> np.ndarray:
        sets: list[np.ndarray] = []
        for at, end in slices(texts):
            sets += shingle_sets(texts[at:end], width)
        sizes = np.array([len(s) for s in sets])
        elements, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        label = np.arange(len(sets))
        for i in range(min(pivots, len(sets))):
            if (label == label[0]).all():
                return label
            both = np.bincount(row[np.isin(elements, sets[i])], minlength=len(sets))
            every = label[den * both >= num * (sizes + sizes[i] - both)]
            label[np.isin(label, every)] = every.min()
        if len(sets) <= pivots or (label == label[0]).all():
            return label
        for at, both in intersections(sets):
            for i, row in enumerate(both, at):
                every = label[den * row.astype(np.int64) >= num * (sizes + sizes[i] - row.astype(np.int64))]
                if (every != label[i]).any():
                    label[np.isin(label, np.append(every, label[i]))] = min(every.min(), label[i])
        return label

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for _, rows in grouped(batches, 4):
            ids = rows.column("id").to_numpy()
            label = labels(_texts(rows, "text"))
            moved = label != np.arange(len(label))
            yield [ids[label[moved]], ids[moved]]

    return lambda batches: gathered(found(batches), "a b")


def _with(rows: DataFrame, needed: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Rows of groups with sketches or texts, group by group."""
    rows = rows.join(needed.select("id", "d", *columns), ["id", "d"])
    return rows.repartition(*keys[:-1]).sortWithinPartitions(*keys, "id")


def _star_links(scratch: Scratch, needed: DataFrame, groups: DataFrame, rules: tuple, block: int) -> DataFrame:
    """Links of centers to members of their groups. A group of many members is dealt out in
    chunks, each with a copy of the center."""
    sizes = groups.groupBy("a").agg(F.expr(
        f"greatest((count(1) - 1) div {block}, least(count(1) - 1, sum(n) div {200 * block})) + 1").alias("chunks")).filter("chunks > 1")
    rows = groups.join(sizes, "a", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    members = rows.filter("d <> a").select(
        "a", F.expr("pmod(xxhash64(id, d), chunks)").alias("chunk"), F.lit(True).alias("member"), "id", "d")
    centers = rows.filter("d = a").select(
        "a", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"), F.lit(False).alias("member"), "id", "d")
    key = ["a", "chunk", "member"]
    rows = _with(members.unionByName(centers), needed, key, "n", "sketch").select(*key, "id", "d", "n", "sketch")
    near = scratch.keep(rows.mapInArrow(_near_center(*rules[1:]), "a long, chunk long, member boolean, id long, d long"), "near")
    rows = _with(near, needed, key, "text").select(*key, "id", "text")
    links = scratch.keep(rows.mapInArrow(_center_links(*rules), "a long, b long"), "star-links")
    scratch.drop(near)
    return links


def _other_links(scratch: Scratch, needed: DataFrame, groups: DataFrame, joined: DataFrame, rules: tuple, block: int) -> DataFrame:
    """Links among members of groups that are not ``joined`` (v, component) before. Groups all
    of one component go. Of the others, the members of the most frequent component need not
    be compared with each other. Members are dealt out in blocks of about ``block``
    documents, or 200 times as many shingles; every two blocks of the others, and every block
    of the others with every one of the most frequent component, are a group of their own."""
    rows = groups.join(joined, groups["id"] == joined["v"], "left").select(
        "a", "id", "d", "n", F.coalesce("component", "id").alias("label"))
    rows = scratch.keep(rows, "labelled")
    found = rows.groupBy("a", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")).groupBy("a").agg(
        F.max(F.struct("m", "label", "w")).alias("most"), F.sum("m").alias("m"), F.sum("w").alias("w"),
        F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    blocks = lambda m, w: F.expr(f"greatest(({m} - 1) div {block}, least({m} - 1, ({w}) div {200 * block})) + 1")
    found = found.select(
        "a", F.col("most.label").alias("frequent"), blocks("m - most.m", "w - most.w").alias("rest"),
        blocks("most.m", "most.w").alias("main"), blocks("m", "w").alias("whole"))
    rows = rows.join(found, "a").withColumn("h", F.xxhash64("id", "d"))
    # where a row goes: i and j, blocks of the rest, or j below 0, a block of the frequent one
    among = "transform(sequence(0L, rest - 1), x -> struct(least(x, pmod(h, rest)) as i, greatest(x, pmod(h, rest)) as j))"
    across = "transform(sequence(0L, main - 1), x -> struct(pmod(h, rest) as i, -1 - x as j))"
    frequent = "transform(sequence(0L, rest - 1), x -> struct(x as i, -1 - pmod(h, main) as j))"
    places = F.expr(f"""case when whole = 1 then array(struct(0L as i, 0L as j))
        when label = frequent then {frequent} else concat({among}, {across}) end""")
    rows = rows.select("a", F.explode(places).alias("at"), "id", "d", "label").select("a", "at.i", "at.j", "id", "d", "label")
    key = ["a", "i", "j"]
    rows = _with(rows, needed, [*key, "label"], "n", "sketch").select(*key, "id", "d", "n", "label", "sketch")
    left = scratch.keep(rows.mapInArrow(_part(*rules[1:]), "a long, i long, j long, part long, id long, d long"), "left")
    key.append("part")
    rows = _with(left, needed, [*key, "id"], "text").select(*key, "id", "text")
    links = scratch.keep(rows.mapInArrow(_compare(*rules), "a long, b long"), "verified")
    scratch.drop(left)
    return links


def _merged(scratch: Scratch, pairs: DataFrame) -> DataFrame:
    """Groups (a, b) of centers and members, of which those are put into another one that it
    covers: three quarters of their members at least are in the group of the smallest center
    that their own center is a member of. All members go there, so whoever met in a group
    still meets in one, and a family whose documents have many centers in common is compared
    once. Groups are put into such only as stay themselves."""
    above = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("parent")).filter("parent < a")
    rows = scratch.keep(pairs.join(above, "a", "left").select("a", "b", "parent"), "parents")
    there = pairs.select(F.col("a").alias("parent"), "b", F.lit(1).alias("there"))
    share = rows.filter("parent is not null").join(there, ["parent", "b"], "left").groupBy("a", "parent").agg(
        F.count(F.lit(1)).alias("m"), F.count("there").alias("covered"))
    moved = scratch.keep(share.filter("4 * covered >= 3 * m").select("a", "parent"), "covered")
    moved = scratch.keep(moved.join(moved.select(F.col("a").alias("parent")), "parent", "left_anti").select("a"), "moved")
    stay, go = rows.join(moved, "a", "left_anti"), rows.join(moved, "a", "left_semi")
    return stay.select("a", "b").union(go.select("parent", "b")).distinct()


def jaccard_components(
    spark: SparkSession,
    docs: DataFrame,
    width: int = 5,
    similarity: tuple[int, int] = (80, 100),
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = 8192,
) -> DataFrame:
    """Exact components of the graph that links documents with similar shingle sets.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a document's set has its
    distinct shingles of ``width`` words, or its whole word sequence if it has fewer. Two
    documents link when intersection / union is at least ``similarity``.

    Documents with equal sets are one class, whose set is named by 128 bits; classes are the
    rows of all that follows. Every class sends its PartEnum signatures (see ``signatures``)
    into one shuffle; signatures that repeat within a batch are combined before it, so one
    that a third of all documents share costs one row per batch. The smallest set of a
    signature is its center. Two similar sets share a signature, and so a center. Groups that
    another one covers for the most part join it (see ``_merged``). Then each
    center is compared with its members, and, in groups that these links do not join to one
    component, the members with each other, in one task or, if there are many, in blocks: by
    sketches that rule pairs out for certain, then by their whole sets. Pairs are never listed:
    a task gives each document a link to the smallest that its links join it with, and compares
    none that are joined already. No similar pair is missed.

    Null text is empty; empty sets link with nothing. Rows with the same identifier are one
    document, linked wherever one of its rows is. Rows without identifier link with nothing
    and have no component. An empty table gives no rows. Other columns are not read.

    Returns doc_id, n_shingles, component_id.
    """
    scratch = Scratch(spark, "ngram-join")
    rules = (width, *similarity)
    texts = docs.select(column(id_col).cast("long").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    named = texts.filter("id is not null")
    sets = scratch.keep(texts.mapInArrow(_sets(width), SETS), "sets")
    full = sets.filter("id is not null and n > 0")
    classes = full.groupBy("d", "e", "n").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.keep(classes, "classes")

    sent = named.select("text").mapInArrow(_emit(*rules), "key long, a long, b long")
    met = sent.repartition("key").sortWithinPartitions("key", "a").mapInArrow(_scan, "star boolean, a long, b long")
    met = scratch.keep(met, "met")
    stars, local = (met.filter(x).select("a", "b").distinct() for x in ("star", "not star"))
    # what met its smallest set within a batch meets the centers of that one, once each
    centers = stars.groupBy(F.col("b").alias("a")).agg(F.collect_set("a").alias("centers"))
    beyond = local.join(centers, "a").groupBy("b").agg(F.array_distinct(F.flatten(F.collect_set("centers"))).alias("centers"))
    beyond = beyond.select(F.explode("centers").alias("a"), "b")
    pairs = scratch.keep(stars.unionByName(local).unionByName(beyond).distinct(), "pairs")
    members = scratch.keep(pairs.union(pairs.select("a", "a").distinct()), "members")
    groups = _merged(scratch, members).toDF("a", "d").join(classes, "d").select("a", "d", "id", "n")
    groups = scratch.keep(groups, "groups")
    # by a shuffle of the texts whatever the sizes, so that the plan is the same at all
    needed = named.join(groups.select("id").distinct().hint("merge"), "id", "left_semi").select("id", "text")
    needed = scratch.keep(
        needed.mapInArrow(_sketches(*rules), "id long, d long, n long, sketch binary, text string"), "needed"
    )
    links = _star_links(scratch, needed, groups, rules, block)
    joined = components(scratch, links)
    links = links.unionByName(_other_links(scratch, needed, groups, joined, rules, block))
    scratch.drop(met, pairs, members, groups, needed)

    # identifiers of several sets join these
    several = full.groupBy("id").agg(F.min(F.struct("d", "e")).alias("x"), F.max(F.struct("d", "e")).alias("y"))
    several = scratch.keep(several.filter("x <> y").select("id"), "several")
    ties = full.join(several, "id").select(F.col("id").alias("a"), "d", "e", "n").join(classes, ["d", "e", "n"])
    parts = components(scratch, links.unionByName(ties.select("a", F.col("id").alias("b"))))
    known = classes.join(parts, classes["id"] == parts["v"], "left").select(
        "d", "e", "n", "copies", "id", F.coalesce("component", "id").alias("component")
    ).filter("copies > 1 or component <> id").drop("copies", "id")
    own = several.join(parts, several["id"] == parts["v"]).select("id", F.col("component").alias("own"))
    out = sets.join(known, ["d", "e", "n"], "left").join(own, "id", "left")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("own", "component", "id")).alias("component_id"),
    )
