"""Each operator on odd documents, on an empty table, and against its plain version."""

import hashlib
import re
from collections import Counter
import struct
import sys
import textwrap
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from residua.llm import embedding_dedup, licenses, mixing, ngram_join, pii, quality  # noqa: E402
from residua.llm.bpe import Codec, encode_decode  # noqa: E402
from residua.llm.common import Scratch  # noqa: E402
from residua.llm.exact_dedup import exact_dedup  # noqa: E402
from residua.llm.graph import components  # noqa: E402
from residua.llm.hashing import shingle_sets  # noqa: E402
from residua.llm.line_dedup import line_dedup  # noqa: E402
from residua.llm.sharding import interleaved_shards, write_shards  # noqa: E402

TOKENS = public_tokenizers.path("byte_bpe_50k.json")


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


# --- 1

def check_groups(out, rows):
    groups = brute.exact_groups(pairs(rows))
    by_sha = {}
    for r in out:
        by_sha.setdefault(r.text_sha256, []).append(r)
    assert {hashlib.sha256(k.encode()).hexdigest() for k in groups} == set(by_sha)
    for text, ids in groups.items():
        own = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in own)
        assert {r.keep_id for r in own} == {max((i for i in ids if i is not None), default=None)}
        assert {r.group_size for r in own} == {len(ids)} and sum(r.kept for r in own) == 1
        assert all(r.doc_id == r.keep_id for r in own if r.kept)


def test_exact_dedup(spark, odd, rows):
    check_groups(exact_dedup(spark, odd).collect(), rows)


def test_exact_dedup_compares_bytes_when_digests_clash(spark, odd, rows):
    check_groups(exact_dedup(spark, odd, digest=lambda t: (F.crc32(t.cast("binary")) % 3).cast("string"), files_per_batch=1).collect(), rows)


@pytest.mark.parametrize("fetched", [500_000, 3])
def test_exact_dedup_compares_bytes_when_the_default_digest_clashes(spark, odd, rows, monkeypatch, fetched):
    monkeypatch.setattr(F, "sha2", lambda text, bits: F.lit("ab" * 32))
    out = exact_dedup(spark, odd, fetched=fetched).collect()
    groups = brute.exact_groups(pairs(rows))
    largest = {str(i): (max((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids}
    assert len(out) == len(rows) and sum(r.kept for r in out) == len(groups)
    assert all((r.keep_id, r.group_size) == largest[str(r.doc_id)] for r in out)


def test_exact_dedup_fetches_hits_in_chunks(spark, odd, rows):
    check_groups(exact_dedup(spark, odd, fetched=3).collect(), rows)


def test_exact_dedup_of_nothing(spark, empty):
    assert exact_dedup(spark, empty).collect() == []


# --- 2

def test_quality_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = quality.classify_quality(spark, docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert good.kept.mean() >= 0.99 and (~bad.kept).mean() >= 0.9


def test_quality_edges(spark, odd, empty, rows):
    out = quality.classify_quality(spark, spark.read.parquet(odd)).collect()
    assert len(out) == len(rows)
    assert all(not r.kept and r.score == 0 for r in out if r.doc_id in (1, 2, 10))
    assert quality.classify_quality(spark, spark.read.parquet(empty)).collect() == []


def voted(rng, rows):
    """Random votes of labellers, the odd ones more accurate, on texts of which 80% are good."""
    truth = rng.random(rows) < 0.8
    votes = np.empty((rows, len(quality.LABELLERS)), dtype=int)
    for j in range(len(quality.LABELLERS)):
        right = rng.random(rows) < (0.95 if j % 2 else 0.7)
        votes[:, j] = np.where(truth == right, quality.GOOD, np.where(rng.random(rows) < 0.5, quality.BAD, quality.SILENT))
    return truth, votes, [int("".join(map(str, v)), 3) for v in votes]


def test_em_finds_the_better_labeller():
    truth, _, codes = voted(np.random.default_rng(0), 4000)
    counts = {c: codes.count(c) for c in set(codes)}
    post, rates = quality.rate_labellers(counts)
    assert np.allclose(rates.sum(axis=2), 1)
    right = rates[:, 1, quality.GOOD] / (rates[:, 1, quality.GOOD] + rates[:, 1, quality.BAD])
    assert right[1::2].min() > right[::2].max()
    assert np.mean([(post[c] >= 0.5) == t for c, t in zip(codes, truth)]) > 0.98


def test_em_over_counts_is_em_over_rows():
    truth, votes, codes = voted(np.random.default_rng(1), 300)
    post, rates = quality.rate_labellers({c: codes.count(c) for c in set(codes)}, rounds=6)
    good, weight = [0.1, 0.9], 0.1 * len(codes)
    own = [[list(quality.PRIOR[c]) for c in (0, 1)] for _ in quality.LABELLERS]
    mass = list(good)
    for turn in range(6):
        if turn:
            sums = [1 - q for q in p], p
            mass = [sum(q) + weight * g for q, g in zip(sums, good)]
            mass = [m / sum(mass) for m in mass]
            for j in range(len(own)):
                for c in (0, 1):
                    seen = [sum(q for q, v in zip(sums[c], votes) if v[j] == k) + weight * quality.PRIOR[c][k] for k in range(3)]
                    own[j][c] = [x / sum(seen) for x in seen]
        p = []
        for v in votes:
            one, two = (mass[c] * np.prod([own[j][c][k] for j, k in enumerate(v)]) for c in (0, 1))
            p.append(two / (one + two))
    assert np.allclose([post[c] for c in codes], p, atol=1e-9)


def test_em_rates_the_labellers_of_real_votes():
    """The estimates with the product's own settings, at two sizes, against labels not used."""
    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pydict()
    truth = dict(zip(labels["doc_id"], labels["quality"]))
    for n in (500, 3000):
        codes = {i: quality.votes(t or "") for i, t in zip(table["doc_id"][:n], table["text"][:n])}
        post, _ = quality.rate_labellers(dict(Counter(codes.values())))
        kept = {y: [post[c] >= 0.5 for i, c in codes.items() if truth.get(i) == y] for y in (0, 1)}
        assert np.mean(kept[1]) >= 0.99 and np.mean(kept[0]) <= 0.1


# --- 3

@pytest.mark.parametrize("width,similarity", [(4, (85, 100)), (5, (80, 100)), (1, (50, 100))])
def test_jaccard_join(spark, odd, rows, width, similarity):
    out = ngram_join.jaccard_components(spark, spark.read.parquet(odd), width, similarity, block=2).collect()
    want = brute.jaccard_components(pairs(rows), width, *similarity)
    assert len(out) == len(rows)
    assert all(r.component_id == want.get(r.doc_id) for r in out)
    sizes = sorted((str(i), len(brute.shingles(t, width))) for i, t in pairs(rows))
    assert sorted((str(r.doc_id), r.n_shingles) for r in out) == sizes


def families():
    """Groups of copies with so many edits that copies are often alike though neither is like
    the first one."""
    rng = np.random.default_rng(3)
    docs = []
    for f in range(8):
        base = [f"f{f}w{i}" for i in range(int(rng.integers(30, 200)))]
        for c in range(25):
            own = list(base)
            for k in rng.choice(len(base), rng.integers(0, max(2, len(base) // 15)), replace=False):
                own[k] = f"x{rng.integers(4)}"
            if c % 3 == 0:
                own = own[: int(len(own) * rng.uniform(0.8, 1))]
            docs.append((len(docs) * 7 % 211, " ".join(own)))
    return docs


@pytest.mark.parametrize("num", [85, 70])
def test_jaccard_join_misses_no_pair(spark, num):
    docs = families()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    out = ngram_join.jaccard_components(spark, table, 4, (num, 100)).collect()
    assert {r.doc_id: r.component_id for r in out} == brute.jaccard_components(docs, 4, num, 100)


def test_jaccard_join_of_nothing(spark, empty):
    assert ngram_join.jaccard_components(spark, spark.read.parquet(empty)).collect() == []


@settings(deadline=None, max_examples=200)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6))
def test_similar_sets_share_a_signature(n, lost, added, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
    b = np.unique(np.append(a[min(lost, len(a) - 1):], rng.integers(0, 1 << 62, added).astype(np.uint64)))
    both = len(np.intersect1d(a, b))
    for num in (60, 80, 85, 95):
        if 100 * both >= num * (len(a) + len(b) - both):
            bands = ngram_join.Bands(num, 100)
            assert len(np.intersect1d(ngram_join.signatures(a, bands), ngram_join.signatures(b, bands)))


def test_signatures_enumerate_subsets():
    """Two sets that share a passage alone share few signatures: each covers several shingles."""
    bands = ngram_join.Bands(80, 100)
    k = bands.differing(bands.of(300))
    n1, n2, k2 = ngram_join.scheme(k, 300, 240, bands.differing(bands.of(300), 240))
    assert k2 >= 1 and n2 - k2 >= 2 and n1 > k // (k2 + 1)
    rng = np.random.default_rng(5)
    passage, *own = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (100, *[200] * 30))
    held = [ngram_join.signatures(np.append(passage, x), bands) for x in own]
    shared = [len(np.intersect1d(held[0], x)) for x in held[1:]]
    assert sum(shared) < len(shared)


def test_join_of_a_large_family_and_of_long_texts(spark):
    """5,000 near copies are dealt out by blocks; texts of 60,000 words are compared whole."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1:])) for i, k in enumerate(rng.integers(0, 60, 5000).tolist())]
    long = [f"l{i}" for i in range(60_000)]
    docs += [(10_000, " ".join(long)), (10_001, " ".join(long[4000:])), (10_002, " ".join(long[25_000:]))]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark, table, 5).collect()}
    assert all(got[i] == 0 for i in range(5000))
    assert (got[10_000], got[10_001], got[10_002]) == (10_000, 10_000, 10_002)


def test_join_of_many_rows_with_one_identifier(spark):
    docs = [(1, f"a b c d e {i % 3}") for i in range(300)] + [(2, "a b c d e 1"), (3, None), (1, "")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    out = ngram_join.jaccard_components(spark, table, 5).collect()
    assert {r.doc_id: r.component_id for r in out} == {1: 1, 2: 1, 3: 3} and len(out) == len(docs)


@settings(deadline=None, max_examples=200)
@given(st.integers(1, 400), st.integers(0, 100), st.integers(0, 100), st.integers(0, 10**6))
def test_sketches_never_rule_out_too_much(n, lost, added, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
    b = np.unique(np.append(a[min(lost, len(a) - 1):], rng.integers(0, 1 << 62, added).astype(np.uint64)))
    rows = [[0, len(a), ngram_join.sketch(a, len(a) // 6)], [1, len(b), ngram_join.sketch(b, len(b) // 6)]]
    size = min(len(r[2]) for r in rows)
    x, y = (np.bitwise_xor.reduce(np.frombuffer(r[2], np.uint8).reshape(-1, size)) for r in rows)
    assert (x != y).sum() <= len(np.setxor1d(a, b))


def test_sketches_of_a_group_compare_at_the_length_of_the_shorter():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    sets = [np.unique(np.append(base[k:n], rng.integers(0, 1 << 62, e).astype(np.uint64)))
            for n in (20, 40, 400, 500, 3000) for k in (0, 1, 9) for e in (0, 2, 30)]
    n = np.array([len(s) for s in sets])
    held = ngram_join.Sketches([ngram_join.sketch(s, 2 * len(s) // 9) for s in sets], n, 80, 100)
    every, ruled = np.arange(len(sets)), 0
    for i in every:
        near = set(held.near(i, every).tolist())
        for j in every:
            both = len(np.intersect1d(sets[i], sets[j]))
            assert j in near or 100 * both < 80 * (n[i] + n[j] - both)
        ruled += len(sets) - len(near)
    assert ruled > len(sets) ** 2 / 2


@settings(deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t\x0b日", max_size=40), max_size=6), st.integers(1, 5))
def test_shingle_counts(texts, width):
    assert [len(s) for s in shingle_sets([t.encode() for t in texts], width)] == [len(brute.shingles(t, width)) for t in texts]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)]
    parts = components(Scratch(spark, "test"), spark.createDataFrame(links, "a long, b long"))
    nodes = {n for p in links for n in p if p[0] != p[1]}
    assert {r.v: r.component for r in parts.collect()} == {n: r for n, r in brute.joined(links, range(600)).items() if n in nodes}


# --- 4

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENS)
    t.no_truncation(), t.no_padding()
    return t


def test_bpe(spark, odd, rows, library):
    out = encode_decode(spark, spark.read.parquet(odd), TOKENS).collect()
    want = brute.counted(
        (i, struct.pack(f"<{len(e)}I", *e), library.decode(e, skip_special_tokens=False))
        for i, t in pairs(rows) for e in [library.encode(t or "", add_special_tokens=False).ids])
    assert brute.counted((r.doc_id, bytes(r.ids), r.decoded) for r in out) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in out)


def test_pieces_are_cut_where_no_token_joins_two_bytes():
    codec = Codec(TOKENS)
    rng = np.random.default_rng(2)
    joined = {t[i:i + 2] for t in codec.vocab for i in range(len(t) - 1)}
    seen = 0
    for n in [2, 3, 20, 64, 65, 400] * 5:  # short pieces and long ones take different ways
        piece = bytes(rng.integers(0, 256, n).astype(np.uint8)) if n % 2 else bytes(rng.choice(list(b"thequickjumpsoverQZ#\xc3\xa9"), n).astype(np.uint8))
        parts = codec.fragments(piece)
        assert b"".join(parts) == piece and all(parts)
        want = [i for i in range(1, n) if piece[i - 1:i + 1] not in joined]
        assert list(np.cumsum([len(p) for p in parts])[:-1]) == want
        whole = codec.merge(piece)
        assert [i for p in parts for i in codec.merge(p)] == whole
        seen += len(want)
    assert seen > 100 and codec.fragments(b"") == []


def test_bpe_of_nothing(spark, empty):
    assert encode_decode(spark, spark.read.parquet(empty), TOKENS).collect() == []


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=80) | st.text(alphabet=" aAbté'sllre\n\t0１９!?<|endoftext|>", max_size=80))
def test_bpe_as_the_library(library, text):
    own = test_bpe_as_the_library.codec = getattr(test_bpe_as_the_library, "codec", None) or Codec(TOKENS)
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_long_and_short_merges_agree():
    own = Codec(TOKENS)
    for word in ("internationalization", "aaaaaaaaaaaaaaaaaaaaaaa", "ÄÖÜßéèê", "mississippi"):
        short = own.merge(word.encode()[:24])
        long = own.merge(word.encode()[:24] + b"\xff" * 30)
        assert long[: len(short)] == short


# --- 5, 6

def test_shards(spark, odd, rows):
    out = interleaved_shards(spark, spark.read.parquet(odd), 8).collect()
    want = brute.counted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(rows))
    assert brute.counted((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    counts = [sorted(r.slot for r in out if r.shard == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts)
    assert max(map(len, counts)) - min(map(len, counts)) <= 1


def test_shards_follow_the_mixture(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source")
    out = interleaved_shards(spark, docs, 8).toPandas()
    table = out.groupby(["source", "shard"]).size().unstack()
    # a cut can fall anywhere in a round of the sources, so counts are within two
    assert (table.max(axis=1) - table.min(axis=1)).max() <= 2
    again = interleaved_shards(spark, docs.repartition(7), 8).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert out[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_written_shards(spark, tmp_path):
    docs = spark.range(100).selectExpr("id as doc_id", "concat('t', id) as text", "'a' as source")
    write_shards(spark, docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.groupBy("shard").count().filter("count = 25").count() == 4


def test_shards_and_mix_of_nothing(spark, empty):
    docs = spark.read.parquet(empty)
    assert interleaved_shards(spark, docs, 8).collect() == []
    assert mixing.mix_sources(spark, docs).collect() == [] and mixing.mixed_documents(spark, docs).collect() == []


def test_mix(spark, odd, rows):
    out = mixing.mix_sources(spark, spark.read.parquet(odd)).collect()
    size = lambda t: len(brute.WORDS.findall((t or "").encode()))
    assert brute.counted((r.doc_id, r["size"]) for r in out) == brute.counted((i, size(t)) for i, t in pairs(rows))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r[1]) for r in rows if r[3] == s) for s in sources]
    targets = mixing.capped_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], Fraction(3, 2) * sum(sizes), 2)
    for s, n, t in zip(sources, sizes, targets):
        own = [r for r in out if r.source == s]
        assert {r.source_size for r in own} == {n} and all(abs(r.target - t) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - t) <= max(3, 0.02 * t)
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        assert sum(x.to - x["from"] for x in r.ranges) == r.taken


def keyed(spark, rows, seed):
    """(id, source, text) with the seeded key of their order."""
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    key = F.xxhash64(F.lit(seed), "doc_id").alias("key")
    tk, crc = F.xxhash64("text").alias("tk"), F.crc32(F.col("text").cast("binary")).alias("crc")
    return docs, docs.select("doc_id", "source", "text", key, tk, crc).collect()


def some_rows(n):
    rng = np.random.default_rng(n)
    return [(i * 13 % 997, "aabbbcdé"[int(rng.integers(0, 8))], "w " * int(rng.integers(0, 60))) for i in range(n)]


@pytest.mark.parametrize("n,shards", [(1, 8), (7, 8), (300, 8), (301, 3)])
def test_interleaving_against_a_plain_version(spark, n, shards):
    docs, rows = keyed(spark, some_rows(n), 17)
    line = []
    for source in {r.source for r in rows}:
        own = sorted((r for r in rows if r.source == source), key=lambda r: (r.key, r.doc_id, r.crc, len(r.text)))
        line += [((2 * k + 1) / (2 * len(own)), source.encode(), k, r) for k, r in enumerate(own)]
    line.sort(key=lambda x: x[:3])
    want, slots = {}, {}
    for place, (*_, r) in enumerate(line):
        shard = place * shards // n
        slots[shard] = slots.get(shard, -1) + 1
        want[r.doc_id] = (shard, slots[shard], len(r.text) + 1)
    got = {r.doc_id: (r.shard, r.slot, r["size"]) for r in interleaved_shards(spark, docs, shards).collect()}
    assert got == want


@pytest.mark.parametrize("n,block", [(1, 1024), (40, 3), (400, 16)])
def test_mixing_against_a_plain_version(spark, n, block):
    docs, rows = keyed(spark, some_rows(n), 29)
    sources = sorted({r.source for r in rows}, key=str.encode)
    own = [sorted((r for r in rows if r.source == s), key=lambda r: (r.key, r.doc_id, r.tk, len(r.text))) for s in sources]
    sizes = [sum(len(r.text.split()) for r in x) for x in own]
    targets = mixing.capped_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(own))], Fraction(3, 2) * sum(sizes), 2)
    block = max(1, min(block, min((int(t) for t in targets if t), default=0) // 256))
    want, got_blocks, seats = {}, [0] * len(own), int(sum(targets)) // block
    words = [[(r.doc_id, k) for r in x for k in range(len(r.text.split()))] * 2 for x in own]
    for seat in range(seats):  # block by block to the highest quotient
        free = [i for i in range(len(own)) if targets[i] and got_blocks[i] < 2 * sizes[i] // block]
        if not free:
            break
        i = max(free, key=lambda i: (targets[i] / (2 * got_blocks[i] + 1), -i))
        for w in words[i][got_blocks[i] * block:(got_blocks[i] + 1) * block]:
            want[w[0]] = want.get(w[0], 0) + 1
        got_blocks[i] += 1
    out = mixing.mix_sources(spark, docs, block=1024 if n == 1 else block).collect()
    assert {r.doc_id: r.taken for r in out if r.taken} == want


def test_targets_are_capped_and_the_excess_shared():
    t = mixing.capped_targets([10, 100, 1000], [5, 2, 1], Fraction(1665), 2)
    assert t == [20, 200, 1445] and mixing.capped_targets([0, 0], [5, 2], Fraction(0), 2) == [0, 0]


def test_sainte_lague_by_hand():
    assert mixing.sainte_lague([Fraction(53), Fraction(24), Fraction(23)], [9, 9, 9], 1, 7) == [[3, 2, 2]]
    halves = mixing.sainte_lague([Fraction(5), Fraction(2), Fraction(1)], [99] * 3, 4, 80)
    whole = mixing.sainte_lague([Fraction(5), Fraction(2), Fraction(1)], [99] * 3, 1, 80)[0]
    assert [sum(q[i] for q in halves) for i in range(3)] == whole == [50, 20, 10]


def test_small_sources_reach_their_targets(spark):
    rows = [(i, "word " * 20000, f"big{i % 3}") for i in range(150)] + [(1000 + i, "a few words here now", "small") for i in range(4)]
    out = mixing.mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in {r[2] for r in rows}:
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 <= own[0].target


def test_each_shard_selects_its_quota_of_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "word " * int(rng.integers(0, 900)), "abcde"[min(int(rng.integers(0, 9)), 4)]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix_sources(spark, docs, shards=8, block=64).collect()
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abcde"}
    quotas = mixing.apportion(list(sizes.values()), shards=8, block=64)
    got = {}
    for r in out:
        assert r.block == quotas.block == 64
        for x in r.ranges:
            got[x.shard, r.source] = got.get((x.shard, r.source), 0) + x.to - x["from"]
    assert got == {(s, "abcde"[i]): n * 64 for s, own in enumerate(quotas.shards) for i, n in enumerate(own) if n}
    # the ranges of a source and pass cover each word once
    for source, size in sizes.items():
        for turn in range(2):
            own = sorted((r.doc_id, x["from"], x.to) for r in out if r.source == source for x in r.ranges if x["pass"] == turn)
            assert all(a[0] != b[0] or a[2] == b[1] for a, b in zip(own, own[1:]))
            assert sum(b - a for _, a, b in own) <= size


def test_sainte_lague_of_many_seats():
    votes = [Fraction(v) for v in (5 * 10**9, 10**9, 2000, 10000, 1, 0)]
    (quotas,) = mixing.sainte_lague(votes, [10**10] * 6, 1, int(sum(votes)))
    assert quotas == votes
    for seats in range(60):
        votes, most = [Fraction(v) for v in (53, 24, 23, 7, 7, 0)], [9, 30, 3, 5, 9, 9]
        got = [0] * 6
        for _ in range(seats):
            free = [i for i in range(6) if got[i] < most[i] and votes[i]]
            if free:
                got[max(free, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
        assert mixing.sainte_lague(votes, most, 1, seats) == [got]


def test_written_shards_hold_every_row(spark, tmp_path):
    """Columns named like the folders, null and repeated identifiers, rows alike in everything."""
    rows = [(1, "a b", "x", 9), (1, "a b", "x", 9), (None, "c", None, 8), (None, None, "x", None), (2, "d", "y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(3)
    write_shards(spark, docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter(tuple(r)[:4] for r in back.select("doc_id", "text", "source", "shard").collect()) == Counter(rows)
    counts = Counter(r.shard_ for r in back.collect())
    assert set(counts) == {0, 1, 2} and max(counts.values()) - min(counts.values()) <= 1


def test_mixed_documents_have_the_words_taken(spark, odd):
    docs = spark.read.parquet(odd)
    out = mixing.mixed_documents(spark, docs)
    assert out.columns == docs.columns
    words = sum(len(brute.WORDS.findall(r.text.encode())) for r in out.collect())
    assert words == sum(r.taken for r in mixing.mix_sources(spark, docs).collect())


def test_mixed_documents_are_whole_but_for_one_a_source(spark):
    # white space of several kinds
    texts = {i: f"  Title {i}\n\n" + "\tsome  words\n of it\n" * (50 + i % 40) for i in range(600)}
    rows = [(i, t, "abc"[i % 3]) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_documents(spark, docs).collect()
    cut = [r for r in out if r.text != texts[r.doc_id]]
    assert len({r.source for r in cut}) == len(cut)
    assert all(texts[r.doc_id].startswith(r.text) for r in cut)
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(spark, docs).collect()}
    words = dict.fromkeys(texts, 0)
    for r in out:
        words[r.doc_id] += len(r.text.split())
    assert words == taken


# --- 7

def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + rng.normal(size=16) * (0.05 if i % 3 else 0.25)).tolist()) for i in range(300)]
    rows += [(300 + i, base[0].tolist()) for i in range(30)] + [(330, (base[0] * 5).tolist())]
    rows += [(400, None), (401, [0.0] * 16), (402, [1.0, None] + [0.0] * 14), (403, [float("nan")] * 16),
             (404, [float("inf")] + [0.0] * 15), (405, []), (406, base[0][:8].tolist()), (407, base[0][:8].tolist()),
             (None, base[0].tolist()), (5, rows[5][1])]
    return rows


def test_near_embeddings(spark):
    data = [(i, v, 1, 2, 3) for i, v in vectors()]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, n_links int, v int, key int").repartition(4)
    out = embedding_dedup.near_embeddings(spark, table, block=16).collect()
    assert len(out) == len(data)
    ok = [(i, np.array(v)) for i, v, *_ in data
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    degree, links = {}, []
    for a, (i, x) in enumerate(ok):
        for j, y in ok[:a]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links.append((i, j))
                degree[i] = degree.get(i, 0) + 1
                degree[j] = degree.get(j, 0) + 1
    ids = {i for i, _ in ok}
    want = brute.joined(links, ids)
    got = {r.vec_id: r for r in out}
    # an identifier that repeats counts its rows apart; its links are those of either row
    single = [i for i in ids if i != 5]
    assert all(got[i].n_links <= degree.get(i, 0) for i in single)
    assert sum(got[i].n_links for i in single) >= 0.97 * sum(degree.get(i, 0) for i in single)
    assert np.mean([got[i].component_id == want[i] for i in ids]) >= 0.97
    for i in (400, 401, 402, 403, 404, 405):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert got[406].n_links == got[407].n_links == 1 and got[None].component_id is None


def test_near_embeddings_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_embeddings(spark, table).collect() == []


def test_e8_decoding_is_nearest():
    x = np.random.default_rng(0).normal(size=(500, 8)) * 2
    p = embedding_dedup.nearest_e8(x)
    assert np.allclose(p * 2, np.rint(p * 2)) and np.allclose(p.sum(axis=1) % 2, 0)
    own = ((x - p) ** 2).sum(axis=1)
    for step in embedding_dedup.shortest_e8():
        assert (own <= ((x - p - step) ** 2).sum(axis=1) + 1e-9).all()
    assert len(embedding_dedup.shortest_e8()) == 240


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    x = embedding_dedup._unit(rng.normal(size=(800, 64)).tolist())
    z = rng.normal(size=(800, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (embedding_dedup.cells(v, 8, 2.0, 5) for v in (x, y))
    assert (embedding_dedup.first_meeting(a, b) != 0).mean() >= 0.97


# --- 8

def test_licenses(spark, odd, empty):
    out = licenses.scan_licenses(spark, spark.read.parquet(odd)).collect()
    assert [(r.doc_id, r.license, r.start, r.end, r.n_diff) for r in out] == [(13, "MIT", 0, 30, 0)]
    assert licenses.scan_licenses(spark, spark.read.parquet(empty)).collect() == []


@pytest.mark.parametrize("name,i", [(n, i) for n, ts in licenses.TEMPLATES.items() for i in range(len(ts))])
def test_every_template_is_found_in_a_text(name, i):
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.1)
    words = licenses.TEMPLATES[name][i].split(" ")
    wrapped = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
    hits = scanner.scan(f"Some words before.\n{wrapped}\nand some after.")
    assert [h[0] for h in hits] == [name] and hits[0][5] == 0


def test_other_wordings():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.1)
    assert scanner.scan("They talk of a licence to drive and of permission.") == []
    long = licenses.TEMPLATES["MIT"][2].replace("free of charge", "without charge")
    (hit,) = scanner.scan(long)
    assert hit[0] == "MIT" and 0 < hit[5] <= 3 and "without" in hit[6]
    assert [h[0] for h in scanner.scan("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]


@pytest.mark.parametrize("name,i", [(n, i) for n, ts in licenses.TEMPLATES.items() for i in range(len(ts))])
def test_every_template_is_found_within_a_long_line(name, i):
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.1)
    words = [f"word{k * k % 9973}" for k in range(5000)]
    text = " ".join([*words[:2500], licenses.TEMPLATES[name][i], *words[2500:]])
    (hit,) = scanner.scan(text)
    assert hit[:2] == (name, i) and hit[4] > 0 and hit[5] == 0


def test_many_templates_in_one_line():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.1)
    rows = [(n, i, t) for n, ts in licenses.TEMPLATES.items() for i, t in enumerate(ts)]
    hits = scanner.scan(" and also other words here. ".join(t for *_, t in rows))
    assert [h[:2] for h in hits] == [r[:2] for r in rows] and all(h[5] == 0 for h in hits)


@pytest.mark.parametrize("columns", [20, 30, 40, 50, 60])
def test_narrowly_wrapped_templates(spark, columns):
    rows = [(n, i, t) for n, ts in licenses.TEMPLATES.items() for i, t in enumerate(ts)]
    texts = ["# " + "\n# ".join(textwrap.wrap(t, columns)) for *_, t in rows]
    texts += [t.replace(" ", "\n") for *_, t in rows]
    # without its only cue, within the differences allowed
    texts.append(licenses.TEMPLATES["Unlicense"][0].replace("public", "open"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = sorted((r.doc_id, r.license, r.template, r.n_diff) for r in licenses.scan_licenses(spark, docs).collect())
    want = [(n, i, 0) for n, i, _ in rows] * 2 + [("Unlicense", 0, 1)]
    assert hits == [(k, *w) for k, w in enumerate(want)]


def test_licenses_of_one_family_are_told_apart():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.1)
    gnu = licenses.TEMPLATES["GPL-3.0"][1]
    assert [h[0] for h in scanner.scan(gnu.replace("General", "Affero General"))] == ["AGPL-3.0"]
    assert [h[0] for h in scanner.scan(gnu.replace("General", "Lesser General"))] == ["LGPL-3.0"]
    assert scanner.scan(gnu.replace("version 3", "version 4")) == []
    assert [h[0] for h in scanner.scan(licenses.TEMPLATES["GPL-2.0"][1].replace("General", "Library General"))] == []
    two, three = licenses.TEMPLATES["BSD-2-Clause"][0], licenses.TEMPLATES["BSD-3-Clause"][0]
    end = " THIS SOFTWARE IS PROVIDED AS IS"
    assert [h[0] for h in scanner.scan(two + end)] == ["BSD-2-Clause"]
    assert [h[0] for h in scanner.scan(three + end)] == ["BSD-3-Clause"]


def test_licenses_against_every_template_at_every_word():
    """Brute force: each template aligned with each window of the words."""
    rng = np.random.default_rng(9)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.1)
    rows = [(n, i, t) for n, ts in licenses.TEMPLATES.items() for i, t in enumerate(ts)]
    vocabulary = sorted({w for *_, t in rows for w in licenses.WORDS.findall(t)})
    for _ in range(25):
        words = rng.choice(vocabulary, 60).tolist()
        if rng.random() < 0.8:
            planted = licenses.WORDS.findall(rows[rng.integers(len(rows))][2])
            if rng.random() < 0.5:
                planted[int(rng.integers(len(planted)))] = "other"
            words[20:20] = planted
        found = [w.lower() for w in words]
        best = {}
        for k, (name, i, _) in enumerate(rows):
            costs = [c for c, _ in licenses.endings(found, scanner.words[k])]
            if min(costs) <= scanner.most[k]:
                best[name, i] = min(costs)
        got = {(h[0], h[1]): h[5] for h in scanner.scan(" ".join(words))}
        assert all(best.get(k) is not None and best[k] <= n for k, n in got.items())
        # what is not told is overlapped by something told, or is of another license by its marks
        if best and not got:
            assert all(n > 0 for n in best.values())


def test_a_notice_twice_in_one_line():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.1)
    for name, i, one, other in (("Apache-2.0", 1, "", ""), ("MIT", 2, "charge", "cost")):
        text = licenses.TEMPLATES[name][i]
        for between in (" ", " and once more: "):
            hits = scanner.scan(text + between + text.replace(one, other))
            assert [h[:3] for h in hits] == [(name, i, 0), (name, i, len(text + between))]


def test_changed_wordings_anywhere():
    rng = np.random.default_rng(8)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.1)
    for name, i, n in (("MIT", 2, 6), ("BSD-3-Clause", 0, 2), ("ISC", 0, 3)):
        for _ in range(10):
            words = licenses.WORDS.findall(licenses.TEMPLATES[name][i])
            for k in sorted(rng.choice(np.arange(1, len(words) - 1), n, replace=False))[::-1]:
                words[k : k + 1] = [[], ["other"], [words[k], "added"]][rng.integers(3)]
            hits = scanner.scan("filler words " * 400 + " ".join(words) + " more words" * 400)
            assert len(hits) == 1 and hits[0][:2] == (name, i) and 0 < hits[0][5] <= n


# --- 9

@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(spark, odd, rows, batches, fanout):
    out = line_dedup(spark, spark.read.parquet(odd), batches=batches, fanout=fanout, carry=("lang",)).collect()
    assert brute.counted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out) == brute.counted(brute.line_dedup(pairs(rows)))
    assert {r.carried.lang for r in out} == {"en", None}


def test_line_dedup_of_nothing(spark, empty):
    assert line_dedup(spark, spark.read.parquet(empty)).collect() == []


# --- 10

def test_personal_data(spark, odd, rows, empty):
    out = pii.find_personal_data(spark, spark.read.parquet(odd)).collect()
    got = brute.counted((r.doc_id, ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.spans if x.base)) for r in out)
    assert got == brute.counted((i, ",".join(brute.personal(t))) for i, t in pairs(rows))
    assert pii.find_personal_data(spark, spark.read.parquet(empty)).collect() == []


TRICKY = [
    "a@b.c_x@y.org", "@a.b c@d", "x@y..z", "a@b-c.d-e.f@g.h", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "1.2.3",
    "4111-1111 1111-1111 9", "4111  1111 1111 1111", "+1 (234) 567-8901.", "+12", "++12345678901", "+1234567890123456",
    "+49 30 1234567 +49 30 7654321", "12345678901234567890123", "é é@b.cc ✉ +1 212 555 0199 日", "." * 50 + "@a.b",
    "7" * 20000, "a" * 20000, "a." * 9000 + "@", "+" + "1 " * 9000, "1 " * 9000 + "1",
]


def test_tricky_personal_data(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    out = pii.find_personal_data(spark, docs).collect()
    for r in out:
        assert [f"{x.kind}:{x.start}:{x.end}" for x in r.spans if x.base] == brute.personal(TRICKY[r.doc_id])


def test_hidden_personal_data_is_added(spark):
    texts = [f"Please write to jane.doe{i} (at) mail{i} (dot) example (dot) com today" for i in range(30)]
    texts += [f"mail bob{i}@mail.example.com or phone +1 (212) 555-{1000 + i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.find_personal_data(spark, docs).collect()
    assert sum(any(not x.base and x.kind == "email" for x in r.spans) for r in out if r.doc_id < 30) >= 27


def test_em_trusts_agreeing_labelers():
    post = pii.rate_labelers({(2, 2, 2, 2): 500, (0, 0, 1, 0): 400, (2, 2, 1, 2): 300, (0, 1, 1, 0): 100})
    assert post[2, 2, 1, 2] > 0.9 and post[0, 0, 1, 0] < 0.1


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50])
def test_spans_of_many_matches(spark, n):
    text = " ".join(f"a{i}@b.example and 10.0.{i % 256}.9" for i in range(n))
    (row,) = pii.find_personal_data(spark, spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    want = [(m.start(), m.end()) for m in re.finditer(r"a[0-9]+@b.example|10[.0-9]+", text)]
    assert [(x.start, x.end) for x in row.spans] == want


def test_spans_of_a_text_with_a_hundred_thousand_matches(spark):
    text = " ".join(f"a{i}@b.example" for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = pii.find_personal_data(spark, docs).select(F.size("spans").alias("n"), F.element_at("spans", -1).alias("x")).collect()
    assert (row.n, row.x.end) == (100_000, len(text))


def test_looser_patterns_find_and_reject(spark):
    """Candidates beyond the base patterns: the classifier takes those that look like personal
    data and leaves those that the labelers speak against."""
    rows = [f"please call tel (030) 123-{4500 + i} today" for i in range(60)]
    rows += [f"contact mail jan.k{i}(at)mail(dot)example.com now" for i in range(60)]
    rows += [f"login from host fe80:0:0:0:1:2:3:{i:x} again" for i in range(60)]
    rows += [f"visa card 4111.1111.1111.1111 used {i}" for i in range(60)]
    rows += [f"order version 0000/1234/{1000 + i}/99{i:02d}x of the part" for i in range(60)]
    rows += [f"see isbn 0000.1111.2222.33{i:02d} of the book" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: [(x.kind, x.base) for x in r.spans] for r in pii.find_personal_data(spark, docs).collect()}
    share = lambda kind, a: np.mean([(kind, False) in found[i] for i in range(a, a + 60)])
    assert share("phone", 0) == share("email", 60) == share("ip", 120) == share("card", 180) == 1
    assert all(found[i] == [] for i in range(240, 360))
