"""Quality classifier from weak labels: EM rates heuristic labellers, and their posterior
trains a hashed linear scorer."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, small_batches
from .hashing import U, mix, slices, words

# Very common words of the languages the labeller knows.
COMMON = frozenset(
    "the of and to in is that it for as with was on be by this are or an at from which "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et à un une du en que qui dans pour par sur est au il elle "
    "el los las de y en un una que por con para del se su al lo como".split()
)
GOOD, BAD, SILENT = 2, 0, 1


def _defect(share: float, bad_above: float) -> int:
    """A labeller that looks for one defect says nothing about texts without it."""
    return BAD if share > bad_above else SILENT


def label_symbols(t: str, w: list[str]) -> int:
    return _defect(sum(map(t.count, "#$%&*~^|<>{}[]\\")) / len(w), 0.2)


def label_capitals(t: str, w: list[str]) -> int:
    return _defect(sum(map(str.isupper, w)) / len(w), 0.25)


def label_shouting(t: str, w: list[str]) -> int:
    return _defect((t.count("!!") + t.count("??")) / len(w), 0.1)


def label_stutter(t: str, w: list[str]) -> int:
    return _defect(sum(map(eq, w, w[1:])) / len(w), 0.15)


def label_lists(t: str, w: list[str]) -> int:
    return _defect((t.count(" | ") + t.count(" > ") + t.count(" / ")) / len(w), 0.15)


def label_common_words(t: str, w: list[str]) -> int:
    share = sum(map(COMMON.__contains__, w)) / len(w)
    return GOOD if share >= 0.1 else BAD if share < 0.03 and len(w) >= 20 else SILENT


def label_repeated_lines(t: str, w: list[str]) -> int:
    lines = t.split("\n")
    return _defect(1 - len(set(lines)) / len(lines), 0.6) if len(lines) > 3 else SILENT


def label_word_length(t: str, w: list[str]) -> int:
    mean = sum(map(len, w)) / len(w)
    return GOOD if 3 <= mean <= 10 else BAD if mean > 14 or mean < 2 else SILENT


def label_runs(t: str, w: list[str]) -> int:
    longest = max((sum(1 for _ in run) for _, run in groupby(w)), default=0)
    return _defect(longest, 4)


def label_variety(t: str, w: list[str]) -> int:
    """Of pairs of neighbouring words, how many are not the same again."""
    if len(w) < 20:
        return SILENT
    share = len(set(zip(w, w[1:]))) / (len(w) - 1)
    return GOOD if share >= 0.6 else BAD if share < 0.3 else SILENT


LABELLERS = (
    label_symbols, label_capitals, label_shouting, label_stutter, label_lists, label_common_words,
    label_repeated_lines, label_word_length, label_runs, label_variety,
)
#: What is held of a labeller before any text is seen: how often it says BAD, nothing, GOOD of a
#: bad and of a good text. This counts as much as ``strength`` of all texts would, at any size.
PRIOR = np.array([[0.25, 0.5, 0.25], [0.01, 0.55, 0.44]])


def votes(text: str) -> int:
    """All votes as one number in base 3. A text without words is bad to all."""
    w = text.split()
    code = 0
    for label in LABELLERS:
        code = code * 3 + (label(text, w) if w else BAD)
    return code


def unpack(code: int) -> tuple[int, ...]:
    return tuple(code // 3**i % 3 for i in range(len(LABELLERS) - 1, -1, -1))


def rate_labellers(
    counts: dict[int, int], rounds: int = 200, strength: float = 0.1, good: float = 0.9,
) -> tuple[dict[int, float], np.ndarray]:
    """EM over vote patterns: the probability of good quality per pattern, and each labeller's
    rates of the three votes on bad and on good texts, as (labeller, class, vote).

    The rates are those of largest posterior probability under Dirichlet priors of the mean
    ``PRIOR``, the share of good texts that under a prior of the mean ``good``."""
    codes = sorted(counts)
    v = np.array([unpack(c) for c in codes], dtype=np.int64).reshape(len(codes), len(LABELLERS))
    n = np.array([counts[c] for c in codes], dtype=float)
    weight = strength * max(n.sum(), 1.0)
    rates = np.tile(PRIOR, (len(LABELLERS), 1, 1))
    mass = np.array([1 - good, good])
    post = np.zeros(len(codes))
    for _ in range(rounds):
        log = np.tile(np.log(mass), (len(codes), 1))
        for j in range(len(LABELLERS)):
            log += np.log(rates[j][:, v[:, j]]).T
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        moved = np.abs(new - post).max(initial=0)
        post = new
        if moved < 1e-10:
            break
        mass = np.array([(n * (1 - post)).sum(), (n * post).sum()]) + weight * np.array([1 - good, good])
        mass /= mass.sum()
        for j in range(len(LABELLERS)):
            seen = np.stack([np.bincount(v[:, j], weights=n * q, minlength=3) for q in (1 - post, post)])
            rates[j] = seen + weight * PRIOR
            rates[j] /= rates[j].sum(axis=1, keepdims=True)
    return dict(zip(codes, post.tolist())), rates


BITS = 18
_CLASS = np.zeros(256, dtype=np.uint8)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = ord("a") if _c.islower() and _i < 128 or _i >= 128 else ord("A") if _c.isupper() else ord("0") if _c.isdigit() else _i
_TABLE = _CLASS.tobytes()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, one after the other, and where each text's begin: words,
    shapes of words (letters by case, digits, other bytes as they are), and whether a word
    repeats the one before, has capitals alone, or is no word at all."""
    hashes, edges = words(texts)
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.int64), edges
    # the case survives as another letter, since hashing lower-cases
    shapes, _ = words([t.translate(_TABLE).replace(b"A", b"\x01") for t in texts])
    repeat = np.zeros(n, dtype=U)
    repeat[1:] = hashes[1:] == hashes[:-1]
    where = np.repeat(np.arange(len(texts)), np.diff(edges))
    repeat[1:][where[1:] != where[:-1]] = 0
    shift = U(64 - BITS)
    f = np.stack([mix(hashes) >> shift, mix(shapes + U(1)) >> shift, mix(repeat + U(2)) >> shift], axis=1)
    return f.astype(np.int64).ravel(), edges * 3


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        raw = [(t or "").encode() for t in texts]
        out = np.zeros(len(raw))
        for a, z in slices(raw):
            f, edges = features(raw[a:z])
            sums = np.concatenate([[0.0], np.cumsum(self.weights[f], dtype=np.float64)])[edges]
            count = np.diff(edges)
            mean = np.diff(sums) / np.maximum(count, 1)
            out[a:z] = np.where(count > 0, 1 / (1 + np.exp(-np.clip(mean + self.bias, -500, 500))), 0.0)
        return out


def train_scorer(texts: list[str | None], target: np.ndarray, steps: int = 300, rate: float = 4.0, l2: float = 1e-6, min_texts: int = 5) -> Scorer:
    """Logistic regression of the soft labels on mean feature weights, by Adagrad."""
    index, value, row = [], [], []
    raw = [(t or "").encode() for t in texts]
    for a, z in slices(raw):
        f, edges = features(raw[a:z])
        for i in range(z - a):
            own = f[edges[i]:edges[i + 1]]
            if len(own):
                ids, n = np.unique(own, return_counts=True)
                index.append(ids), value.append(n / len(own)), row.append(np.full(len(ids), a + i))
    weights, bias = np.zeros(1 << BITS, dtype=np.float64), 0.0
    if not index:
        return Scorer(weights.astype(np.float32), -1.0)
    index, value, row = map(np.concatenate, (index, value, row))
    # what few texts hold would only be learned by heart
    common = np.bincount(index, minlength=1 << BITS)[index] >= min_texts
    index, value, row = index[common], value[common], row[common]
    weight = 1 / max(len(target), 1)
    seen, seen_bias = np.full(len(weights), 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(row, weights[index] * value, minlength=len(target)) + bias
        gap = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target)
        slope = np.bincount(index, gap[row] * value, minlength=len(weights)) + l2 * weights
        seen += slope * slope
        weights -= rate * slope / np.sqrt(seen)
        seen_bias += gap.sum() ** 2
        bias -= 0.5 * gap.sum() / math.sqrt(seen_bias)
    return Scorer(weights.astype(np.float32), float(bias))


def fit_quality(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000,
) -> Scorer:
    """Train the scorer. Labellers vote on every document; only counts per vote pattern, at
    most 3^10 of them, reach the driver, and EM rates the labellers on these. The linear scorer
    is then fitted on at most ``sample_rows`` whole documents, the first by a hash of
    identifier and text, with the posteriors of their patterns as labels.

    Null text is empty, and bad to all labellers, as is one without words. Repeated rows and
    ties in the hash count each; rows equal in identifier and text are alike, so reruns see
    the same sample in the same order. From an empty table comes a scorer that rejects."""

    @F.pandas_udf("int")
    def vote(text: pd.Series) -> pd.Series:
        return text.map(votes)

    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(column(id_col).alias("id"), text.alias("text"))
    small_batches(spark)
    counts = {r["code"]: r["n"] for r in rows.select(vote("text").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    post, _ = rate_labellers(counts)
    total = sum(counts.values())
    # the first rows by hash: all below a bound that lets about as many through as are wanted
    part = rows.withColumn("h", F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)))
    bound = 1_000_000 if total <= sample_rows else int(1_000_000 * 0.9 * sample_rows / total) + 1
    sample = part.filter(F.col("h") < bound).orderBy("h", "id", "text").limit(sample_rows)
    sample = sample.select("text").toPandas()["text"].tolist() if total else []
    target = np.array([post.get(votes(t), 0.0) for t in sample])
    return train_scorer(sample, target)


def score_quality(docs: DataFrame, scorer: Scorer, text_col: str = "text", score: str = "score") -> DataFrame:
    """Add the probability of good quality of each whole text, 0 if it is null or has no words.
    Every row keeps its columns and stays once; a column named as ``score`` is replaced."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in parts:
            yield pd.Series(scorer.score(text.tolist()))

    return docs.withColumn(score, run(F.coalesce(column(text_col), F.lit(""))))


def classify_quality(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = 0.5, sample_rows: int = 2000,
) -> DataFrame:
    """Score every document and keep those of at least ``threshold``.

    Null text is empty; a text without words has the score 0. Repeated rows get the same
    score. A null identifier changes only what the sample holds. An empty table gives no rows.
    Other columns are not read.

    Returns doc_id, score, kept.
    """
    scorer = fit_quality(spark, docs, id_col, text_col, sample_rows)
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    return score_quality(rows, scorer).select("doc_id", "score", (F.col("score") >= threshold).alias("kept"))
