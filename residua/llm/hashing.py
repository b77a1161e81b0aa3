"""Hashes of words and word shingles over many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x + _STEP
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U))
_PLACE = mix(np.arange(1000, 1064, dtype=U)) | U(1)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and where each text's words begin (one more
    entry than texts). Words are runs of bytes other than ASCII white space; A-Z count as a-z."""
    buf = b"\n".join([*texts, b""]).lower()
    a = np.frombuffer(buf, dtype=np.uint8)
    blank = _SPACE[a]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    ends = np.cumsum([0] + [len(t) + 1 for t in texts])
    edges = np.searchsorted(starts, ends)
    if not len(starts):
        return np.zeros(0, dtype=U), edges
    lengths = np.diff(np.append(starts, len(a)))
    lead = int(starts[0])
    offset = np.arange(lead, len(a), dtype=np.int64) - np.repeat(starts, lengths)
    power = np.cumprod(np.full(int(offset.max()) + 1, 0x2545F4914F6CDD1D, dtype=U))
    value = _BYTE[a[lead:]] * power[offset]
    value[blank[lead:]] = 0
    return mix(np.add.reduceat(value, starts - lead)), edges


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``width`` words; a text of fewer
    words has its whole sequence as its only shingle, one without words has none."""
    hashes, edges = words(texts)
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        rolled = np.zeros(n, dtype=U)
        for i in range(width):
            rolled += hashes[i : i + n] * _PLACE[i]
        rolled = mix(rolled)
    out = []
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if z - a >= width:
            out.append(np.unique(rolled[a : z - width + 1]))
        elif z > a:
            short = (hashes[a:z] * _PLACE[32 : 32 + z - a]).sum(keepdims=True) + U(z - a)
            out.append(mix(short))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def slices(texts: list[bytes], most: int = 1 << 16) -> list[tuple[int, int]]:
    """Stretches of texts of about ``most`` bytes together, one text at least."""
    out, at, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append((at, i))
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        out.append((at, len(texts)))
    return out
