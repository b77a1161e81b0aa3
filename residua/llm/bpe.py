"""Byte-level BPE with forced boundaries.

Two neighbouring bytes that stand next to each other in no token of the vocabulary can never
be merged, so a cut between them is certain. Pieces of text are split at these cuts, the
fragments are encoded one by one, and the ids are concatenated.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, packed

# Fixed value: the piece pattern of the byte-level vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces up to this many bytes are remembered, and this many of them.
REMEMBER_BYTES, REMEMBER = 64, 1 << 19
SLICE_ROWS = 64
NEVER = (1 << 62, -1)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file, by the usual rule: printable
    Latin-1 letters stand for themselves, the other bytes follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as the vocabulary file says, without the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        vocab = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        self.tokens: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in vocab.items():
            self.tokens[i] = t
        for t, i in special.items():
            self.tokens[i] = t.encode()
        self.special = special
        self.vocab = vocab
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = raw(a), raw(b)
            self.ranks[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.joined = np.zeros((256, 256), dtype=bool)
        for t in vocab:
            for a, b in zip(t, t[1:]):
                self.joined[a, b] = True
        self.rows = [row.tobytes() for row in self.joined]
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memory: dict[str, bytes] = {}

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece cut wherever two bytes meet that no token joins."""
        if len(piece) < 2:
            return [piece] if piece else []
        if len(piece) <= REMEMBER_BYTES:
            cuts = [i for i, (a, b) in enumerate(zip(piece, piece[1:]), 1) if not self.rows[a][b]]
        else:
            b = np.frombuffer(piece, dtype=np.uint8)
            cuts = (np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1).tolist()
        if not cuts:
            return [piece]
        edges = [0, *cuts, len(piece)]
        return [piece[a:z] for a, z in zip(edges, edges[1:])]

    def merge(self, fragment: bytes) -> list[int]:
        """Merge neighbours, lowest rank first and leftmost among equals, in n log n steps."""
        ids: list[int] = [self.single[b] for b in fragment]
        n, ranks = len(ids), self.ranks
        if n <= 24:
            pairs = [ranks.get(p, NEVER) for p in zip(ids, ids[1:])]
            while pairs and (best := min(pairs)) is not NEVER:
                at = pairs.index(best)
                ids[at:at + 2] = [best[1]]
                del pairs[at]
                if at:
                    pairs[at - 1] = ranks.get((ids[at - 1], best[1]), NEVER)
                if at < len(pairs):
                    pairs[at] = ranks.get((best[1], ids[at + 1]), NEVER)
            return ids
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []
        for i in range(n - 1):
            if r := ranks.get((ids[i], ids[i + 1])):
                heap.append((r[0], i, r[1], ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := ranks.get((new, ids[k])):
                    heapq.heappush(heap, (r[0], i, r[1], new, ids[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((ids[h], new))):
                heapq.heappush(heap, (r[0], h, r[1], ids[h], new))
        return [t for t in ids if t >= 0]

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        known = self.memory.get(piece)
        if known is not None:
            return known
        raw = piece.encode()
        ids = [i for part in self.fragments(raw) for i in self.merge(part)]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= REMEMBER_BYTES:
            if len(self.memory) >= REMEMBER:
                self.memory.clear()
            self.memory[piece] = out
        return out

    def _plain(self, text: str) -> bytes:
        memory, slow = self.memory, self.piece
        return b"".join([memory.get(p) or slow(p) for p in self.pieces.findall(text)])

    def encode(self, text: str) -> bytes:
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at:m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(
    spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Encode each whole text and decode the ids again.

    ``tokenizer`` is the path of a byte-level BPE vocabulary file in the format of the
    tokenizers library, present on every machine. Special tokens' strings in a text become
    their ids, as that library does. A worker holds a slice of a few rows at a time and a
    bounded memory of pieces; nothing is shuffled.

    Null text is empty and gives no ids. Repeated rows give repeated results; an empty table
    gives no rows. Columns other than those named in ``carry`` are not read.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded, carried (a
    struct of ``carry``).
    """
    rows = docs.select(
        column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"),
        packed(carry).alias("carried"),
    )
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.StringType()), rows.schema["carried"],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = [own.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string()), part.column(2)],
                    schema.names,
                )

    return rows.mapInArrow(run, schema)
