"""Strings as integers that keep their order: common prefix, charset, fixed-width codes.

Codes work on UTF-8 bytes. With p the common prefix and c the least byte that follows it,
each byte after p becomes (byte - c) in as few bits as the charset needs; short strings are
padded with c, and the length is kept beside the code."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StringConfig:
    prefix: str
    low: int
    high: int
    bits: int
    length: int

    @property
    def total_bits(self) -> int:
        return self.bits * self.length

    @property
    def width(self) -> int:
        """64, 128 or 256 bits; what does not fit raises instead of being cut."""
        for w in (64, 128, 256):
            if self.total_bits <= w:
                return w
        raise ValueError(f"{self.length} bytes of {self.bits} bits exceed 256 bits")


def shift_bits(low: int, high: int) -> int:
    """Bits per byte of a charset, one at least."""
    return max(1, (high - low).bit_length())


def common_prefix(df: DataFrame, column: str) -> DataFrame:
    """The longest common prefix: what the least and the greatest string share. A single
    string is its own prefix; no string has none."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    n = F.least(F.length("a"), F.length("b"))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.expr("a").substr(F.lit(1), i) == F.expr("b").substr(F.lit(1), i))
    return ends.select(F.when(n > 0, F.expr("a").substr(F.lit(1), F.size(same))).otherwise("").alias("prefix"))


def _codes(text: Column) -> Column:
    """The bytes of a string as an array of integers."""
    hexed = F.hex(text.cast("binary"))
    return F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(
        F.substring(hexed, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))


def charset(df: DataFrame, column: str) -> DataFrame:
    """Least and greatest byte of all strings."""
    codes = F.when(F.octet_length(column) > 0, _codes(F.col(column)))
    return df.select(F.array_min(codes).alias("lo"), F.array_max(codes).alias("hi")).agg(
        F.min("lo").alias("low"), F.max("hi").alias("high"))


def auto_configure(df: DataFrame, column: str) -> StringConfig:
    """Prefix, charset and length of a column, in two aggregations."""
    prefix = common_prefix(df, column).first()["prefix"] or ""
    rest = df.select(F.expr(f"substring({column}, {len(prefix) + 1})").alias("s"))
    chars = charset(rest, "s").first()
    length = rest.agg(F.max(F.octet_length("s")).alias("n")).first()["n"] or 0
    low, high = chars["low"] or 0, chars["high"] or 0
    return StringConfig(prefix, low, high, shift_bits(low, high), length)


def encode_shift(text: Column, config: StringConfig) -> Column:
    """Code of up to 63 bits as a BIGINT, built-in functions only."""
    if config.total_bits > 63:
        raise ValueError(f"{config.total_bits} bits do not fit; use encode_wide")
    rest = F.substring(text, F.lit(len(config.prefix) + 1), F.length(text))
    shift = lambda acc, c: F.shiftleft(acc, config.bits) + (c - config.low)
    code = F.aggregate(F.when(F.octet_length(rest) > 0, _codes(rest)).otherwise(F.array().cast("array<int>")),
                       F.lit(0).cast("long"), shift)
    return F.call_function("shiftleft", code, (F.lit(config.length) - F.octet_length(rest)) * config.bits)


def decode_shift(code: Column, length: Column, config: StringConfig) -> Column:
    """The string of a code and its number of bytes after the prefix."""
    mask = (1 << config.bits) - 1
    at = lambda i: F.call_function("shiftrightunsigned", code, (F.lit(config.length) - i) * config.bits)
    byte = lambda i: F.lpad(F.hex(at(i).bitwiseAND(mask) + config.low), 2, "0")
    hexed = F.array_join(F.transform(F.sequence(F.lit(1), length), byte), "")
    text = F.concat(F.lit(config.prefix), F.when(length > 0, F.decode(F.unhex(hexed), "UTF-8")).otherwise(""))
    return F.when(code.isNotNull() & length.isNotNull(), text)


def _packed(texts: pd.Series, config: StringConfig) -> np.ndarray:
    """Codes of whole texts as rows of big-endian bytes; null texts as if they were empty."""
    skip, low = len(config.prefix.encode()), bytes([config.low])
    raw = b"".join(("" if t is None else t).encode()[skip:].ljust(config.length, low) for t in texts)
    if len(raw) != len(texts) * config.length:
        raise ValueError(f"a text has more than {config.length} bytes after the prefix")
    codes = np.frombuffer(raw, dtype=np.uint8).reshape(len(texts), config.length, 1) - np.uint8(config.low)
    bits = np.unpackbits(codes, axis=2)[:, :, 8 - config.bits:].reshape(len(texts), -1)
    return np.packbits(np.pad(bits, ((0, 0), (config.width - bits.shape[1], 0))), axis=1)


def _unpacked(codes: np.ndarray, lengths: pd.Series, config: StringConfig) -> pd.Series:
    bits = np.unpackbits(codes, axis=1)[:, config.width - config.total_bits:]
    bits = np.pad(bits.reshape(len(codes), config.length, config.bits), ((0, 0), (0, 0), (8 - config.bits, 0)))
    raw = (np.packbits(bits, axis=2)[:, :, 0] + np.uint8(config.low)).tobytes()
    n = config.length
    return pd.Series([
        None if pd.isna(size) else config.prefix + raw[i * n : i * n + int(size)].decode() for i, size in enumerate(lengths)])


def encode_wide(config: StringConfig):
    """A pandas UDF for codes of any width: fixed-width big-endian bytes, which sort as the
    strings do. Null gives null."""
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        rows = _packed(texts, config)
        return pd.Series([None if t is None else row.tobytes() for t, row in zip(texts, rows)], dtype=object)

    return run


def decode_wide(config: StringConfig):
    @F.pandas_udf("string")
    def run(codes: pd.Series, lengths: pd.Series) -> pd.Series:
        empty = bytes(config.width // 8)
        raw = b"".join(empty if c is None else c for c in codes)
        text = _unpacked(np.frombuffer(raw, dtype=np.uint8).reshape(len(codes), -1), lengths, config)
        return text.where(codes.notna(), None)

    return run


def limbs(config: StringConfig) -> int:
    """Signed 64-bit numbers that a code needs."""
    return 1 if config.total_bits <= 63 else config.width // 64


def encode_limbs(config: StringConfig):
    """A pandas UDF that gives a wide code as ``limbs`` numbers of 64 bits, highest first."""
    names = [f"l{i}" for i in range(limbs(config))]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_packed(texts, config).view(">i8").astype(np.int64).reshape(len(texts), len(names)), columns=names)

    return run


def decode_limbs(config: StringConfig):
    """A pandas UDF from the numbers of a wide code, none of them null, and its length to the
    string; a null length gives null."""
    @F.pandas_udf("string")
    def run(parts: pd.DataFrame, lengths: pd.Series) -> pd.Series:
        rows = np.ascontiguousarray(parts.to_numpy(dtype=np.int64).astype(">i8"))
        return _unpacked(rows.view(np.uint8).reshape(len(parts), -1), lengths, config)

    return run


def alphabet(df: DataFrame, column: str, skip: int = 0) -> list[int]:
    """The different bytes of all strings after ``skip`` characters, in order: 256 at most."""
    rest = F.substring(F.col(column), F.lit(skip + 1), F.length(column))
    codes = df.filter(F.octet_length(rest) > 0).select(F.explode(F.array_distinct(_codes(rest))).alias("c")).distinct()
    return sorted(r["c"] for r in codes.collect())


def encode_base(text: Column, letters: list[int], length: int) -> Column:
    """A string of up to ``length`` bytes as a number in base M, M the size of the alphabet,
    padded with the first letter. A byte that is no letter counts as the letter before it, or
    as the first. The codes must fit 62 bits."""
    if len(letters) ** length > 1 << 62:
        raise ValueError(f"{length} letters out of {len(letters)} exceed 62 bits")
    known = F.array(*map(F.lit, letters))
    place = lambda c: F.greatest(F.size(F.filter(known, lambda a: a <= c)) - 1, F.lit(0))
    digits = F.when(F.octet_length(text) > 0, F.transform(_codes(text), place)).otherwise(F.array().cast("array<int>"))
    padded = F.concat(digits, F.array_repeat(F.lit(0), F.lit(length) - F.octet_length(text)))
    return F.aggregate(padded, F.lit(0).cast("long"), lambda n, d: n * len(letters) + d)


def decode_base(code: Column, n: Column, letters: list[int], length: int) -> Column:
    """The first ``n`` bytes of the string of such a number."""
    powers = F.array(*(F.lit(len(letters) ** (length - 1 - i)).cast("long") for i in range(length)))
    known = F.array(*(F.lit(f"{x:02X}") for x in letters))
    # what is left of the number after the powers above, in whole numbers only
    digit = lambda i: F.call_function("div", code % (F.element_at(powers, i) * len(letters)), F.element_at(powers, i))
    hexed = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(known, digit(i).cast("int") + 1))
    return F.when(n > 0, F.decode(F.unhex(F.array_join(hexed, "")), "UTF-8")).otherwise("")


def padding_bounds(text: Column, config: StringConfig) -> tuple[Column, Column]:
    """Least and greatest code of any string that begins with this one."""
    full = len(config.prefix) + config.length
    return (encode_shift(F.rpad(text, full, chr(config.low)), config),
            encode_shift(F.rpad(text, full, chr(config.high)), config))


def encode_ascii(text: Column) -> Column:
    """The first eight bytes as one unsigned number."""
    raw = F.rpad(F.hex(F.substring(text.cast("binary"), 1, 8)), 16, "0")
    return F.conv(raw, 16, 10).cast("decimal(20,0)")


def decode_ascii(code: Column) -> Column:
    """The bytes of such a number, without the zero bytes at its end."""
    raw = F.lpad(F.conv(code.cast("string"), 10, 16), 16, "0")
    return F.rtrim(F.decode(F.unhex(raw), "UTF-8"), F.lit("\0"))


def partition_size(size: int) -> int:
    """Rows of a partition of strings, rounded up to 32."""
    return -(-size // 32) * 32


def compress(df: DataFrame, pos: str, column: str, strategy: str = "FIXED", size: int = 2048) -> tuple[DataFrame, DataFrame, StringConfig]:
    """A string column as blocks of codes and blocks of lengths, with what decodes them. Codes
    of up to 63 bits are one column of numbers; those of 64, 128 or 256 bits are 1, 2 or 4,
    told apart by ``limb``, 0 the highest."""
    from ..operators.codec import Config, encode

    config = auto_configure(df, column)
    rows = df.select(F.col(pos).alias("pos"), F.col(column).alias("text"))
    how = Config(strategy=strategy, size=partition_size(size))
    if config.total_bits <= 63:
        codes = encode(rows.select("pos", encode_shift(F.col("text"), config).alias("code")), "pos", "code", how)
        codes = codes.withColumn("limb", F.lit(0))
    else:
        parts = rows.select("pos", encode_limbs(config)("text").alias("x"))
        each = [encode(parts.select("pos", f"x.l{i}"), "pos", f"l{i}", how).withColumn("limb", F.lit(i)) for i in range(limbs(config))]
        codes = reduce(DataFrame.unionByName, each)
    lengths = rows.select("pos", (F.octet_length("text") - len(config.prefix.encode())).cast("long").alias("length"))
    return codes, encode(lengths, "pos", "length", how), config


def _text(limb: dict[int, Column], length: Column, config: StringConfig) -> Column:
    if config.total_bits <= 63:
        return decode_shift(limb[0], length.cast("int"), config)
    # numbers beside nulls would come to Python as floats, which do not hold 64 bits
    parts = F.struct(*(F.coalesce(limb[i], F.lit(0).cast("long")).alias(f"l{i}") for i in sorted(limb)))
    known = reduce(lambda a, b: a & b, (c.isNotNull() for c in limb.values()))
    return decode_limbs(config)(parts, F.when(known, length))


def decompress(codes: DataFrame, lengths: DataFrame, config: StringConfig) -> DataFrame:
    from ..operators.codec import decode

    rows = decode(lengths, value="length")
    for i in range(limbs(config)):
        rows = rows.join(decode(codes.filter(F.col("limb") == i), value=f"l{i}"), "pos")
    return rows.select("pos", _text({i: F.col(f"l{i}") for i in range(limbs(config))}, F.col("length"), config).alias("value"))


def fetch_strings(codes: DataFrame, lengths: DataFrame, config: StringConfig, requests: DataFrame) -> DataFrame:
    """Strings at the requested positions, of any width; null where there is no such position.
    Only blocks that are asked for are decoded."""
    from ..operators.access import fetch_encoded

    rows = fetch_encoded(lengths, requests).withColumnRenamed("value", "n")
    for i in range(limbs(config)):
        part = fetch_encoded(codes.filter(F.col("limb") == i), requests).select("ordinal", F.col("value").alias(f"l{i}"))
        rows = rows.join(part, "ordinal")
    return rows.select("ordinal", "pos", _text({i: F.col(f"l{i}") for i in range(limbs(config))}, F.col("n"), config).alias("value"))


def reverse_host(address: Column) -> Column:
    """user@mail.example.com as com.example.mail@user; without an @, the text itself."""
    host = F.array_join(F.reverse(F.split(F.substring_index(address, "@", -1), r"\.")), ".")
    return F.when(F.instr(address, "@") > 0, F.concat(host, F.lit("@"), F.substring_index(address, "@", 1))).otherwise(address)


def normalize_address(address: Column) -> Column:
    return F.lower(F.regexp_replace(address, r"^\s+|\s+$", ""))
