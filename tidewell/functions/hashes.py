"""Hashes and integer codes whose values matter: rolling polynomial, MurmurHash3 x86-32 and x86-128, 7-bit and prefix varints, bloom
filters.

For partitioning, joins and dedup use Spark's own xxhash64; these serve where exact values are asked for.
"""

from __future__ import annotations

from math import floor, log

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

M64, M32 = (1 << 64) - 1, (1 << 32) - 1


def rolling(word: bytes, base: int = 101) -> int:
    """Sum of signed byte i times base**i, modulo 2**64."""
    out, power = 0, 1
    for b in word:
        out = (out + (b - 256 if b > 127 else b) * power) & M64
        power = power * base & M64
    return out


@F.pandas_udf(T.LongType())
def rolling_hash(words: pd.Series) -> pd.Series:
    """rolling() of UTF-8 strings as a signed bigint, a column at a time."""
    raw = [w.encode() if isinstance(w, str) else b"" for w in words]
    width = max(map(len, raw), default=0)
    out, power = np.zeros(len(raw), np.uint64), np.uint64(1)
    table = np.zeros((len(raw), width), np.int8)
    for k, r in enumerate(raw):
        table[k, : len(r)] = np.frombuffer(r, np.int8)
    with np.errstate(over="ignore"):
        for j in range(width):
            out += table[:, j].astype(np.int64).view(np.uint64) * power
            power *= np.uint64(101)
    return pd.Series(out.view(np.int64)).where(words.notna().to_numpy(), None)


def murmur3_32(key: bytes, seed: int = 0) -> int:
    """MurmurHash3_x86_32."""
    h, n = seed, len(key) // 4 * 4
    rot = lambda x, r: (x << r | x >> (32 - r)) & M32
    scramble = lambda k: rot(k * 0xCC9E2D51 & M32, 15) * 0x1B873593 & M32
    for i in range(0, n, 4):
        h = (rot(h ^ scramble(int.from_bytes(key[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & M32
    if key[n:]:
        h ^= scramble(int.from_bytes(key[n:], "little"))
    h ^= len(key)
    for r, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> r) * m & M32
    return h ^ h >> 16


#: Of each of the four lanes: (multiplier, turn) of a word before and after its turn, the turn of the lane, what it adds.
LANES = ((0x239B961B, 15, 0xAB0E9789, 19, 0x561CCD1B), (0xAB0E9789, 16, 0x38B34AE5, 17, 0x0BCAA747), (0x38B34AE5, 17, 0xA1E38B93, 15, 0x96CD1C35), (0xA1E38B93, 18, 0x239B961B, 13, 0x32AC3B17))


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint32(r) | x >> np.uint32(32 - r)


def murmur3_128(keys: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash3_x86_128 of each key as two 64-bit numbers: lanes 0 and 1, lanes 2 and 3, the lower one in the lower half. Keys of
    one length go through together."""
    out = np.zeros((len(keys), 4), np.uint32)
    sizes = np.array([len(k) for k in keys], dtype=np.int64)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        width = -(-n // 16) * 16
        words = np.frombuffer(b"".join(keys[r].ljust(width, b"\0") for r in rows), dtype="<u4").reshape(len(rows), -1)
        h = np.full((4, len(rows)), seed, np.uint32)
        with np.errstate(over="ignore"):
            for block in range(0, width // 4, 4):
                for lane, (a, r, b, turn, plus) in enumerate(LANES):
                    h[lane] ^= _turn(words[:, block + lane] * np.uint32(a), r) * np.uint32(b)
                    if block * 4 + 16 <= n:
                        h[lane] = (_turn(h[lane], turn) + h[(lane + 1) % 4]) * np.uint32(5) + np.uint32(plus)
            h ^= np.uint32(n)
            for last in (False, True):
                h[0] += h[1] + h[2] + h[3]
                h[1:] += h[0]
                if not last:
                    for r, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
                        h = (h ^ h >> np.uint32(r)) * np.uint32(m)
        out[rows] = h.T
    return out.view("<u8") if len(keys) else np.zeros((0, 2), np.uint64)


@F.pandas_udf(T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))
def murmur_hash(words: pd.Series) -> pd.DataFrame:
    """murmur3_128() of UTF-8 strings in ASCII lower case, as signed bigints; null of null."""
    found = murmur3_128([w.encode().lower() if isinstance(w, str) else b"" for w in words]).view(np.int64)
    some = words.notna().to_numpy()
    return pd.DataFrame({"low": pd.Series(found[:, 0]).where(some), "high": pd.Series(found[:, 1]).where(some)}).astype("Int64")


class Bloom:
    """A filter of bits over lower-cased strings with the bits (low + i * high) modulo size of their murmur3_128(): the visited set's
    approximate form. Saved and read as bytes; filters of one size are united by or."""

    def __init__(self, keys: int, rate: float, data: bytes | None = None) -> None:
        self.size, self.hashes = bloom_size(keys, rate)
        self.bits = np.frombuffer(data, np.uint8).copy() if data is not None else np.zeros(-(-self.size // 8), np.uint8)

    def places(self, words: list[str]) -> np.ndarray:
        h = murmur3_128([w.encode().lower() for w in words])
        with np.errstate(over="ignore"):
            return (h[:, :1] + np.arange(self.hashes, dtype=np.uint64) * h[:, 1:]) % np.uint64(self.size)

    def add(self, words: list[str]) -> None:
        at = self.places(words).ravel()
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def might_hold(self, words: list[str]) -> np.ndarray:
        at = self.places(words)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def __or__(self, other: Bloom) -> Bloom:
        out = Bloom.__new__(Bloom)
        out.size, out.hashes, out.bits = self.size, self.hashes, self.bits | other.bits
        return out

    def save(self) -> bytes:
        return self.bits.tobytes()


def _each(code, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else code(int(x)) for x in n], dtype=object)


@F.pandas_udf(T.BinaryType())
def varint_column(n: pd.Series) -> pd.Series:
    """varint() of a column of non-negative numbers (below 2**53 in a column with nulls); null of null."""
    return _each(varint, n)


@F.pandas_udf(T.ArrayType(T.LongType()))
def varints_column(data: pd.Series) -> pd.Series:
    """varints() of a binary column; null of null."""
    return pd.Series([varints(x) if x is not None else None for x in data], dtype=object)


@F.pandas_udf(T.BinaryType())
def prefixed_column(n: pd.Series) -> pd.Series:
    """prefixed() of a column of non-negative numbers below 2**61; null of null."""
    return _each(prefixed, n)


def varint(n: int) -> bytes:
    """7-bit groups, highest first; the high bit marks the last."""
    out = [n & 127 | 128]
    while n := n >> 7:
        out.append(n & 127)
    return bytes(reversed(out))


def varints(data: bytes) -> list[int]:
    out, n = [], 0
    for b in data:
        n = n << 7 | b & 127
        if b & 128:
            out.append(n)
            n = 0
    return out


def prefixed(n: int) -> bytes:
    """A byte whose upper 3 bits count the bytes after it and whose lower 5 hold the number's top, then the rest, lowest first."""
    extra = (n.bit_length() + 2) // 8
    return bytes([extra << 5 | n >> 8 * extra]) + (n & (1 << 8 * extra) - 1).to_bytes(extra, "little")


def unprefixed(data: bytes) -> tuple[int, int]:
    """The number at the front of data and its size in bytes."""
    extra = data[0] >> 5
    return (data[0] & 31) << 8 * extra | int.from_bytes(data[1 : 1 + extra], "little"), 1 + extra


def varint_size(n: Column) -> Column:
    """Bytes that varint() takes."""
    return F.when(n == 0, 1).otherwise(F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def bloom_size(keys: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a bloom filter for so many keys at a false-positive rate."""
    bits = floor(-keys * log(rate) / log(2) ** 2)
    return bits, floor(bits / keys * log(2))
