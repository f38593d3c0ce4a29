"""32- and 64-bit hashes over numpy arrays and bytes, and Arrow UDFs of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .columns import let

U32, U64 = np.uint32, np.uint64
#: Fixed values of the published algorithms: FNV-1a, Murmur3 and its finaliser, SplitMix64, and a multiply-shift family.
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193
MURMUR = (0xCC9E2D51, 0x1B873593, 0xE6546B64)
MIX32 = (0x85EBCA6B, 0xC2B2AE35)
MIX64 = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SHIFT1, SHIFT2 = (0x65D200CE55B19AD8, 0x4F2162926E40C299, 0x162DD799029970F8), (0x68B665E6872BD1F4, 0xB6CFCF9D79B51DB2, 0x7A2B92AE912898C2)
MASK32, MASK64 = (1 << 32) - 1, (1 << 64) - 1


def fnv1a32(units: bytes | list[int], start: int = FNV_OFFSET) -> int:
    """Over bytes, or over longer units such as 16-bit ids."""
    h = start
    for x in units:
        h = (h ^ x) * FNV_PRIME & MASK32
    return h


def xxh32(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh32_intdigest(data, seed)


def _rotated(x: int, right: int) -> int:
    return (x >> right | x << (32 - right)) & MASK32


def _mur(a: int, h: int) -> int:
    a = _rotated(a * MURMUR[0] & MASK32, 17) * MURMUR[1] & MASK32
    return (_rotated(h ^ a, 19) * 5 + MURMUR[2]) & MASK32


def mix32(h: int) -> int:
    """The 32-bit Murmur3 finaliser."""
    for shift, by in zip((16, 13), MIX32, strict=True):
        h = (h ^ h >> shift) * by & MASK32
    return h ^ h >> 16


def city32(data: bytes) -> int:
    """CityHash32 of at most 12 bytes."""
    n = len(data)
    if n > 12:
        raise ValueError("at most 12 bytes")
    if n < 5:
        b, c = 0, 9
        for x in data:
            b = (b * MURMUR[0] + (x - 256 if x > 127 else x)) & MASK32
            c ^= b
        return mix32(_mur(b, _mur(n, c)))
    word = lambda at: int.from_bytes(data[at : at + 4], "little")
    d = n * 5
    a, b, c = (n + word(0)) & MASK32, (d + word(n - 4)) & MASK32, (9 + word(n >> 1 & 4)) & MASK32
    return mix32(_mur(c, _mur(b, _mur(a, d))))


def murmur64(x: np.ndarray) -> np.ndarray:
    """The 64-bit Murmur3 finaliser of a uint64 array."""
    for by in MIX64:
        x = (x ^ (x >> U64(33))) * U64(by)
    return x ^ (x >> U64(33))


def mix_split(keys: np.ndarray, seed: int) -> np.ndarray:
    return murmur64(keys + U64(seed))


def rotl64(x: int, by: int) -> int:
    by &= 63
    return (x << by | x >> (64 - by)) & MASK64 if by else x


def reduce32(h: int, n: int) -> int:
    """A hash scaled to 0..n-1."""
    return (h & MASK32) * n >> 32


def fingerprint(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> U64(32))


def splitmix64(state: int) -> tuple[int, int]:
    """(the next state, the number drawn)."""
    state = (state + SPLITMIX[0]) & MASK64
    z = state
    for shift, by in zip((30, 27), SPLITMIX[1:], strict=True):
        z = (z ^ z >> shift) * by & MASK64
    return state, z ^ z >> 31


def _linear(x: int, k: tuple[int, int, int], low: int) -> int:
    return (k[0] * low + k[1] * (x >> 32) + k[2]) & MASK64


def multiply_shift32(x: int, second: bool = False) -> int:
    return _linear(x, SHIFT2 if second else SHIFT1, x & MASK32) >> 32


def multiply_shift64(x: int) -> int:
    """Two such hashes side by side; here the low part is the whole number."""
    return _linear(x, SHIFT1, x) >> 32 | _linear(x, SHIFT2, x) & 0xFFFFFFFF00000000


def of_text(name: str, seed: int = 0) -> Column:
    """A UDF over a string column's UTF-8 bytes: fnv1a32, xxh32 or city32 (null for null, and for city32 over 12 bytes)."""
    one = {"fnv1a32": fnv1a32, "xxh32": lambda b: xxh32(b, seed), "city32": lambda b: city32(b) if len(b) <= 12 else None}[name]

    @F.pandas_udf(LongType())
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else one(t.encode()) for t in texts], dtype="Int64")

    return hashed


def fnv1a32_column(text: Column) -> Column:
    """FNV-1a-32 of a string's UTF-8 bytes by column functions alone."""
    step = lambda h, x: (h.bitwiseXOR(x) * FNV_PRIME).bitwiseAND(MASK32)
    unit = lambda raw, i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    units = let(F.hex(F.encode(text, "UTF-8")), lambda raw: F.when(F.length(raw) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.length(raw) / 2 - 1, F.lit(0)).cast("int")), lambda i: unit(raw, i))).otherwise(F.array().cast("array<bigint>")))
    return F.aggregate(units, F.lit(FNV_OFFSET).cast("long"), step)
