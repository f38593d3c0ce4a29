"""Sets that answer membership: exact semi-joins, and binary fuse filters where an approximate answer will do.

A filter has three segments' worth of fingerprints; a key belongs if the fingerprints at its three places combine to its
own. No key is missed. Filters are built for hash shards of bounded size, so no shard grows with the data. They are
broadcast in blocks of bounded size, each asked about the rows of its own shards; how many blocks there are changes
nothing that is found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.hashes import fingerprint, mix_split, splitmix64

U64 = np.uint64
DTYPES = {8: np.uint8, 16: np.uint16, 32: np.uint32}
TRIES, SEED, SHARD_KEYS, BROADCAST_BYTES = 100, 0x726B2B9D438B9D4D, 1 << 20, 64 << 20


def layout(n: int) -> tuple[int, int, int]:
    """(segment length, segments that keys are spread over, fingerprints) for n keys."""
    segment = 1 if n == 0 else min(1 << 18, 1 << math.floor(math.log(n) / math.log(3.33) + 2.25))
    capacity = 0 if n <= 1 else math.floor(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)) + 0.5)
    count = max(1, -(-capacity // segment) - 2)
    return segment, count, (count + 2) * segment


class BinaryFuse:
    """A set of distinct 64-bit keys, with fingerprints of 8, 16 or 32 bits."""

    def __init__(self, keys: np.ndarray, bits: int = 8) -> None:
        keys = np.asarray(keys, U64)
        self.bits, self.n = bits, len(keys)
        self.segment, self.count, size = layout(self.n)
        self.prints, self.seed = np.zeros(size, DTYPES[bits]), 0
        state = SEED
        for _ in range(TRIES):
            state, self.seed = splitmix64(state)
            if not self.n or self._fill(mix_split(keys, self.seed)):
                return
        raise ValueError("keys are not distinct")

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Three places of each hash, a row for each."""
        wide = U64(self.count * self.segment)
        low, high = h & U64(0xFFFFFFFF), h >> U64(32)
        first = (high * wide + ((low * wide) >> U64(32))) >> U64(32)  # the high half of the product
        mask, step = U64(self.segment - 1), U64(self.segment)
        return np.stack([first, (first + step) ^ ((h >> U64(18)) & mask), (first + step + step) ^ (h & mask)]).astype(np.int64)

    def _fill(self, h: np.ndarray) -> bool:
        """Peels places that one key alone has, all of a round at once; then assigns the rounds backwards."""
        places, rows = self._places(h), np.arange(len(h))
        degree, owner = np.zeros(len(self.prints), np.int64), np.zeros(len(self.prints), np.int64)
        for p in places:
            np.add.at(degree, p, 1)
            np.bitwise_xor.at(owner, p, rows)
        rounds, left, alone = [], len(h), np.flatnonzero(degree == 1)
        while len(alone):
            keys, at = np.unique(owner[alone], return_index=True)
            rounds.append((keys, alone[at]))
            left -= len(keys)
            mine = places[:, keys]
            for p in mine:
                np.subtract.at(degree, p, 1)
                np.bitwise_xor.at(owner, p, keys)
            alone = np.unique(mine.ravel())
            alone = alone[degree[alone] == 1]
        if left:
            return False
        marks = fingerprint(h).astype(self.prints.dtype)
        for keys, at in reversed(rounds):  # a round's own places are those of its keys alone
            a, b, c = places[:, keys]
            self.prints[at] = marks[keys] ^ self.prints[a] ^ self.prints[b] ^ self.prints[c]
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(keys), bool)
        h = mix_split(np.asarray(keys, U64), self.seed)
        a, b, c = self._places(h)
        return fingerprint(h).astype(self.prints.dtype) == self.prints[a] ^ self.prints[b] ^ self.prints[c]

    @classmethod
    def of(cls, keys: Iterable[int], bits: int = 8) -> "BinaryFuse":
        """A filter of keys that come one by one."""
        return cls(np.fromiter(keys, U64), bits)

    @property
    def n_bytes(self) -> int:
        return self.prints.nbytes


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key, by a hash that any engine has."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(shards)).cast("int")


def high_shard(key: Column, shards: int) -> Column:
    """The shard of a key that is a hash, by its high bits."""
    return (F.shiftrightunsigned(key, 40) % shards).cast("int")


def build(keys: DataFrame, key: str = "key", bits: int = 8, shard_keys: int = SHARD_KEYS, by: Callable[[Column, int], Column] = shard_of) -> tuple[DataFrame, int]:
    """(shard, n_keys, seed, prints), and how many shards there are. Keys are made distinct first."""
    rows = keys.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct()
    shards = max(1, math.ceil(rows.count() / shard_keys))
    schema = pa.schema([("shard", pa.int32()), ("n_keys", pa.int64()), ("seed", pa.string()), ("prints", pa.binary())])

    def one(table: pa.Table) -> pa.Table:
        f = BinaryFuse(table["key"].to_numpy().view(U64), bits)
        return pa.table([[table["shard"][0].as_py()], [f.n], [str(f.seed)], [f.prints.tobytes()]], schema=schema)

    sharded = rows.select("key", by(F.col("key"), shards).alias("shard"))
    return sharded.groupBy("shard").applyInArrow(one, "shard int, n_keys long, seed string, prints binary"), shards


class Sharded:
    """Filters by the high bits of keys that are hashes."""

    def __init__(self, held: dict[int, BinaryFuse], shards: int) -> None:
        self.held, self.shards = held, shards

    def contains(self, keys: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(keys), bool), (keys >> U64(40)) % U64(self.shards)
        for s, f in self.held.items():
            at = np.flatnonzero(shard == U64(s))
            out[at] = f.contains(keys[at])
        return out


def _read(rows: Iterable, bits: int) -> dict[int, BinaryFuse]:
    held: dict[int, BinaryFuse] = {}
    for r in rows:
        f = held[r["shard"]] = BinaryFuse.__new__(BinaryFuse)
        f.bits, f.n, f.seed = bits, r["n_keys"], int(r["seed"])
        (f.segment, f.count, _), f.prints = layout(f.n), np.frombuffer(r["prints"], DTYPES[bits])
    return held


def sharded(keys: DataFrame, bits: int = 8, most_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS):
    """A broadcast of one filter of all keys, which are hashes; None if it is larger than most_bytes."""
    distinct = keys.distinct().persist(StorageLevel.DISK_ONLY)
    built, shards = build(distinct, "key", bits, shard_keys, high_shard)
    try:
        if shards * layout(shard_keys)[2] * bits / 8 > max(most_bytes, layout(shard_keys)[2] * bits / 8):
            return None
        return keys.sparkSession.sparkContext.broadcast(Sharded(_read(built.collect(), bits), shards))
    finally:
        distinct.unpersist()


def members(rows: DataFrame, keys: DataFrame, key: str = "key", bits: int = 16, exact: bool = False, most_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """rows whose key is among keys: by filters, with a few more, or exactly if that is asked for."""
    if exact:
        return semi(rows, keys.distinct(), key)
    return marked(rows, keys, "__sonca_in", key, bits, most_bytes, shard_keys).where("__sonca_in").drop("__sonca_in")


def marked(rows: DataFrame, keys: DataFrame, name: str, key: str = "key", bits: int = 16, most_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """rows whose key is not null, with `name`: whether filters have the key. All keys are true, and a few others.

    Filters are taken in blocks of at most most_bytes (a shard at least); each reads the rows, and keeps those of its own
    shards. The keys are made once, for their number and for the filters.
    """
    distinct = keys.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct().persist(StorageLevel.DISK_ONLY)
    filters, shards = build(distinct, "key", bits, shard_keys)
    filters, out = filters.persist(StorageLevel.DISK_ONLY), None
    each = max(1, int(most_bytes / (layout(shard_keys)[2] * bits / 8)))
    shard = shard_of(F.col(key).cast("long"), shards)
    for first in range(0, shards, each):
        held = _read(filters.where(F.col("shard").between(first, first + each - 1)).collect(), bits)  # at most most_bytes, or one shard
        own = rows.where(F.col(key).isNotNull())
        own = own if shards <= each else own.where(shard.between(first, first + each - 1))
        found = own.withColumn(name, _among(rows.sparkSession.sparkContext.broadcast(held))(F.col(key).cast("long"), shard))
        out = found if out is None else out.unionByName(found)
    filters.unpersist()
    distinct.unpersist()
    return out


def _among(shared):
    @F.pandas_udf(BooleanType())
    def among(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for k, shard in parts:
            out, k, shard = np.zeros(len(k), bool), k.to_numpy(), shard.to_numpy()
            order = np.argsort(shard, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(at) and (f := shared.value.get(int(shard[at[0]]))):
                    out[at] = f.contains(k[at].astype(np.int64).view(U64))
            yield pd.Series(out)

    return among


def semi(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The exact form: rows whose key is among keys."""
    return rows.join(keys.select(key), key, "left_semi")


def hash_counts(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """hash, fp, n_count: counts of arrays of 16-bit ids that are told apart by two hashes, and never kept themselves.

    Both hashes are column functions over the ids (FNV-1a, from two starts), so counting stays one aggregation.
    """
    fold = lambda start: F.aggregate(F.col(ids), F.lit(start).cast("long"), lambda h, x: (h.bitwiseXOR(x.cast("long")) * 0x01000193).bitwiseAND(0xFFFFFFFF))
    return rows.groupBy(fold(0x9DC5811C).alias("hash"), fold(0x811C9DC5).bitwiseAND(0xFFFF).alias("fp")).agg(F.count(F.lit(1)).alias("n_count"))


def in_hash_order(counts: DataFrame) -> DataFrame:
    """hash, fp, n_count in ascending order of the hash."""
    return counts.orderBy("hash", "fp")
