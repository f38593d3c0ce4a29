"""Each word of each text with how often its type stands in all texts. A text is read once, and its words are not shuffled.

A task reads its texts in slices. Of a slice it passes on two things: its words as codes, and for each bucket of types
those that the slice has, with their counts. Buckets sum the counts and answer each slice, where codes become rows again.
A type travels once for a slice, however often it stands there, so a frequent one is no more work than others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan

#: Words of a slice, about; buckets for each input split; rows that are passed on at once.
WORDS, BUCKETS, ROWS = 1 << 20, 4, 1 << 16

_FIELDS = "slice long, place long, size long, raw long, words binary, figures binary"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


class _Slice:
    """What is read of a task's texts until it is passed on."""

    def __init__(self) -> None:
        self.held: dict[str, int] = {}
        self.n, self.codes, self.masks, self.sizes, self.ids = 0, [], [], [], []

    def add(self, ids: pa.Array, texts: list[str | None]) -> None:
        starts, t = scan._flat(texts, scan.tokens_of)
        own = np.array([self.held.setdefault(x, len(self.held)) if scan.is_word(x) else -1 for x in t.dictionary.to_pylist()], np.int32)
        codes = own[t.indices.to_numpy()]
        self.masks.append(codes >= 0)
        self.codes.append(codes[self.masks[-1]])
        self.sizes.append(np.diff(starts))
        self.ids.append(ids)
        self.n += len(self.codes[-1])

    def rows(self, number: int, buckets: int) -> pa.RecordBatch:
        """A row for the slice, in a place of its own under 0, and one for each bucket, whose place is its number. Codes
        count the types from bucket to bucket."""
        bucket = np.array([zlib.crc32(x.encode()) % buckets for x in self.held], np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        codes, places = rank[np.concatenate(self.codes)], bucket[order]
        counts = np.bincount(codes, minlength=len(order)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(places) != 0)), len(places))
        types = pa.array(self.held, pa.string()).take(pa.array(order))
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), types)
        # the bytes of codes lie apart, as the upper ones are nearly all 0
        texts = [np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes(), *pc.binary_join(lists, " ").cast(pa.binary()).to_pylist()]
        figures = [np.concatenate(self.sizes).tobytes() + np.packbits(np.concatenate(self.masks)).tobytes(), *(counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:]))]
        codec, ids, n = pa.Codec("zstd", 1), pa.concat_arrays(self.ids), len(texts)
        columns = [np.full(n, number), np.append(-1 - number, places[cuts[:-1]]), np.append(len(codes), np.diff(cuts)), [len(x) for x in texts]]
        blobs = [[codec.compress(x, asbytes=True) for x in texts], figures]
        kept = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * n, pa.int32()), ids)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), *(pa.array(x, pa.binary()) for x in blobs), kept], names=[*_NAMES, "ids"])


def _types(table: pa.Table) -> pa.Array:
    """The types of all rows of a table."""
    codec = pa.Codec("zstd")
    texts = [codec.decompress(x, n, asbytes=True).decode() for x, n in zip(table["words"].to_pylist(), table["raw"].to_pylist(), strict=True)]
    return pc.split_pattern(pa.array(texts, pa.large_string()), " ").flatten().cast(pa.string())


def _figures(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.int64) for x in table["figures"].to_pylist()])


def _answered(table: pa.Table) -> pa.Table:
    """The rows of a place; of a bucket, with the counts of all slices."""
    if table["place"][0].as_py() < 0:
        return table
    coded = _types(table).dictionary_encode()
    codes = coded.indices.to_numpy()
    sums = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(sums, codes, _figures(table))
    ends = list(accumulate(table["size"].to_pylist()))
    totals = [sums[codes[a:b]].tobytes() for a, b in zip([0, *ends], ends)]
    return table.set_column(_NAMES.index("figures"), "figures", pa.array(totals, pa.binary()))


def _opened(table: pa.Table, key: str) -> Iterator[pa.RecordBatch]:
    """key, pos, token, n from the rows of a slice."""
    table = table.sort_by("place")
    own, asked = table.slice(0, 1), table.slice(1)
    ids, (own,) = own["ids"].combine_chunks().flatten(), own.select(_NAMES).to_pylist()
    n = own["size"]
    types, totals = _types(asked), _figures(asked)
    planes = np.frombuffer(pa.Codec("zstd").decompress(own["words"], own["raw"], asbytes=True), np.uint8)
    codes = np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32).ravel()
    sizes = np.frombuffer(own["figures"], np.int64, len(ids))
    words = np.flatnonzero(np.unpackbits(np.frombuffer(own["figures"], np.uint8, offset=8 * len(ids)), count=int(sizes.sum())))
    ends = np.cumsum(sizes)
    row = np.searchsorted(ends, words, side="right")
    pos = (words - (ends - sizes)[row]).astype(np.int32)
    for i in range(0, n, ROWS):
        part, code = slice(i, i + ROWS), codes[i : i + ROWS]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[part])), pa.array(pos[part]), types.take(pa.array(code)), pa.array(totals[code])], names=[key, "pos", "token", "n"])


def with_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = WORDS) -> DataFrame:
    """key, pos, token, n: each word with how often its type stands in all texts; pos counts all tokens of a text from 0.

    A slice has about `most` words, and whole texts.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    buckets = BUCKETS * max(1, rows.rdd.getNumPartitions())

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, _Slice()
        for batch in stream:
            for first, texts in scan._slices(batch.column(1)):
                held.add(batch.column(0).slice(first, len(texts)), texts)
                if held.n >= most:
                    yield held.rows(number, buckets)
                    number, held = number + 1, _Slice()
        if held.n:
            yield held.rows(number, buckets)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _opened(pa.Table.from_batches(list(batches)), key)

    fields = f"{_FIELDS}, ids array<{kind}>"
    answered = rows.mapInArrow(run, fields).groupBy("place").applyInArrow(_answered, fields)
    return answered.groupBy("slice").applyInArrow(opened, f"`{key}` {kind}, pos int, token string, n long")
