"""What the operators of this subpackage share: tables, scratch space, Arrow batches and hashes."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch; a worker holds one batch of whole texts at a time.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of texts, where the session still has Spark's defaults."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local master without either gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sonca-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _conf(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor's work is read again, not redone.

    What an operator returns may read its tables at any time, so they stay until `dropped` is left or the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.thread = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", threading.get_ident()
        if not _made:
            atexit.register(_end)
        _made.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns the written table; shuffle files of the write go with it."""
        path = f"{self.root}/{name}"
        with _conf(self.spark, **{_CLEANUP: "true"}):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def end(self) -> None:
        """Deletes all tables."""
        self._delete(self.root)
        _made.remove(self)

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_made: list[Scratch] = []


def _end() -> None:
    """At the driver's end, as far as its context still runs; what can't be reached any more stays."""
    with suppress(Exception):
        for scratch in list(_made):
            if scratch.spark.sparkContext._jsc is not None:
                scratch.end()


@contextmanager
def dropped() -> Iterator[None]:
    """Deletes the tables of all scratch spaces that its thread makes inside, once nothing made there is read any more."""
    before = list(_made)
    try:
        yield
    finally:
        for scratch in [x for x in _made if x not in before and x.thread == threading.get_ident()]:
            scratch.end()


def batches(schema: pa.Schema, rows: Iterable[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most size rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def by_rows(schema: pa.Schema, each: Callable[[pa.RecordBatch], Iterable[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that makes row tuples of a batch."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                yield from batches(schema, each(batch))

    return run


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as none."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams of word hashes."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(out)])
    return out
