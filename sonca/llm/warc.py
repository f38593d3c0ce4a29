"""WARC archives in Zstandard: one frame a record, and a dictionary in a leading skippable frame.

Archives are rows of a table in the shared folder, each row one complete .warc.zst archive of bounded size, so that
Spark's commit protocol keeps them whole when tasks are tried again; `export` copies them out as files. The dictionary
is built from a bounded sample of the records to be archived (SAMPLE records of at most SAMPLE_BYTES each, chosen by a
hash of the key).

Equal payloads are found by their SHA-256 in a narrow aggregation with map-side combining; the pages themselves are
shuffled only where the revisits are too many to broadcast (MOST of them). Null html is an empty payload. Repeated rows
that share the smallest page_id stay responses; rows that repeat a larger one are revisits of the smallest.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, SAMPLE_BYTES, DICTIONARY, ARCHIVE, LEVEL, MOST = 400, 16 << 10, 32 << 10, 4 << 20, 3, 200_000
MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained Zstandard dictionary; the records' own bytes where they are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _one_line(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")


def record(page: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """A response record, or a revisit whose block has the HTTP header alone; both name the whole payload's digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Target-URI: {_one_line(url)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page is None else page}", f"X-URL: {base64.b64encode((url or '').encode()).decode() if url is not None else '-'}"]
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers)}", f"X-Refers-To-Page: {refers}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    """Archives of bounded size from records."""

    def __init__(self, words: bytes, limit: int = ARCHIVE) -> None:
        self.limit, self.words = limit, words
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **({"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}))
        stored = zstandard.ZstdCompressor(level=LEVEL).compress(words)
        self.head = struct.pack("<II", MAGIC, len(stored)) + stored

    def archives(self, records: Iterator[bytes]) -> Iterator[bytes]:
        held, size = [], 0
        for r in records:
            held.append(self.zip.compress(r))
            size += len(held[-1])
            if size >= self.limit:
                yield self.head + b"".join(held)
                held, size = [], 0
        if held:
            yield self.head + b"".join(held)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record; the dictionary comes from the archive's leading frame."""
    magic, size = struct.unpack("<II", archive[:8])
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the archive's start")
    words = zstandard.ZstdDecompressor().decompress(archive[8 : 8 + size], max_output_size=1 << 27)
    unzip, at = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(words)} if words else {})), 8 + size
    view = memoryview(archive)
    while at < len(archive):
        one = unzip.decompressobj()
        raw = one.decompress(view[at:])
        if not one.eof:
            raise ValueError("a record's frame is cut short")
        at = len(archive) - len(one.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        if rest[n:] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield fields, rest[:n]


def read_back(fields: dict[str, str], block: bytes) -> tuple:
    """A row of COLUMNS; a response's digest is made again from its payload and must be the one it names."""
    http, _, payload = block.partition(b"\r\n\r\n")
    said, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != said or len(payload) != length):
        raise ValueError("a payload does not match its digest")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    url = None if fields["X-URL"] == "-" else base64.b64decode(fields["X-URL"]).decode()
    return number("X-Page-ID"), url, length, said, kind, number("X-Refers-To-Page")


def with_revisits(pages: DataFrame, least_bytes: int = 0, most: int = MOST) -> DataFrame:
    """page_id, url, html and refers_to: the page that has the same payload first, else null."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    narrow = rows.where(F.octet_length("html") >= least_bytes).select("page_id", F.sha2("html", 256).alias("digest"))
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("last > first").select("digest", "first")
    scratch = common.Scratch(pages.sparkSession, "warc")
    again = scratch.keep(first, "revisits")
    bound = again.count() <= most
    side = F.broadcast(again) if bound else again
    joined = rows.withColumn("digest", F.sha2("html", 256)).join(side, "digest", "left")
    refers = F.when((F.octet_length("html") >= least_bytes) & (F.col("first") < F.col("page_id")), F.col("first"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write(pages: DataFrame, least_bytes: int = 0, limit: int = ARCHIVE) -> DataFrame:
    """The table of archives: a row with the bytes of each."""
    spark = pages.sparkSession
    sample = pages.select(F.xxhash64("page_id").alias("h"), F.substring(F.coalesce(pages["html"].cast("string"), F.lit("")), 1, SAMPLE_BYTES).alias("html")).orderBy("h", "html").limit(SAMPLE).toArrow()
    words = spark.sparkContext.broadcast(dictionary([record(0, "http://www.example.org/", x.encode(), None) for x in sample["html"].to_pylist()]))
    schema = pa.schema([("archive", pa.binary())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (record(k, u, h, r) for b in stream for k, u, h, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.utf8(b.column(2)), b.column(3).to_pylist(), strict=True))
        for a in Writer(words.value, limit).archives(rows):
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.binary())], schema=schema)

    return common.Scratch(spark, "warc").keep(with_revisits(pages, least_bytes).mapInArrow(run, "archive binary"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """A row of COLUMNS for each record of the archives."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for a in b.column(0):
                yield from common.batches(SCHEMA, (read_back(*x) for x in records(a.as_py())))

    return archives.select("archive").mapInArrow(run, COLUMNS)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file of its own into a folder that all executors share; returns names and sizes.

    A name comes from the archive's digest, so a task that runs again writes the same file.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("n_bytes", pa.int64())])
        for b in stream:
            for a in b.column(0).to_pylist():
                name = f"{hashlib.sha256(a).hexdigest()[:24]}.warc.zst"
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(a)
                os.replace(part, f"{folder}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(a)], pa.int64())], schema=schema)

    return archives.select("archive").mapInArrow(run, "name string, n_bytes long")
