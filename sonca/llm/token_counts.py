"""Token counts of whole texts, with huge texts encoded in overlapping chunks that are spliced.

Pre-tokens of the byte-level tokenizer are matched from left to right, so what is matched from a place on depends on
the text after it alone. A pre-token start that two overlapping chunks share, far enough from the end of the left one
that its look-ahead was complete, is therefore a boundary of the whole text too: the left chunk's tokens up to it and
the right chunk's from it on are those of the whole text. Where two chunks share no such place the overlap is doubled,
and once it would be half the chunk, the chunk is.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated results. Strings of special tokens inside a
text count as the library has it by default. Columns other than the key and the text are left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

CHUNK, OVERLAP, MARGIN = 1 << 15, 512, 64
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, once a process, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class _Chunk:
    """One encoded chunk: where its pre-tokens start in the text, and at which token."""

    def __init__(self, tok, text: str, begin: int, end: int) -> None:
        enc = tok.encode(text[begin:end], add_special_tokens=False)
        self.begin, self.end, self.size, self.starts = begin, end, len(enc), {}
        before = None
        for i, (word, (at, _)) in enumerate(zip(enc.word_ids, enc.offsets, strict=True)):
            if word != before or word is None:
                self.starts.setdefault(begin + at, i)
            before = word


def count_spliced(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the whole text, from overlapping chunks of about `chunk` characters."""
    total, begin, size = 0, 0, chunk
    left = _Chunk(tok, text, 0, min(len(text), size))
    while left.end < len(text):
        wide, at = min(overlap, size // 2), None
        while at is None and wide <= size // 2:
            right = _Chunk(tok, text, max(begin, left.end - wide), min(len(text), left.end - wide + size))
            common_ = [p for p in left.starts if begin < p <= left.end - MARGIN and p > right.begin and p in right.starts]
            at, wide = max(common_, default=None), wide * 2
        if at is None:  # no boundary in sight: a longer left chunk
            size *= 2
            left = _Chunk(tok, text, begin, min(len(text), begin + size))
            continue
        total += left.starts[at] - left.starts.get(begin, 0)
        left, begin, size = right, at, chunk
    return total + left.size - left.starts.get(begin, 0)


def count_all(tok, texts: list[str], chunk: int = CHUNK) -> list[int]:
    """Tokens of each text; a batch is encoded in groups of bounded size."""
    out, group, size = [0] * len(texts), [], 0
    for i, t in enumerate(texts):
        if len(t) > chunk:
            out[i] = count_spliced(tok, t, chunk)
            continue
        group.append(i)
        size += len(t)
        if size > 1 << 20:
            _group(tok, texts, group, out)
            group, size = [], 0
    _group(tok, texts, group, out)
    return out


def _group(tok, texts: list[str], group: list[int], out: list[int]) -> None:
    for i, enc in zip(group, tok.encode_batch_fast([texts[i] for i in group], add_special_tokens=False), strict=True):
        out[i] = len(enc)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs; no shuffle."""

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for k, t, n in zip(batch.column(0).to_pylist(), texts, count_all(tokenizer(path), texts, chunk), strict=True):
            yield k, len(t.encode()), n, n > limit

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(common.by_rows(SCHEMA, each), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
