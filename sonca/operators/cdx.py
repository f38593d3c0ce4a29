"""The compact text encoding of tokens: an attribute byte, and for syllables the id in three base64 characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.columns import let
from ..schemas import BASE64, CATEGORY_CODE, NONE_ID
from .syllables import Piece, joined, piecewise, read_piece
from .tokens import attrs_byte, lines

#: Attribute bytes from this one on belong to syllables.
FIRST_SYLLABLE = 24


def _code(category: Column) -> Column:
    out = F.lit(None)
    for name, code in CATEGORY_CODE.items():
        out = F.when(category == name, code).otherwise(out)
    return out


def encoded(category: Column, fenced: Column, syllable_id: Column) -> Column:
    """One token."""
    return F.concat(F.chr(attrs_byte(_code(category), fenced)), F.when(syllable_id.isNull(), "").otherwise(ids.to_base64(syllable_id)))


def write_lines(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, line_no, value: encoded lines of (doc_id, line_no, pos, category, fenced, syllable_id)."""
    one = F.struct("pos", encoded(F.col("category"), F.col("fenced"), F.col("syllable_id")).alias("x"))
    return tokens.groupBy(key, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda t: t["x"]), "").alias("value"))


def encoded_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, value: the encoded lines of texts, each made where it is read; nothing is shuffled."""

    def code(p: Piece) -> str:
        byte = CATEGORY_CODE[p.category] * 4 + p.fenced
        i = p.syllable_id
        return chr(byte + 1 if byte < 12 else byte) + ("" if i is None else BASE64[i >> 12] + BASE64[i >> 6 & 63] + BASE64[i & 63])

    def of(distinct: list[str]):
        codes_of = [code(read_piece(p)) for p in distinct]
        return lambda codes, starts: [joined(codes_of, codes, starts)]

    rows = lines(docs, key, text).select(F.col(key).cast("long").alias(key), "line_no", "pieces")
    return piecewise(rows, f"{key} long, line_no int", "value string", of)


def symbols(value: Column) -> Column:
    """The ids of an encoded line in order, NONE_ID for each token that is no syllable."""
    found = F.regexp_extract_all(value, F.lit(r"[\x18-\x1F][A-Za-z0-9+/]{3}|[\x00-\x17]"), F.lit(0))
    return F.transform(found, lambda x: F.when(F.length(x) == 4, ids.from_base64(x.substr(2, 3))).otherwise(NONE_ID))


def collapsed(s: Column, blank: int = NONE_ID) -> Column:
    """Runs of blanks made one, and a blank at either end."""
    padded = F.concat(F.array(F.lit(blank)), s, F.array(F.lit(blank)))
    return let(padded, lambda s: F.filter(s, lambda x, i: ~((x == blank) & (i > 0) & (F.get(s, i - 1) == blank))))


def read(encoded: DataFrame, value: str = "value") -> DataFrame:
    """lines with ids: each line's syllables, blanks collapsed and at both ends. Lines are sequences of their own."""
    return encoded.withColumn("ids", collapsed(symbols(F.col(value))))


def attribute(byte: Column) -> Column:
    """struct(category, fenced) of an attribute byte."""
    code = F.when(byte < 5, byte - 1).otherwise(byte)
    names = F.create_map(*[F.lit(x) for name, c in CATEGORY_CODE.items() for x in (c, name)])
    return F.struct(F.try_element_at(names, F.shiftright(code, 2)).alias("category"), code.bitwiseAND(3).alias("fenced"))
