"""Segmentation of text into classified, fenced tokens: column expressions only, no shuffle.

Tabs, spaces and U+00A0 separate; a newline separates and is a token; a literal backslash-n separates and is a token
that ends no line; literal backslash-r and backslash-t separate. Runs of letters and of other characters alternate
inside what stands between separators. A document's last token is kept whether or not a newline follows.

A text is cut by three replacements and one split, none of which calls a lambda for a token: its pieces are tokens, with
a mark before or after those that a separator stands beside. What a piece says is read after it has become a row, in
generated code. The marks are noncharacters, which no text holds that is meant to be exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..schemas import AFTER, ALPHA, BEFORE, BLANK, CUT, ESCAPED, SPACE


def prepared(text: Column) -> Column:
    """The text with its escapes resolved; null is empty."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\[rt]", " ")
    return F.replace(text, F.lit("\\n"), F.lit(ESCAPED))


def category(token: Column) -> Column:
    return F.when(token.rlike("^[A-Za-z]+$"), "alph0m0t").when(token.rlike(f"^[{ALPHA}]"), "alphmark").otherwise("nonalpha")


def pieces(text: Column, end: str = "\n") -> Column:
    """An array of the tokens of a text that `end` is added to, with their marks."""
    t = F.concat(F.lit(" "), prepared(text), F.lit(end or " "))  # edges are like spaces
    t = F.regexp_replace(t, f"[{ALPHA}]+", f"{CUT}$0{CUT}")
    t = F.regexp_replace(t, f"{CUT}?[{SPACE}]+{CUT}?", AFTER + CUT + BEFORE)
    t = F.regexp_replace(t, f"{CUT}?([\n{ESCAPED}]){CUT}?", f"{AFTER}{CUT}$1{CUT}{BEFORE}")
    return _without(F.split(t, CUT, -1), "", AFTER, BEFORE, BEFORE + AFTER)


def _without(array: Column, *values: str) -> Column:
    for x in values:
        array = F.array_remove(array, x)
    return array


def token_columns(core: Column, before: Column, after: Column) -> list[Column]:
    """token, category, fenced of what a piece holds."""
    ends = core.isin("\n", ESCAPED)
    fenced = F.when(ends, 3).otherwise(F.when(before, 2).otherwise(0) + F.when(after, 1).otherwise(0))
    return [F.when(core == ESCAPED, F.lit("\\n")).otherwise(core).alias("token"), category(core).alias("category"), fenced.alias("fenced")]


def core(piece: Column) -> Column:
    """A piece without its marks."""
    return F.trim(piece, F.lit(BEFORE + AFTER))


def token_array(text: Column, end: str = "\n") -> Column:
    """An array of (token, category, fenced) of a text that `end` is added to."""
    return F.transform(pieces(text, end), lambda p: let(core(p), lambda c: F.struct(*token_columns(c, p.startswith(BEFORE), p.endswith(AFTER)))))


def _opened(rows: DataFrame, *keys: str, array: Column) -> DataFrame:
    """keys, pos, token, category, fenced: a row for each piece of an array."""
    p = F.col("__sonca_piece")
    found = rows.select(*keys, F.posexplode(array).alias("pos", "__sonca_piece"))
    found = found.select(*keys, "pos", core(p).alias("__sonca_core"), p.startswith(BEFORE).alias("__sonca_before"), p.endswith(AFTER).alias("__sonca_after"))
    return found.select(*keys, "pos", *token_columns(*map(F.col, ("__sonca_core", "__sonca_before", "__sonca_after"))))


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos, token, category, fenced: a row for each token; pos counts from 0 in each document."""
    return _opened(docs, key, array=pieces(F.col(text)))


def token_at(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, token, category, fenced of each document's token number n, from 0; documents with fewer have none."""
    p = F.col("__sonca_piece")
    found = docs.select(key, F.get(pieces(F.col(text)), n).alias("__sonca_piece")).where(p.isNotNull())
    return found.select(key, *token_columns(core(p), p.startswith(BEFORE), p.endswith(AFTER)))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, pieces: a row for each line, with the pieces of all its tokens but the newline."""
    rows = docs.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))
    return rows.select(key, "line_no", pieces(F.col("line"), "").alias("pieces"))


def line_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", max_lines: int = 0) -> DataFrame:
    """doc_id, line_no, pos (in its line), token, category, fenced; of the first max_lines lines if that isn't 0."""
    found = lines(docs, key, text)
    found = found.where(F.col("line_no") < max_lines) if max_lines else found
    return _opened(found, key, "line_no", array=F.col("pieces"))


def _words_marked(text: Column) -> Column:
    """A text with a mark before and after each word; what is no word stands between a mark after and one before."""
    return F.concat(F.lit(f"{AFTER}\n"), F.regexp_replace(text, f"[{ALPHA}]+", f"{BEFORE}$0{AFTER}"), F.lit(f"\n{BEFORE}"))


def line_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, words: the words of each line in lower case."""
    rows = docs.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))
    words = F.lower(F.regexp_replace(_words_marked(prepared(F.col("line"))), f"{AFTER}[^{BEFORE}]*{BEFORE}", " "))
    return rows.select(key, "line_no", F.array_remove(F.split(words, " "), "").alias("words"))


def symbols(text: Column) -> Column:
    """The words of a text; BLANK where other tokens stand, once for all that follow each other, and at either end."""
    t = F.regexp_replace(_words_marked(prepared(text)), f"{AFTER}[{SPACE}]*{BEFORE}", " ")
    return F.array_remove(F.split(F.regexp_replace(t, f"{AFTER}[^{BEFORE}]*{BEFORE}", f" {BLANK} "), " "), "")


def attrs_byte(code: Column, fenced: Column) -> Column:
    """One byte for category and fence that is never 0 or a newline."""
    b = code * 4 + fenced
    return F.when(b < 12, b + 1).otherwise(b)


def case_flags(tokens: DataFrame) -> DataFrame:
    """Adds first_upper, all_upper (of more than one letter), capitalized and marked."""
    t = F.col("token")
    first = t.substr(1, 1)
    upper = (first != F.lower(first)) & (first == F.upper(first))
    return tokens.withColumns({"first_upper": upper, "all_upper": (F.length(t) > 1) & (t == F.upper(t)) & (t != F.lower(t)), "capitalized": upper & (F.substring(t, 2, 1 << 20) == F.lower(F.substring(t, 2, 1 << 20))), "marked": F.col("category") == "alphmark"})
