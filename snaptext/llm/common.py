"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: ASCII white space, the only separator of words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the text's words in order; empty for an empty text."""
    return F.array_remove(F.split(text, SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


#: Names a row by its id and text. Plain equality holds for null ids too, so that grouping and joining
#: on it share one shuffle.
KEY = ["_id_key", "_text_key"]


def with_key(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return df.withColumns({KEY[0]: F.xxhash64(F.col(doc_id)), KEY[1]: F.xxhash64(whole(text))})


def keyed_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``KEY`` and the whole row as a struct ``row``, whatever its columns are called."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(F.xxhash64(F.col(doc_id)).alias(KEY[0]), F.xxhash64(whole(text)).alias(KEY[1]), row)
