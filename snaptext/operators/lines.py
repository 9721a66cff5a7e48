"""Pages to lines, and what kind of line each is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from snaptext import settings
from snaptext.functions import text as tx

# A rule is (kind, value); kinds: prefix, contains, equals, pattern.
PAGE_NUMBER_RULE = ("pattern", settings.PAGE_NUMBER_PATTERN)


def is_boilerplate(line: Column, rules: list[tuple[str, str]]) -> Column:
    """True for blank lines, page numbers and lines that match one of the ``rules``."""
    tests = {
        "prefix": lambda v: line.startswith(v),
        "contains": lambda v: line.contains(v),
        "equals": lambda v: line == v,
        "pattern": lambda v: line.rlike(v),
    }
    hits = [tests[kind](value) for kind, value in [*rules, PAGE_NUMBER_RULE]]
    return reduce(lambda a, b: a | b, hits, line == "")


def line_array(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), tx.strip)


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per stripped line with its position."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(line_array(F.col(text))).alias("line_no", "line"))


def body_lines(df: DataFrame, rules: list[tuple[str, str]], text: str = "text") -> DataFrame:
    lines = explode_lines(df, text)
    return lines.where(~is_boilerplate(F.col("line"), rules))


def heading_id(line: Column, pattern: str = settings.HEADING_PATTERN) -> Column:
    found = F.regexp_extract(line, pattern, 1)
    return F.when(found != "", found)


def heading_title(line: Column, pattern: str = settings.HEADING_PATTERN) -> Column:
    return F.when(heading_id(line, pattern).isNotNull(), tx.strip(F.regexp_extract(line, pattern, 2)))


def outer_label(line: Column, pattern: str = settings.OUTER_PATTERN) -> Column:
    found = F.regexp_extract(line, pattern, 1)
    return F.when(found != "", found)
