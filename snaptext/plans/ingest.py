"""Page records to chunk table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from snaptext import settings
from snaptext.operators import chunking, sections
from snaptext.scale import stored


@dataclass
class Parsed:
    headings: DataFrame
    lines: DataFrame
    sections: DataFrame
    entities: DataFrame


def parse_pages(
    pages: DataFrame,
    registry: DataFrame,
    rules: list[tuple[str, str]],
    heading: str = settings.HEADING_PATTERN,
    outer: str = settings.OUTER_PATTERN,
) -> Parsed:
    """Sections, merged entities and placed lines of all snapshots.

    The marked pages are stored once, since headings and lines both come from them.
    """
    marked = stored(sections.marked_pages(sections.from_body_start(pages, registry), rules, heading, outer), "marked")
    heads = sections.headings(marked)
    lines = sections.placed_lines(marked)
    table = sections.section_table(heads, lines)
    return Parsed(heads, lines, table, sections.merged_sections(table))


def chunk_pages(parsed: Parsed, keyword: str = settings.HEADING_KEYWORD) -> DataFrame:
    return chunking.chunk_sections(parsed.entities, parsed.lines, keyword)
