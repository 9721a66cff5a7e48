"""Lines to sections: every line belongs to the last heading before it, across pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from snaptext import settings
from snaptext.functions import text as tx
from snaptext.operators import lines as ln
from snaptext.scale import carry_forward, small_side, stored


def from_body_start(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """Drop the front matter: pages before the ``body_start`` of their snapshot.

    A snapshot that the registry does not know is an error, not a snapshot without pages.
    """
    starts = small_side(registry.select("snapshot", F.coalesce("body_start", F.lit(1)).alias("body_start")))
    unknown = F.raise_error(F.concat(F.lit("snapshot not in the registry: "), F.coalesce("snapshot", F.lit("null")))).cast("int")
    joined = pages.join(starts, "snapshot", "left")
    return joined.where(F.col("page") >= F.coalesce("body_start", unknown)).drop("body_start")


def marked_pages(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    heading: str = settings.HEADING_PATTERN,
    outer: str = settings.OUTER_PATTERN,
) -> DataFrame:
    """One row per page with its kept lines, its headings and what it inherits.

    ``heads_before``, ``entity_before`` and ``outer_before`` come from the earlier pages
    of the snapshot, so that lines can be placed page by page without another shuffle.
    """
    kept = F.filter(ln.line_array(F.col("text")), lambda line: ~ln.is_boilerplate(line, rules))
    work = pages.select("snapshot", "page", kept.alias("lines"))
    # Each line is matched once; marks are few, and lines stay apart from them.
    marks = F.filter(
        F.transform(
            "lines",
            lambda line, i: F.struct(
                i.alias("pos"),
                ln.outer_label(line, outer).alias("outer"),
                F.regexp_extract(line, heading, 1).alias("id"),
                line.alias("line"),
            ),
        ),
        lambda m: m["outer"].isNotNull() | (m["id"] != ""),
    )
    work = work.withColumn("_marks", marks)
    outers = F.transform(
        F.filter("_marks", lambda m: m["outer"].isNotNull()),
        lambda m: F.struct(m["pos"].alias("pos"), m["outer"].alias("outer")),
    )
    heads = F.transform(
        F.filter("_marks", lambda m: m["outer"].isNull()),
        lambda m: F.struct(
            m["pos"].alias("pos"), m["id"].alias("entity_id"), ln.heading_title(m["line"], heading).alias("title")
        ),
    )
    work = stored(work.withColumns({"outers": outers, "heads": heads}).drop("_marks"), "kept-lines")
    return carry_forward(
        work,
        ["snapshot"],
        "page",
        totals={"heads_before": F.size("heads")},
        lasts={
            "entity_before": F.try_element_at("heads", F.lit(-1))["entity_id"],
            "outer_before": F.try_element_at("outers", F.lit(-1))["outer"],
        },
    )


def headings(marked: DataFrame) -> DataFrame:
    """One row per heading: the sections in reading order."""
    one = marked.select(
        "snapshot", "page", "outers", "outer_before", "heads_before", F.posexplode("heads").alias("nth", "head")
    )
    own_outer = F.try_element_at(F.filter("outers", lambda m: m["pos"] < F.col("head.pos")), F.lit(-1))["outer"]
    return one.select(
        "snapshot",
        (F.col("heads_before") + F.col("nth") + 1).cast("long").alias("section_no"),
        F.col("head.entity_id").alias("entity_id"),
        F.col("head.title").alias("title"),
        F.coalesce(own_outer, F.col("outer_before"), F.lit("")).alias("section"),
        F.col("page").alias("page_start"),
    )


def placed_lines(marked: DataFrame) -> DataFrame:
    """Body lines with the section and entity they belong to; lines before any heading are dropped."""
    one = marked.select("*", F.posexplode("lines").alias("line_no", "line"))
    above = F.filter("heads", lambda m: m["pos"] <= F.col("line_no"))
    section_no = (F.col("heads_before") + F.size(above)).cast("long")
    is_mark = F.exists("heads", lambda m: m["pos"] == F.col("line_no")) | F.exists(
        "outers", lambda m: m["pos"] == F.col("line_no")
    )
    return one.where(~is_mark & (section_no > 0)).select(
        "snapshot",
        section_no.alias("section_no"),
        F.coalesce(F.try_element_at(above, F.lit(-1))["entity_id"], F.col("entity_before")).alias("entity_id"),
        "page",
        "line_no",
        "line",
    )


def section_table(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per heading with its page range and size."""
    sizes = lines.groupBy("snapshot", "section_no").agg(
        F.max("page").alias("last_page"),
        F.count("*").alias("n_lines"),
        F.sum(F.size(tx.words(F.col("line")))).alias("n_words"),
    )
    none = F.lit(0).cast("long")
    return heads.join(sizes, ["snapshot", "section_no"], "left").select(
        *heads.columns,
        F.coalesce("last_page", "page_start").alias("page_end"),
        F.coalesce("n_lines", none).alias("n_lines"),
        F.coalesce("n_words", none).alias("n_words"),
    )


def merged_sections(sections: DataFrame) -> DataFrame:
    """One row per entity: a repeated heading appends to the first one, whose title wins."""
    return sections.groupBy("snapshot", "entity_id").agg(
        F.min_by("title", "section_no").alias("title"),
        F.min_by("section", "section_no").alias("section"),
        F.min("page_start").alias("page_start"),
        F.max("page_end").alias("page_end"),
        F.count("*").alias("n_headings"),
        F.sum("n_lines").alias("n_lines"),
        F.sum("n_words").alias("n_words"),
    )


def section_bodies(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Each section's lines joined by spaces, as one text per row.

    A text is one value here, so it has to fit a row; ``chunking.chunk_lines`` and
    ``changes.blocks_of_pieces`` work without assembling it.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page", "line_no", "line")))
    return lines.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), " ").alias("body")
    )
