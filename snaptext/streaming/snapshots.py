"""Ingest of page records as new snapshots arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from snaptext import settings
from snaptext.plans.ingest import chunk_pages, parse_pages
from snaptext.scale import small_side
from snaptext.sources.pages import PAGE_SCHEMA, read_pages
from snaptext.sources.tables import write_chunks


def follow_snapshots(
    spark: SparkSession,
    pages_path: str,
    chunks_path: str,
    checkpoint: str,
    registry: DataFrame,
    rules: list[tuple[str, str]],
    heading: str = settings.HEADING_PATTERN,
    outer: str = settings.OUTER_PATTERN,
    keyword: str = settings.HEADING_KEYWORD,
) -> StreamingQuery:
    """Rebuild the chunks of every snapshot that received page records.

    A section may reach over any number of pages, so a batch only says which snapshots
    to rebuild; those are read whole and replaced. Repeating a batch changes nothing.
    """

    def rebuild(batch: DataFrame, _: int) -> None:
        touched = batch.select("snapshot").distinct()
        pages = read_pages(spark, pages_path).join(small_side(touched), "snapshot", "left_semi")
        parsed = parse_pages(pages, registry, rules, heading, outer)
        write_chunks(chunk_pages(parsed, keyword), chunks_path)

    return (
        spark.readStream.schema(PAGE_SCHEMA)
        .json(pages_path)
        .writeStream.foreachBatch(rebuild)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
