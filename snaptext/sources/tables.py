"""Stored chunk tables, evaluation cases and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snaptext.sources import published

CHUNK_SCHEMA = (
    "chunk_id string, entity_id string, title string, section string, page_start int, page_end int, "
    "chunk_index int, n_words int, text string, snapshot string"
)

CASE_SCHEMA = (
    "query_id string, category string, text string, expected string, expect_entities array<string>, "
    "as_of date, expect_contains string, expect_snapshot string, expect_history string"
)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Rebuild the snapshots present in ``chunks``; running it twice gives the same table."""
    (
        chunks.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot")
        .parquet(path)
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; snapshot labels are strings, whatever they look like."""
    return spark.read.schema(CHUNK_SCHEMA).parquet(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases; keys that a case leaves out read as null."""
    return spark.read.schema(CASE_SCHEMA).json(path)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def publish_chunks(chunks: DataFrame, path: str) -> dict:
    """Rebuild the snapshots present in ``chunks`` in the published table ``chunks``; others stay, and a half-written rebuild is never read."""
    metrics = {"n_entities": F.approx_count_distinct("entity_id"), "n_words": F.sum("n_words")}
    return published.publish(chunks.sparkSession, path, {"chunks": published.Table(chunks, "snapshot", metrics)})


def publish_run(rows: DataFrame, summary: DataFrame, path: str) -> dict:
    """Replace the graded rows and the summary of an evaluation run, both at once."""
    return published.publish(rows.sparkSession, path, {"rows": published.Table(rows), "summary": published.Table(summary)})


def publish_report(rows: DataFrame, details: DataFrame, path: str) -> dict:
    """Replace the change report: rows by class, and the details of each entity."""
    return published.publish(rows.sparkSession, path, {"report": published.Table(rows, "class", replace=True), "details": published.Table(details)})
