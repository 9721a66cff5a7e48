"""Page records: one text per page of a snapshot, and the list of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snaptext.sources import published

PAGE_SCHEMA = "snapshot string, page int, text string"

# How a date stands in a file name; the day may be missing.
DATE_IN_NAME = r"(\d{4})-(\d{2})(?:-(\d{2}))?"


def read_pages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Page records with an explicit schema; a ``snapshot=`` folder level is read as the column.

    Page order is the ``page`` column; nothing is sorted on reading.
    """
    return spark.read.schema(PAGE_SCHEMA).format(fmt).load(path)


def write_pages(pages: DataFrame, path: str, fmt: str = "json") -> None:
    """Replace the snapshots present in ``pages``; others in the folder stay as they are."""
    (
        pages.write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot")
        .save(path)
    )


def page_counts(pages: DataFrame) -> DataFrame:
    """Pages and blank pages per snapshot."""
    return pages.groupBy("snapshot").agg(
        F.count("*").alias("n_pages"), F.count_if(F.trim("text") == "").alias("n_empty")
    )


def page_metrics() -> dict[str, Column]:
    """What a write of page records observes: blank pages and characters."""
    return {"n_empty": F.count_if(F.trim("text") == ""), "n_chars": F.sum(F.length("text"))}


def publish_pages(pages: DataFrame, path: str) -> dict:
    """Replace the snapshots present in ``pages`` in the published table ``pages``; returns the manifest with the observed counts."""
    return published.publish(pages.sparkSession, path, {"pages": published.Table(pages, "snapshot", page_metrics())})


def name_date(name: Column) -> Column:
    """Date in a file name; the first of the month when the day is missing."""
    part = lambda i: F.regexp_extract(name, DATE_IN_NAME, i)
    day = F.when(part(3) == "", F.lit(1)).otherwise(part(3).try_cast("int"))
    return F.when(part(1) != "", F.try_make_timestamp(
        years=part(1).try_cast("int"), months=part(2).try_cast("int"), days=day,
        hours=F.lit(0), mins=F.lit(0), secs=F.lit(0),
    ).cast("date"))


def discover_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots in date order from the names of the files under ``path``; at least two are needed.

    Lists files only, no content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("file"))
    dated = names.withColumn("date", name_date(F.col("file"))).where("date IS NOT NULL")
    if dated.limit(2).count() < 2:
        raise ValueError("change detection needs at least two dated snapshots")
    return dated.orderBy("date", "file")


def write_dated(pages: DataFrame, path: str, name: str) -> None:
    """Write page records (``page``, ``text``) of one snapshot as a folder of JSON lines below ``path``; its name carries the date."""
    pages.write.mode("overwrite").json(f"{path}/{name}")


def read_dated_pages(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, fmt: str = "json") -> DataFrame:
    """Page records (``page``, ``text``) of the snapshots below ``path`` whose files or folders carry a date in their names, with ``date``.

    Only snapshots of dates from ``since`` to ``until`` are opened; the others are known by name alone.
    """
    names = spark.createDataFrame([(n,) for n in published.Folder(spark, path).names()], "name string")
    span = F.col("date").between(F.to_date(F.lit(since or "0001-01-01")), F.to_date(F.lit(until or "9999-12-31")))
    # One row per snapshot.
    wanted = [r["name"] for r in names.withColumn("date", name_date(F.col("name"))).where(span).orderBy("date", "name").collect()]
    schema = "page int, text string"
    if not wanted:
        return spark.createDataFrame([], f"{schema}, date date")
    rows = spark.read.schema(schema).format(fmt).load([f"{path}/{name}" for name in wanted])
    below = F.substring_index(F.col("_metadata.file_path"), f"{path.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    return rows.withColumn("date", name_date(F.split(below, "/")[0]))


def current_snapshot(registry: DataFrame) -> str:
    """The latest snapshot of the registry (``snapshot, date``); a role, never a fixed name."""
    return registry.agg(F.max_by("snapshot", "date")).first()[0]
