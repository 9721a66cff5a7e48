"""Helpers that keep jobs safe when one key holds a large share of the rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from snaptext import settings


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="snaptext-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/snaptext/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage and lets several consumers share one computation; the files
    outlive lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash ``df`` over all cores if it was read in fewer parts than there are cores.

    For text-heavy work on a few small files; a large table keeps its scan partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of at most ``rows`` rows, by hash of ``keys`` in parts of about ``TASK_ROWS`` rows; as it is if ``rows`` is 0, for unknown.

    There are at least as many parts as shuffle partitions.
    """
    parts = max(-(-rows // settings.TASK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys) if rows else df


def is_small(
    df: DataFrame,
    max_rows: int = settings.BROADCAST_ROWS,
    max_bytes: int = settings.BROADCAST_BYTES,
) -> bool:
    """Measure whether ``df`` stays within a broadcast's bounds; reads at most ``max_rows + 1`` rows."""
    size = (
        df.limit(max_rows + 1)
        .select(F.octet_length(F.to_json(F.struct("*"))).alias("n"))
        .agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"))
        .first()
    )
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def small_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is measured to be small, else ``df`` for a shuffle join."""
    return F.broadcast(df) if is_small(df) else df


def carry_forward(
    df: DataFrame,
    keys: list[str],
    order: str,
    totals: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    block: int = settings.SCAN_BLOCK,
) -> DataFrame:
    """Add what came before each row of its ``keys`` group, in ``order`` (an integer column).

    ``totals`` are exclusive running sums, ``lasts`` the last non-null earlier value.
    The group is cut into blocks of ``block`` order values: sums and last values inside
    a block are windowed per block, and only one row per block is windowed per group,
    so a group may be far larger than a task.
    """
    totals, lasts = totals or {}, lasts or {}
    work = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("long"))
    for name, value in {**totals, **lasts}.items():
        work = work.withColumn(f"_v_{name}", value)

    per_block = work.groupBy(*keys, "_block").agg(
        *[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in totals],
        *[
            F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(order, f"_v_{n}")))[f"_v_{n}"].alias(f"_b_{n}")
            for n in lasts
        ],
    )
    earlier_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(
        *keys,
        "_block",
        *[F.sum(f"_b_{n}").over(earlier_blocks).alias(f"_s_{n}") for n in totals],
        *[F.last(f"_b_{n}", ignorenulls=True).over(earlier_blocks).alias(f"_s_{n}") for n in lasts],
    )

    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = work.join(starts, [*keys, "_block"])
    for n in totals:
        zero = F.lit(0)
        out = out.withColumn(
            n, F.coalesce(F.col(f"_s_{n}"), zero) + F.coalesce(F.sum(f"_v_{n}").over(inside), zero)
        )
    for n in lasts:
        out = out.withColumn(
            n, F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_s_{n}"))
        )
    return out.select(*df.columns, *totals, *lasts)


def only_keys_of(big: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``big`` whose ``keys`` occur in ``few``; broadcasts the keys when proven small."""
    return big.join(small_side(few.select(*keys).distinct()), keys, "left_semi")
