"""Ranks from counts: how many rows come before a row, without sorting the whole table.

Rows are numbered once, and their numbers are cut into blocks of bounded size. Counts of each key in each block,
summed over earlier blocks, tell where the rows of a block start; the rest is a rank inside one block. No group is
larger than a block, however often a key occurs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from snaptext.scale import stored

#: Most and least rows of a block.
BLOCK, LEAST_BLOCK = 1 << 16, 1 << 8


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, stored, with a number of their own in ``pos``: neither dense nor in any promised order, but fixed by being stored."""
    return stored(rows.withColumn("pos", F.monotonically_increasing_id()), name)


def block_rows(n: int, partitions: int) -> int:
    """Rows of a block, so that ``n`` rows make at least as many blocks as there are partitions unless blocks get tiny."""
    return min(BLOCK, max(LEAST_BLOCK, math.ceil(n / max(partitions, 1))))


def ranked(rows: DataFrame, key: Column, block: int, across: int | None = None, rank: str = "rank") -> DataFrame:
    """``rows``, which are stored and have a unique long ``pos``, with their ``rank`` from 0 among rows of an equal ``key`` by ``pos``.

    With ``across``, keys are integers from 0 to below ``across`` and ranks are places in a stable sort of all rows by key:
    one pass of a counting sort. Every column of ``rows`` stays.
    """
    keyed = rows.withColumns({"_block": F.floor(F.col("pos") / F.lit(block)).cast("long"), "_key": key})
    counts = keyed.groupBy("_block", "_key").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_block", "_key", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    if across is not None:
        # At most ``across`` rows, whatever the size of the table.
        smaller = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
        totals = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
        bases = totals.select("_key", F.coalesce(F.sum("_n").over(smaller), F.lit(0)).alias("_base"))
        starts = starts.join(F.broadcast(bases), "_key").select("_block", "_key", (F.col("_start") + F.col("_base")).alias("_start"))
    inside = Window.partitionBy("_block", "_key").orderBy("pos")
    placed = keyed.withColumn("_in", F.row_number().over(inside).cast("long") - 1).join(starts, ["_block", "_key"])
    return placed.select(*rows.columns, (F.col("_start") + F.col("_in")).alias(rank))


def digit(parts: list[tuple[Column, int]], shift: int, width: int) -> Column:
    """Bits ``shift`` to below ``shift + width`` of a number put together from unsigned ``parts`` (value, bits), most significant first."""
    out, below = F.lit(0).cast("long"), 0
    for value, bits in reversed(parts):
        if shift < below + bits and shift + width > below:
            moved = F.shiftrightunsigned(value, shift - below) if shift >= below else F.shiftleft(value, below - shift)
            out = out.bitwiseOR(moved)
        below += bits
    return out.bitwiseAND(F.lit((1 << width) - 1).cast("long"))
