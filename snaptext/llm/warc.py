"""WARC records and a Merkle audit of replicas.

Pages are laid down as WARC records, ordered by page within archives of a fixed range of page numbers;
a record's offset is the sum of the lengths before it. A leaf of the tree hashes the record with its offset
range, a node the ranges and hashes of up to ``FANOUT`` children in order. Two replicas with equal roots are
equal; otherwise only children of nodes that differ are compared, level by level, down to the records.

One node never has more than ``FANOUT`` children, and an archive of any length just has more levels.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from snaptext.llm.common import whole
from snaptext.scale import stored

FANOUT = 16
PAGES_PER_ARCHIVE = 1000


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record as text."""
    body = whole(html)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), whole(url),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def catalogue(
    pages: DataFrame, per_archive: int = PAGES_PER_ARCHIVE, also: dict[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    """(``archive``, ``seq``, ``page_id``, ``offset``, ``length``, ``sha256``) of the records of (``page_id``, ``url``, ``html``).

    Records are ordered by page, then hash; equal rows are records of their own. Pages without a
    number lie in archive -1. Null urls and contents are empty. ``also`` adds columns made of the record's text (and of the
    columns of ``pages``). Records are hashed where they are read, and only what is named here is shuffled.
    """
    rows = pages.select("*", record(F.col("page_id"), F.col("url"), F.col("html")).alias("_record"))
    text = F.col("_record")
    more = {name: make(text) for name, make in (also or {}).items()}
    made = rows.select(
        F.coalesce(F.floor(F.col("page_id") / per_archive), F.lit(-1)).cast("long").alias("archive"),
        "page_id",
        F.octet_length(text).cast("long").alias("length"),
        F.sha2(text, 256).alias("sha256"),
        *[column.alias(name) for name, column in more.items()],
    )
    # An archive has as many pages as its range of numbers, unless rows repeat.
    order = Window.partitionBy("archive").orderBy("page_id", "sha256")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return made.select(
        "archive", (F.row_number().over(order) - 1).cast("long").alias("seq"), "page_id", F.coalesce(before, F.lit(0)).alias("offset"), "length", "sha256", *more
    )


def archive_pages(pages: DataFrame, per_archive: int = PAGES_PER_ARCHIVE) -> DataFrame:
    """The ``catalogue`` with each ``record``, for writing archives; contents are shuffled to their archive."""
    return catalogue(pages, per_archive, {"record": lambda text: text})


def build_tree(records: DataFrame, levels: int, fanout: int = FANOUT) -> DataFrame:
    """(``archive``, ``level``, ``index``, ``start``, ``end``, ``hash``) of (``archive``, ``seq``, ``offset``, ``length``, ``sha256``).

    Level 0 has a leaf per record; level ``levels`` has the roots if no archive has more than
    ``fanout`` ** ``levels`` records.
    """
    ranged = lambda *parts: F.sha2(F.concat_ws(":", *parts), 256)
    end = F.col("offset") + F.col("length")
    level = records.select(
        "archive", F.lit(0).alias("level"), F.col("seq").alias("index"), F.col("offset").alias("start"), end.alias("end"),
        ranged(F.col("offset").cast("string"), end.cast("string"), F.col("sha256")).alias("hash"),
    )
    every = [level]
    for n in range(1, levels + 1):
        children = F.array_sort(F.collect_list(F.struct("index", "hash")))
        level = (
            every[-1].groupBy("archive", F.floor(F.col("index") / fanout).alias("parent"))
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), children.alias("children"))
            .select(
                "archive", F.lit(n).alias("level"), F.col("parent").alias("index"), "start", "end",
                ranged(F.col("start").cast("string"), F.col("end").cast("string"), F.array_join("children.hash", "")).alias("hash"),
            )
        )
        every.append(level)
    return reduce(DataFrame.unionByName, every)


def levels_of(records: DataFrame, fanout: int = FANOUT) -> int:
    """Levels that reach one root for the longest archive."""
    longest = records.agg(F.max("seq").alias("n")).first()["n"] or 0
    levels = 1
    while fanout**levels <= longest:
        levels += 1
    return levels


def differing(left: DataFrame, right: DataFrame, levels: int, fanout: int = FANOUT) -> DataFrame:
    """(``archive``, ``index``, ``root``, ``replica_root``) of the leaves that differ, found from the roots down.

    Each level compares only nodes whose parent differed; a node that one side lacks differs.
    """
    bad = None
    for n in range(levels, -1, -1):
        sides = []
        for tree, name in ((left, "hash"), (right, "replica_hash")):
            nodes = tree.filter(F.col("level") == n).select("archive", "index", F.col("hash").alias(name))
            if bad is not None:
                parents = bad.select("archive", F.col("index").alias("_parent"))
                nodes = nodes.withColumn("_parent", F.floor(F.col("index") / fanout)).join(parents, ["archive", "_parent"], "left_semi").drop("_parent")
            sides.append(nodes)
        met = sides[0].join(sides[1], ["archive", "index"], "full").filter(~F.col("hash").eqNullSafe(F.col("replica_hash")))
        if n == levels:
            roots = stored(met.select("archive", F.col("hash").alias("root"), F.col("replica_hash").alias("replica_root")), "warc-roots")
        bad = stored(met.select("archive", "index"), "warc-differing")
    return bad.join(roots, "archive", "left")


def audit(records: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The records in which a replica differs: their place, status and hashes, and both roots of the archive.

    Both sides have (``archive``, ``seq``, ``offset``, ``length``, ``sha256``); a replica's rows say what was read at the
    places of the catalogue. ``status``: ``changed``, ``missing`` (not in the replica) or ``extra``.
    Equal or empty replicas give no rows.
    """
    columns = ["archive", "seq", "offset", "length", "sha256"]
    records, replica = records.select(*columns), replica.select(*columns)
    levels = max(levels_of(records, fanout), levels_of(replica, fanout))
    trees = [stored(build_tree(r, levels, fanout), "warc-tree") for r in (records, replica)]
    bad = differing(*trees, levels, fanout).withColumnRenamed("index", "seq")
    mine = records.join(bad.select("archive", "seq"), ["archive", "seq"], "left_semi")
    theirs = replica.join(bad.select("archive", "seq"), ["archive", "seq"], "left_semi").select(
        "archive", "seq", F.col("offset").alias("_offset"), F.col("length").alias("_length"), F.col("sha256").alias("replica_sha256")
    )
    return bad.join(mine, ["archive", "seq"], "left").join(theirs, ["archive", "seq"], "left").select(
        "archive", "seq", F.coalesce("offset", "_offset").alias("offset"), F.coalesce("length", "_length").alias("length"),
        F.when(F.col("replica_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "extra").otherwise("changed").alias("status"),
        "sha256", "replica_sha256", "root", "replica_root",
    )
