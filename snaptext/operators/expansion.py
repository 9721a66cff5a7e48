"""From ranked chunks to reading context: swap by date, widen, regroup, render."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from snaptext import settings
from snaptext.functions import text as tx
from snaptext.scale import only_keys_of, small_side


def chunk_index_sets(chunks: DataFrame) -> DataFrame:
    """Number of chunks of each entity in each snapshot, and its first and last index."""
    return chunks.groupBy("snapshot", "entity_id").agg(
        F.count("*").alias("n_chunks"),
        F.min("chunk_index").alias("first_index"),
        F.max("chunk_index").alias("last_index"),
    )


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks with the given ids; ids that do not exist are skipped."""
    return only_keys_of(chunks, ids, ["chunk_id"])


def in_snapshot(chunks: DataFrame, snapshot: str) -> DataFrame:
    """One snapshot only; prunes the folders of a table published by snapshot."""
    return chunks.where(F.col("snapshot") == snapshot)


def entity_ranks(union: DataFrame) -> DataFrame:
    """Entities of a query's hits in order of their best rank."""
    best = union.groupBy("query_id", "entity_id").agg(F.min("rank").alias("best_rank"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("best_rank"))
    return best.select("query_id", "entity_id", rank.alias("entity_rank"))


def wanted_chunks(
    union: DataFrame,
    served: DataFrame,
    chunks: DataFrame,
    current: str,
    whole: int = settings.WHOLE_CHUNKS,
    strong: int = settings.STRONG_ENTITIES,
    strong_whole: int = settings.STRONG_CHUNKS,
) -> DataFrame:
    """Chunks to read for each query: whole entities or the neighbours of each hit.

    ``union`` has ``query_id, rank, entity_id, chunk_index`` and ``served`` the snapshot
    that applies to each ``query_id, entity_id`` (null: its text is not held, nothing is
    read). An entity is read whole when another snapshot than ``current`` is served, when
    it has at most ``whole`` chunks, or when it is among the first ``strong`` entities of
    the query and has at most ``strong_whole``. Otherwise a hit brings its two neighbours.
    """
    hits = (
        union.join(served, ["query_id", "entity_id"])
        .where(F.col("snapshot").isNotNull())
        .join(entity_ranks(union), ["query_id", "entity_id"])
    )
    near = only_keys_of(chunks.select("snapshot", "entity_id", "chunk_index"), hits, ["snapshot", "entity_id"])
    sizes = near.groupBy("snapshot", "entity_id").agg(F.count("*").alias("n_chunks"))
    sized = hits.join(sizes, ["snapshot", "entity_id"]).withColumn(
        "full",
        (F.col("snapshot") != current)
        | (F.col("n_chunks") <= whole)
        | ((F.col("entity_rank") <= strong) & (F.col("n_chunks") <= strong_whole)),
    )
    keys = ["query_id", "entity_rank", "snapshot", "entity_id"]
    wholes = sized.where("full").select(*keys).distinct().join(near, ["snapshot", "entity_id"])
    index = F.col("chunk_index")
    neighbours = (
        sized.where("NOT full")
        .select(*keys, F.explode(F.array(index - 1, index, index + 1)).alias("chunk_index"))
        .distinct()
        .join(near, ["snapshot", "entity_id", "chunk_index"], "left_semi")
    )
    columns = [*keys, "chunk_index"]
    return (
        wholes.select(*columns, F.lit(True).alias("whole_entity"))
        .unionByName(neighbours.select(*columns, F.lit(False).alias("whole_entity")))
    )


def reading_order(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fetch the wanted chunks; entities by rank, chunks as they stand in the text.

    ``place`` numbers a query's chunks without sorting them in one task: a whole entity
    is numbered by its chunk index, only neighbours are counted, and the entities of a
    query, of which there are few, give the offsets.
    """
    entity = ["query_id", "entity_rank"]
    counts = wanted.groupBy(*entity).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("query_id").orderBy("entity_rank").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*entity, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*entity).orderBy("chunk_index"))
    numbered = (
        wanted.where("whole_entity")
        .withColumn("inside", F.col("chunk_index") + 1)
        .unionByName(wanted.where("NOT whole_entity").withColumn("inside", inside))
        .join(small_side(offsets), entity)
        .withColumn("place", (F.col("before") + F.col("inside")).cast("int"))
        .drop("before", "inside")
    )
    return chunks.join(small_side(numbered), ["snapshot", "entity_id", "chunk_index"])


def context_blocks(ordered: DataFrame) -> DataFrame:
    """One labelled block per entity: where the text comes from, then its chunks."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text", "title", "section", "page_start", "page_end")))
    blocks = ordered.groupBy("query_id", "entity_rank", "snapshot", "entity_id").agg(parts.alias("parts"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("entity_rank"))
    first = F.col("parts")[0]
    header = F.format_string(
        "[%d] %s | %s | snapshot of %s | %s | pages %s",
        F.col("block_no"),
        F.col("entity_id"),
        first["title"],
        tx.long_date(F.to_date("snapshot")),
        first["section"],
        tx.pages_label(first["page_start"], first["page_end"]),
    )
    body = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    return blocks.withColumn("block_no", number).select(
        "query_id", "block_no", "entity_id", "snapshot", F.concat_ws("\n", header, body).alias("block")
    )


def contexts(blocks: DataFrame) -> DataFrame:
    """All blocks of a query as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "block")))
    return blocks.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("context")
    )
