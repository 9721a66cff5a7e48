"""Dense vectors of chunks and queries: hashed term counts, weighted by inverse document frequency."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from snaptext import settings
from snaptext.functions import text as tx
from snaptext.operators.lexical import CHUNK_KEYS, QUERY_KEYS, LexicalIndex, entries
from snaptext.scale import small_side


def term_slot(term: Column, dims: int) -> Column:
    """Vector slot of a term: the first 32 bits of its MD5 modulo ``dims``."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % dims).cast("int")


def term_sign(term: Column) -> Column:
    return F.when(F.substring(F.md5(term), 9, 1) >= "8", F.lit(-1)).otherwise(F.lit(1))


def term_vectors(counts: DataFrame, keys: list[str], count: str, dims: int = settings.VECTOR_DIMS) -> DataFrame:
    """Signed hashed term counts per key as one dense vector; a group has at most ``dims`` rows."""
    slots = counts.groupBy(*keys, term_slot(F.col("term"), dims).alias("slot")).agg(
        F.sum(F.col(count) * term_sign(F.col("term"))).alias("value")
    )
    filled = slots.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.col("value").cast("double")))).alias("_map")
    )
    return filled.select(
        *keys,
        F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda i: F.coalesce(F.try_element_at("_map", i), F.lit(0.0)),
        ).alias("vector"),
    )


def _weighed(counts: DataFrame, idf: DataFrame, count: str) -> DataFrame:
    """Counts times inverse document frequency (``term, idf``), in whole thousandths so that sums don't depend on an order."""
    weight = F.round(F.col("idf") * 1000).cast("long")
    return counts.join(small_side(idf.select("term", weight.alias("_weight"))), "term").withColumn("weighed", F.col(count) * F.col("_weight"))


def chunk_vectors(counts: DataFrame | LexicalIndex, idf: DataFrame, dims: int = settings.VECTOR_DIMS) -> DataFrame:
    """A vector for every chunk, from the text (not the title). ``unit_vector`` brings it to length one, as distances by cosine do.

    ``counts`` are postings, or the index that holds them: its parts are summed as they are stored. Chunks with equal keys share a vector.
    """
    if isinstance(counts, DataFrame):
        return term_vectors(_weighed(counts.where("tf_body > 0"), idf, "tf_body"), CHUNK_KEYS, "weighed", dims)
    named = _part_vectors(counts, idf, dims).join(counts.chunks, "chunk_no")
    first, rest = F.col("_all")[0], F.slice("_all", 2, F.size("_all") - 1)
    summed = F.aggregate(rest, first, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    merged = named.groupBy(*CHUNK_KEYS).agg(F.collect_list("vector").alias("_all"))
    return merged.select(*CHUNK_KEYS, F.when(F.size("_all") == 1, first).otherwise(summed).alias("vector"))


def _part_vectors(index: LexicalIndex, idf: DataFrame, dims: int) -> DataFrame:
    """(``chunk_no``, ``vector``) of the chunks with a token in their text; a term's slot and weight are found once.

    Blocks get the weight of their term by their number, so that postings aren't shuffled however many terms there are.
    """
    weight = F.round(F.col("idf") * 1000).cast("long") * term_sign(F.col("term"))
    terms = idf.select("term", weight.alias("weight"), term_slot(F.col("term"), dims).alias("slot"))
    blocks = index.blocks.where("max_body > 0")
    weighed = blocks.select("part", "block_id", "term").join(small_side(terms), "term").select("part", "block_id", "slot", "weight")
    # Names of their own, as both sides come from the same table.
    held = blocks.select(F.col("part").alias("of_part"), F.col("block_id").alias("held_id"), "chunk_no", "tf_body")

    def fill(weighed: pa.Table, held: pa.Table) -> pa.Table:
        sizes = pc.list_value_length(held.column("chunk_no")).to_numpy()
        chunk_no, tf = entries(held, "chunk_no", "tf_body")
        block_id = weighed.column("block_id").to_numpy()
        order = np.argsort(block_id)
        place = order[np.searchsorted(block_id, held.column("held_id").to_numpy(), sorter=order)]
        slot, weight = (np.repeat(weighed.column(c).to_numpy()[place], sizes) for c in ("slot", "weight"))
        said = tf > 0
        chunk, numbers = pd.factorize(chunk_no[said])
        # Whole numbers, so that sums don't depend on an order.
        values = np.bincount(chunk * dims + slot[said], (tf * weight)[said].astype(np.float64), len(numbers) * dims)
        offsets = pa.array(np.arange(len(numbers) + 1) * dims, pa.int32())
        return pa.table([pa.array(numbers), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["chunk_no", "vector"])

    return weighed.groupBy("part").cogroup(held.groupBy("of_part")).applyInArrow(fill, "chunk_no long, vector array<double>")


def query_vectors(queries: DataFrame, idf: DataFrame, dims: int = settings.VECTOR_DIMS) -> DataFrame:
    """A vector for every query with a term that the corpus has."""
    terms = (
        queries.select(*QUERY_KEYS, F.explode(tx.tokens(F.col("text"))).alias("term"))
        .groupBy(*QUERY_KEYS, "term")
        .agg(F.count("*").alias("qtf"))
    )
    return term_vectors(_weighed(terms, idf, "qtf"), QUERY_KEYS, "weighed", dims)


def unit_vector(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    # The norm is an argument, not part of the lambda, or it would be taken once per element.
    norms = F.array_repeat(norm, F.size(vector))
    return F.when(norm > 0, F.zip_with(vector, norms, lambda x, length: x / length))


def refused(queries: DataFrame, hits: DataFrame, floor: float = settings.DISTANCE_FLOOR) -> DataFrame:
    """Queries with no near enough vector hit are refused; keyword hits do not count here."""
    best = hits.groupBy(*QUERY_KEYS).agg(F.min("distance").alias("best_distance"))
    return queries.join(best, QUERY_KEYS, "left").select(
        *QUERY_KEYS,
        "best_distance",
        (F.coalesce("best_distance", F.lit(float("inf"))) > floor).alias("refused"),
    )
