"""A batch of questions to ranked chunks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from snaptext import settings
from snaptext.operators import expansion, fusion, lexical, neighbours, vectors
from snaptext.scale import stored


@dataclass
class SearchTables:
    """What one corpus needs for retrieval; primary search sees the current snapshot only.

    Vectors and their lists are made when they are first asked for, so that purely lexical work goes without them.
    """

    chunks: DataFrame
    current: str
    index: lexical.LexicalIndex
    dims: int = settings.VECTOR_DIMS

    @cached_property
    def vectors(self) -> DataFrame:
        return stored(vectors.chunk_vectors(self.index, lexical.idf_table(self.index), self.dims), "vectors")

    @cached_property
    def neighbours(self) -> neighbours.VectorIndex:
        return neighbours.build(self.vectors, lexical.CHUNK_KEYS, lists_per_root=0.25)


def build_search(chunks: DataFrame, current: str, dims: int = settings.VECTOR_DIMS) -> SearchTables:
    now = chunks.where(F.col("snapshot") == current)
    return SearchTables(chunks, current, lexical.build_index(now), dims)


@dataclass
class RankedLists:
    """Deep lists of a query batch; shallower ones are their prefixes. Each is stored when it is first asked for."""

    tables: SearchTables
    queries: DataFrame
    aliases: DataFrame | dict[str, list[str]] | None
    n: int
    dims: int

    @cached_property
    def lexical(self) -> DataFrame:
        return stored(lexical.lexical_hits(self.tables.index, self.queries, self.n, self.aliases), "lexical")

    @cached_property
    def vector(self) -> DataFrame:
        asked = vectors.query_vectors(self.queries, lexical.idf_table(self.tables.index), self.dims)
        return stored(neighbours.nearest(asked, self.tables.neighbours, self.n), "nearest")


def search(
    tables: SearchTables,
    queries: DataFrame,
    aliases: DataFrame | dict[str, list[str]] | None = None,
    n: int = settings.DEEP_CANDIDATES,
    dims: int = settings.VECTOR_DIMS,
) -> RankedLists:
    """Lexical and vector lists for ``query_id, sub_no, text``, stored for reuse."""
    return RankedLists(tables, queries, aliases, n, dims)


def hybrid_union(
    lists: RankedLists, demoted: DataFrame | None = None, k: int = settings.TOP_K, budget: int = settings.UNION_BUDGET
) -> tuple[DataFrame, DataFrame]:
    """Hybrid top ``k`` of every sub-query, and their round-robin union per query."""
    hits = stored(fusion.hybrid_hits(lists.vector, lists.lexical, demoted, k), "hybrid")
    return hits, stored(fusion.round_robin(hits, budget), "union")


def reading(tables: SearchTables, union: DataFrame, served: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks to read for each query, and the same with their texts in reading order."""
    wanted = stored(expansion.wanted_chunks(union, served, tables.chunks, tables.current), "wanted")
    return wanted, expansion.reading_order(wanted, tables.chunks)
