"""Ranked lists: fusion, demotion, sub-query lists and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from snaptext import settings
from snaptext.operators import phrases
from snaptext.operators.lexical import CHUNK_KEYS, QUERY_KEYS, first_n
from snaptext.scale import only_keys_of, small_side


def _numbered(lists: list[DataFrame], columns: list[str]) -> DataFrame:
    parts = [df.select(*columns).withColumn("list_no", F.lit(i)) for i, df in enumerate(lists, 1)]
    return reduce(DataFrame.unionByName, parts)


def reciprocal_rank(lists: list[DataFrame], k: int = settings.RRF_K) -> DataFrame:
    """Fuse ranked lists by the sum of ``1 / (k + rank)``; equal scores keep first-seen order."""
    fused = (
        _numbered(lists, [*QUERY_KEYS, "rank", *CHUNK_KEYS])
        .groupBy(*QUERY_KEYS, *CHUNK_KEYS)
        .agg(
            F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 12).alias("score"),
            F.min(F.struct("list_no", "rank")).alias("seen"),
        )
    )
    rank = F.row_number().over(Window.partitionBy(*QUERY_KEYS).orderBy(F.desc("score"), "seen"))
    return fused.select(*QUERY_KEYS, rank.alias("rank"), *CHUNK_KEYS, "score")


def hybrid_hits(
    vector: DataFrame,
    lexical: DataFrame,
    demoted: DataFrame | None = None,
    k: int = settings.TOP_K,
    candidates: int = settings.CANDIDATES,
) -> DataFrame:
    """Top ``k`` of both lists fused; demoted entities rank below all others; distance or null."""
    near = vector.where(F.col("rank") <= candidates)
    fused = reciprocal_rank([near, lexical.where(F.col("rank") <= candidates)]).withColumnRenamed(
        "rank", "fused_rank"
    )
    if demoted is None:
        flagged = fused.withColumn("demoted", F.lit(False))
    else:
        few = only_keys_of(demoted.select("entity_id").distinct(), fused, ["entity_id"])
        flagged = fused.join(few.withColumn("demoted", F.lit(True)), "entity_id", "left").withColumn(
            "demoted", F.coalesce("demoted", F.lit(False))
        )
    top = first_n(flagged, k, QUERY_KEYS, [F.asc("demoted"), F.asc("fused_rank")])
    distance = near.select(*QUERY_KEYS, *CHUNK_KEYS, "distance")
    return top.join(distance, [*QUERY_KEYS, *CHUNK_KEYS], "left").select(
        *QUERY_KEYS, "rank", *CHUNK_KEYS, "score", "demoted", "distance"
    )


def entity_order(hits: DataFrame) -> DataFrame:
    """Distinct entities of each list in order of first appearance."""
    first = hits.groupBy(*QUERY_KEYS, "entity_id").agg(F.min("rank").alias("first_rank"))
    rank = F.row_number().over(Window.partitionBy(*QUERY_KEYS).orderBy("first_rank"))
    return first.withColumn("entity_rank", rank)


def landscape(vector: DataFrame, lexical: DataFrame, n: int = settings.LANDSCAPE_SIZE) -> DataFrame:
    """The entities a wide search reaches: those of the vector list first, then the lexical ones."""
    seen = (
        _numbered([vector, lexical], [*QUERY_KEYS, "rank", "entity_id"])
        .groupBy(*QUERY_KEYS, "entity_id")
        .agg(F.min(F.struct("list_no", "rank")).alias("seen"))
    )
    return first_n(seen, n, QUERY_KEYS, [F.asc("seen")]).select(*QUERY_KEYS, "rank", "entity_id")


def hint_tables(spark: SparkSession, hints: list[tuple[list[str], list[str]]]) -> tuple[DataFrame, DataFrame]:
    """Tables of a few hints given in code, each (triggers, sub-queries)."""
    triggers = [(i, t) for i, (ts, _) in enumerate(hints) for t in ts]
    told = [(i, n, q) for i, (_, qs) in enumerate(hints) for n, q in enumerate(qs)]
    return spark.createDataFrame(triggers, "hint int, trigger string"), spark.createDataFrame(told, "hint int, pos int, text string")


def hint_subqueries(questions: DataFrame, triggers: DataFrame, told: DataFrame) -> DataFrame:
    """Stored sub-queries of every hint with a trigger in a broad question.

    ``questions`` has ``query_id, text, is_broad``, ``triggers`` ``hint, trigger`` and ``told`` the sub-queries ``hint, pos, text``; any
    number of them. Hints come in the order of their numbers.
    """
    asked = questions.where("is_broad").select("query_id", F.lower("text").alias("text"))
    found = phrases.matches(asked, ["query_id"], triggers.select(F.col("trigger").alias("phrase")))
    hit = found.join(small_side(triggers.withColumnRenamed("trigger", "phrase")), "phrase").select("query_id", "hint").distinct()
    rows = hit.join(small_side(told), "hint")
    return _first_of_each_text(rows, ["hint", "pos"]).select(
        "query_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("hint", "pos"))).alias("hint_no"), "text"
    )


def _first_of_each_text(rows: DataFrame, order: list[str]) -> DataFrame:
    """Drop blank texts and, ignoring case, all but the first of equal ones."""
    same = Window.partitionBy("query_id", F.lower("text")).orderBy(*order)
    return (
        rows.where(F.col("text") != "")
        .withColumn("_nth", F.row_number().over(same))
        .where("_nth = 1")
        .drop("_nth")
    )


def assemble_subqueries(
    questions: DataFrame,
    hints: DataFrame,
    planned: DataFrame,
    most: int = settings.MAX_SUBQUERIES,
) -> DataFrame:
    """The question itself, then its hints, then planned sub-queries, without repeats.

    At most ``most`` plus the number of hints remain; ``sub_no`` 0 is the question.
    """
    n_hints = hints.groupBy("query_id").agg(F.count("*").alias("n_hints"))
    rows = (
        questions.select("query_id", F.lit(0).alias("kind"), F.lit(0).alias("pos"), "text")
        .unionByName(hints.select("query_id", F.lit(1).alias("kind"), F.col("hint_no").alias("pos"), "text"))
        .unionByName(
            planned.select("query_id", F.lit(2).alias("kind"), F.col("plan_no").alias("pos"), F.trim("text").alias("text"))
        )
    )
    distinct = _first_of_each_text(rows, ["kind", "pos"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("kind", "pos"))
    return (
        distinct.withColumn("sub_no", (place - 1).cast("int"))
        .join(n_hints, "query_id", "left")
        .where(F.col("sub_no") < most + F.coalesce("n_hints", F.lit(0)))
        .select("query_id", "sub_no", "text")
    )


def round_robin(hits: DataFrame, budget: int = settings.UNION_BUDGET) -> DataFrame:
    """Union of a query's sub-query lists: all first places, then all second places, and so on."""
    first = hits.groupBy("query_id", *CHUNK_KEYS).agg(
        F.min(F.struct("rank", "sub_no", "distance")).alias("seen")
    )
    placed = first_n(first, budget, ["query_id"], [F.asc("seen.rank"), F.asc("seen.sub_no")])
    return placed.select("query_id", "rank", *CHUNK_KEYS, "seen.distance")


def union_truncated(hits: DataFrame, budget: int = settings.UNION_BUDGET) -> DataFrame:
    """Whether the lists of a query hold more distinct chunks than the budget."""
    return hits.groupBy("query_id").agg(
        F.countDistinct(*CHUNK_KEYS).alias("n_distinct"),
        (F.countDistinct(*CHUNK_KEYS) > budget).alias("truncated"),
    )
