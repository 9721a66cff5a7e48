"""Grading of retrieval and answers against expectations. Null means: not applicable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def graded_cases(
    cases: DataFrame,
    expected: DataFrame,
    results: DataFrame,
    retrieved: DataFrame,
    cited: DataFrame,
    history: DataFrame,
) -> DataFrame:
    """One row per case with its checks.

    ``cases``: ``query_id, expected, expect_contains, expect_snapshot, expect_history``; ``expected``: the expected
    entities as rows ``query_id, entity_id``, any number of them; ``results``: ``query_id, refused, answer``; ``retrieved``: ``query_id,
    rank, entity_id, served``; ``cited``: ``query_id, entity_id``; ``history``: ``query_id,
    entity_id, kind, consistent`` (null for kinds without the invariant).
    """
    gold = expected.select("query_id", "entity_id").distinct().join(cases.select("query_id", "expect_snapshot", "expect_history"), "query_id")
    keys = ["query_id", "entity_id"]
    found = (
        retrieved.join(gold, keys)
        .groupBy("query_id")
        .agg(F.min("rank").alias("rank"), F.bool_or(F.col("served") == F.col("expect_snapshot")).alias("_served"))
    )
    cites = cited.join(gold, keys, "left_semi").select("query_id").distinct().withColumn("_cited", F.lit(True))
    kinds = history.join(gold, keys).groupBy("query_id").agg(
        F.bool_or(F.col("kind") == F.col("expect_history")).alias("_kind")
    )
    holds = history.groupBy("query_id").agg(F.bool_and("consistent").alias("_consistent"))
    rows = (
        cases.join(results, "query_id")
        .join(found, "query_id", "left")
        .join(cites, "query_id", "left")
        .join(kinds, "query_id", "left")
        .join(holds, "query_id", "left")
    )
    is_answer = F.col("expected") == "answer"
    no = F.lit(False)
    asked = lambda name, value: F.when(F.col(name).isNotNull(), F.coalesce(value, no))
    kind_ok = asked("expect_history", F.col("_kind"))
    # A history that contradicts itself fails whatever the case asks for.
    history_ok = (
        F.when(F.col("_consistent") == no, no)
        .when(F.col("expect_history").isNotNull(), kind_ok)
        .when(F.col("_consistent"), F.lit(True))
    )
    return rows.select(
        "query_id",
        "expected",
        "refused",
        ((F.col("expected") == "refuse") == F.col("refused")).alias("decision_ok"),
        F.when(is_answer, F.col("rank").isNotNull()).alias("retrieval_hit"),
        F.when(is_answer, F.col("rank")).alias("rank"),
        F.when(is_answer, F.coalesce("_cited", no)).alias("citation_hit"),
        asked("expect_contains", F.contains(F.lower("answer"), F.lower("expect_contains"))).alias("contains_ok"),
        asked("expect_snapshot", F.col("_served")).alias("snapshot_ok"),
        history_ok.alias("history_ok"),
    )


def recall_at(graded: DataFrame, at: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """Answer cases found within each depth, and the mean rank of those found at all."""
    answers = graded.where("expected = 'answer'")
    return answers.agg(
        F.count("*").alias("n_answer"),
        F.count_if("retrieval_hit").alias("n_hit"),
        *[F.count_if(F.col("rank") <= k).alias(f"recall_{k}") for k in at],
        F.round(F.avg("rank"), 2).alias("mean_rank"),
    )


def _share(check: str) -> Column:
    """``ok/asked``; rows where the check does not apply count in neither."""
    return F.concat_ws("/", F.count_if(F.col(check)).cast("string"), F.count(check).cast("string")).alias(check)


def summary(graded: DataFrame) -> DataFrame:
    """All checks as shares of the cases they apply to."""
    checks = ["decision_ok", "retrieval_hit", "citation_hit", "contains_ok", "snapshot_ok", "history_ok"]
    return graded.agg(F.count("*").alias("n_cases"), *[_share(c) for c in checks])


def decision_lists(graded: DataFrame) -> DataFrame:
    """Cases by outcome where the decision deserves a look."""
    refused, answer = F.col("refused"), F.col("expected") == "answer"
    outcome = (
        F.when(answer & refused, "false refusal")
        .when(~answer & refused, "correct refusal")
        .when(~answer & ~refused, "false answer")
    )
    return graded.select("query_id", outcome.alias("outcome")).where("outcome IS NOT NULL")


def _grid(queries: DataFrame, surfaced: DataFrame, by: list[str]) -> DataFrame:
    """Every query under every variant; variants are few and come to the driver."""
    if not by:
        return queries
    variants = [r.asDict() for r in surfaced.select(*by).distinct().collect()]
    if not variants:
        return queries.limit(0).select("*", *[F.lit(None).cast(surfaced.schema[b].dataType).alias(b) for b in by])
    each = F.explode(F.array(*[F.struct(*[F.lit(v[b]).alias(b) for b in by]) for v in variants])).alias("_v")
    return queries.select("*", each).select(*queries.columns, *[F.col(f"_v.{b}").alias(b) for b in by])


def core_recall(core: DataFrame, borderline: DataFrame, surfaced: DataFrame, by: list[str]) -> DataFrame:
    """Core entities surfaced, and noise outside core and borderline, as counts per variant and query.

    ``core`` and ``borderline``: ``query_id, entity_id``; ``surfaced``: ``by..., query_id, entity_id``; repeats count once. Entities
    stay rows of their own, so a query may have any number of them. Queries with nothing surfaced keep their row.
    """
    pair = ["query_id", "entity_id"]
    told = core.select(*pair, F.lit(True).alias("is_core")).unionByName(borderline.select(*pair, F.lit(False).alias("is_core")))
    known = told.groupBy(*pair).agg(F.bool_or("is_core").alias("is_core"))
    found = surfaced.select(*by, *pair).distinct().join(known, pair, "left")
    counts = found.groupBy(*by, "query_id").agg(
        F.count_if("is_core").alias("n_found"), F.count_if(F.col("is_core").isNull()).alias("n_noise")
    )
    sizes = known.where("is_core").groupBy("query_id").agg(F.count("*").alias("n_core"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _grid(sizes, surfaced, by).join(counts, [*by, "query_id"], "left").select(*by, "query_id", "n_core", zero("n_found"), zero("n_noise"))


def missing_core(core: DataFrame, surfaced: DataFrame, by: list[str]) -> DataFrame:
    """The core entities that were not surfaced, one row each (``by..., query_id, entity_id``)."""
    pairs = core.select("query_id", "entity_id").distinct()
    return _grid(pairs, surfaced, by).join(surfaced, [*by, "query_id", "entity_id"], "left_anti")


def core_totals(per_query: DataFrame, by: list[str]) -> DataFrame:
    """Micro recall over all queries, number of noisy queries and noise entities."""
    return per_query.groupBy(*by).agg(
        F.sum("n_found").alias("found"),
        F.sum("n_core").alias("core"),
        F.round(F.try_divide(F.sum("n_found"), F.sum("n_core")), 4).alias("recall"),
        F.count_if(F.col("n_noise") > 0).alias("noisy_queries"),
        F.sum("n_noise").alias("noise"),
    )


def refusals(results: DataFrame, by: list[str]) -> DataFrame:
    """How many questions were asked and refused, per pass or variant (``refused``; null counts as answered)."""
    return results.groupBy(*by).agg(F.count("*").alias("asked"), F.count_if(F.col("refused")).alias("refused"))


def side_by_side(per_query: DataFrame, variants: list[str]) -> DataFrame:
    """The same queries under several variants, one column set per variant."""
    return per_query.groupBy("query_id").pivot("variant", variants).agg(
        F.first("n_found").alias("found"), F.first("n_noise").alias("noise")
    )


def entity_count(chunks: DataFrame, current: str) -> DataFrame:
    """Distinct entities in the current snapshot."""
    return chunks.where(F.col("snapshot") == current).agg(F.countDistinct("entity_id").alias("n_entities"))
