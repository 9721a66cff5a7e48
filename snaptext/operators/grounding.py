"""Records around an answer: what was retrieved, what grounds it, what it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from snaptext import settings
from snaptext.functions import text as tx
from snaptext.operators.timelines import scope_note
from snaptext.scale import only_keys_of

# Nested answer record, as read from JSON.
ANSWER_SCHEMA = (
    "refused boolean, headline string, reason string, out_of_scope_note string, "
    "obligations array<struct<obligation:string, detail:string, "
    "citations:array<struct<entity_id:string, title:string, pages:string>>>>"
)


def retrieved_sources(union: DataFrame, chunks: DataFrame, served: DataFrame, current: str) -> DataFrame:
    """One row per retrieved chunk: entity, title, pages, distance and the snapshot served for it."""
    about = only_keys_of(
        chunks.where(F.col("snapshot") == current).select(
            "entity_id", "chunk_index", "title", "page_start", "page_end"
        ),
        union,
        ["entity_id", "chunk_index"],
    )
    return (
        union.join(about, ["entity_id", "chunk_index"])
        .join(served.select("query_id", "entity_id", F.col("snapshot").alias("served")), ["query_id", "entity_id"], "left")
        .select(
            "query_id",
            "rank",
            "entity_id",
            "title",
            tx.pages_label(F.col("page_start"), F.col("page_end")).alias("pages"),
            F.round("distance", 3).alias("distance"),
            tx.distance_label(F.col("distance")).alias("distance_label"),
            "served",
        )
    )


def facts_per_query(union: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts (``query_id, entity_id, kind, fact``) of a query's entities as one list text."""
    mine = facts.join(union.select("query_id", "entity_id").distinct(), ["query_id", "entity_id"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("kind", "entity_id", "fact")))
    return mine.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("- "), x["fact"])), "\n").alias("facts")
    )


def covered_entities(union: DataFrame, mapped: DataFrame) -> DataFrame:
    """Which of a query's entities have a known history (``mapped``: ``entity_id``), as one text."""
    mine = union.select("query_id", "entity_id").distinct()
    known = mine.join(only_keys_of(mapped.select("entity_id"), mine, ["entity_id"]), "entity_id", "left_semi")
    return known.groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_list("entity_id")), ", ").alias("covered")
    )


def grounding_records(
    questions: DataFrame, facts: DataFrame, covered: DataFrame, contexts: DataFrame, current: str, today: Column
) -> DataFrame:
    """Everything an answer may rest on, as one text per query (``query_id, text, as_of``).

    Parts that do not apply are left out: the note on past dates and the facts.
    """
    day = F.col("as_of")
    record = F.concat_ws(
        "\n\n",
        F.lit(f"Current snapshot: {current}."),
        F.concat(F.lit("As of: "), tx.long_date(day)),
        scope_note(day, today, F.coalesce("covered", F.lit("no entity")), current),
        F.concat(F.lit("Facts:\n"), F.col("facts")),
        F.concat(F.lit("Question: "), F.col("text")),
        F.concat(F.lit("Extracts:\n\n"), F.col("context")),
    )
    return (
        questions.join(facts, "query_id", "left")
        .join(covered, "query_id", "left")
        .join(contexts, "query_id", "left")
        .select("query_id", "as_of", record.alias("record"))
    )


def flattened_citations(answers: DataFrame, keyword: str = "condition") -> DataFrame:
    """Citations of nested answers in order, ids cleaned, first of each id kept."""
    one = answers.select("query_id", F.posexplode("obligations").alias("ob_no", "ob")).select(
        "query_id", "ob_no", F.posexplode("ob.citations").alias("ci_no", "ci")
    )
    clean = one.select(
        "query_id", "ob_no", "ci_no", tx.bare_id(F.col("ci.entity_id"), keyword).alias("entity_id"), "ci.title", "ci.pages"
    ).where("entity_id <> ''")
    first = clean.groupBy("query_id", "entity_id").agg(
        F.min(F.struct("ob_no", "ci_no", "title", "pages")).alias("f")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("f.ob_no", "f.ci_no"))
    return first.select("query_id", place.alias("cite_no"), "entity_id", "f.title", "f.pages")


def parsed_answers(raw: DataFrame) -> DataFrame:
    """Answers from JSON text (``query_id, answer_json``)."""
    return raw.select("query_id", F.from_json("answer_json", ANSWER_SCHEMA).alias("a")).select("query_id", "a.*")


def history_rows(
    citations: DataFrame,
    views: DataFrame,
    questions: DataFrame,
    narrow: int = settings.HISTORY_NARROW,
    broad: int = settings.HISTORY_BROAD,
) -> DataFrame:
    """Histories of the first cited entities that have one; more for broad questions."""
    asked = citations.join(questions.select("query_id", "as_of", "is_broad"), "query_id")
    found = asked.join(views, ["entity_id", "as_of"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("cite_no"))
    limit = F.when(F.col("is_broad"), broad).otherwise(narrow)
    return (
        found.withColumn("history_no", place)
        .where(F.col("history_no") <= limit)
        .select("query_id", "history_no", "entity_id", "kind", "change_date", "as_of")
    )
