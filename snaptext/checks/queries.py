"""One registered query per operator, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snaptext.checks import bindings as bd
from snaptext.functions import text as tx
from snaptext.operators import (
    changes,
    chunking,
    evaluation,
    expansion,
    fusion,
    grounding,
    lexical,
    lines,
    neighbours,
    phrases,
    sections,
    textdiff,
    timelines,
    vectors,
)
from snaptext.plans import ingest
from snaptext.scale import stored
from snaptext.sources import pages as page_source, published, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[bd.Data], DataFrame]) -> Callable[[bd.Data], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(bd.data(spark, folder))
    return fn


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# Sources.


@query
def page_counts(d):
    return page_source.page_counts(d.page_records())


@query
def snapshot_dates(d):
    """File names made from order dates, with and without a day, back to dates."""
    pattern = F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "yyyy-MM")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    named = d.table("orders").select(F.concat(F.lit("orders-"), pattern, F.lit(".txt")).alias("file"))
    return named.groupBy(page_source.name_date(F.col("file")).alias("date")).agg(F.count("*").alias("n_files"))


@query
def snapshot_registry(d):
    registry = d.snapshot_registry()
    latest = registry.agg(F.max_by("snapshot", "date")).first()[0]
    return longs(registry, "idx").withColumn("is_current", F.col("snapshot") == latest)


@query
def fetch_by_ids(d):
    """Chunks named by the hits of all questions."""
    ids = d.hits.select(
        chunking.chunk_id(F.lit(bd.CURRENT), F.col("entity_id"), F.col("chunk_index")).alias("chunk_id")
    )
    return longs(expansion.by_ids(d.chunks, ids).select("chunk_id", "n_words", "text"), "n_words")


@query
def published_pages(d):
    """Page records written as a published table, then again for two snapshots, and read back; beside them what the last write observed."""
    seen = published.manifest(d.spark, d.published_pages)["tables"]["pages"]["metrics"]
    held = published.read(d.spark, d.published_pages, "pages").groupBy("snapshot").agg(
        F.count("*").alias("n_pages"), F.count_if(F.trim("text") == "").alias("n_empty"), F.sum(F.length("text")).alias("n_chars")
    )
    return held.withColumns({f"last_{name}": F.lit(value or 0).cast("long") for name, value in seen.items()})


@query
def published_chunks(d):
    """Chunks published by snapshot, one of them rebuilt, read back as one table."""
    return longs(chunking.chunk_statistics(d.published_chunks()), "min_words", "max_words")


@query
def published_run(d):
    """Graded rows and their summary, published twice together and read back."""
    path = f"{d.published}/run"
    for _ in range(2):
        tables.publish_run(_graded(d), evaluation.summary(_graded(d)), path)
    n = published.read(d.spark, path, "rows").agg(F.count("*").alias("n_rows"), F.count_if(F.col("decision_ok")).alias("n_right")).first()
    return published.read(d.spark, path, "summary").withColumns({name: F.lit(value) for name, value in n.asDict().items()})


@query
def published_report(d):
    """The change report published by class with its details; two of the classes read back."""
    path = f"{d.published}/report"
    titles = d.customer_snapshots().select("entity_id", "idx", F.concat(F.lit("status "), "text").alias("title"))
    classes = _classes(d)
    tables.publish_report(changes.report_rows(classes, titles), _customer_details(d, classes), path)
    few = published.read(d.spark, path, "report").where(F.col("class").isin("SINGLE-CHANGE", "INTRODUCED"))
    held = published.read(d.spark, path, "details").select("entity_id", *_shown_details())
    return longs(few.join(held, "entity_id"), "interval", "n_changes").drop("id_number")


@query
def dated_pages(d):
    """Pages written as one file of JSON lines per snapshot and date, of which those from 2022 on are read."""
    path = f"{d.published}/dated"
    years = {"de": "2020-05", "en": "2021-06-07", "es": "2022-01", "fr": "2023-11-30"}
    for snapshot, date in years.items():
        rows = d.page_records().where(F.col("snapshot") == snapshot).select("page", F.concat(F.lit("text of "), F.col("text")).alias("text"))
        page_source.write_dated(rows, path, f"pages-{date}")
    read = page_source.read_dated_pages(d.spark, path, since="2022-01-01")
    return read.groupBy("date").agg(F.count("*").alias("n_pages"), F.sum("page").cast("long").alias("pages"), F.sum(F.length("text")).alias("n_chars"))


@query
def chunk_metadata(d):
    """Chunks with what is known of their snapshot."""
    named = chunking.with_snapshot(d.chunks, d.edition_registry())
    return longs(named.select("chunk_id", "source", "doc_title", "version_date", "authority", "url", "chunk_index", "n_words"), "chunk_index", "n_words")


@query
def fetch_snapshot(d):
    return longs(
        expansion.in_snapshot(d.published_chunks(), bd.OLD).select("chunk_id", "entity_id", "chunk_index", "n_words"),
        "chunk_index", "n_words",
    )


# Lines, sections, chunks.


@query
def boilerplate_filter(d):
    kept = lines.body_lines(d.texts("documents", "doc_id").select("doc_id", "text"), bd.RULES)
    return longs(kept, "line_no")


@query
def page_headings(d):
    return longs(d.parsed_pages.headings, "page_start")


@query
def sectionise_pages(d):
    return longs(d.parsed_pages.sections, "page_start", "page_end")


@query
def merge_sections(d):
    return longs(d.parsed_pages.entities, "page_start", "page_end")


@query
def section_bodies(d):
    bodies = sections.section_bodies(d.parsed_pages.lines, ["snapshot", "entity_id"])
    return bodies.select("snapshot", "entity_id", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("digest"))


@query
def page_chunks(d):
    return longs(ingest.chunk_pages(d.parsed_pages), "page_start", "page_end", "chunk_index", "n_words")


@query
def chunk_windows(d):
    return longs(d.chunk_rows(), "page_start", "page_end", "chunk_index", "n_words")


@query
def chunk_stats(d):
    return longs(chunking.chunk_statistics(d.chunks), "min_words", "max_words")


@query
def entity_sizes(d):
    return chunking.entity_sizes(d.chunks)


@query
def reconstruct_roundtrip(d):
    """Texts rebuilt from chunks, compared with the words of the originals."""
    body = chunking.stub_body(F.col("body"), F.col("entity_id"), F.col("title"))
    originals = d.editions().select("snapshot", "entity_id", tx.single_spaced(body).alias("original"))
    return chunking.rebuilt_beside(d.chunks, originals).select(
        "snapshot", "entity_id", F.md5("text").alias("digest"), (F.col("text") == F.col("original")).alias("same")
    )


@query
def tokenise(d):
    toks = d.texts("documents", "doc_id").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def normalise_text(d):
    norm = d.texts("documents", "doc_id").select("doc_id", tx.normalised(F.col("text")).alias("t"))
    return norm.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


# Scalars.


@query
def natural_ids(d):
    ids = d.page_records().select(F.regexp_extract("text", r"\nCondition ([^\s]+)\. ", 1).alias("entity_id")).distinct()
    return ids.select("entity_id", tx.natural_number(F.col("entity_id")).alias("id_number"))


@query
def bare_ids(d):
    """Customer names and part brands written as citations, back to bare ids."""
    name = F.concat(F.lit("Condition "), F.regexp_extract("c_name", r"0*(\d+)$", 1), F.substring("c_mktsegment", 1, 2), F.lit(".B - title"))
    return d.table("customer").select("c_custkey", tx.bare_id(name).alias("bare"), tx.bare_id(F.col("c_name")).alias("raw"))


@query
def long_dates(d):
    day = F.to_date("o_orderdate")
    return d.table("orders").select(
        "o_orderkey", tx.long_date(day).alias("day"), tx.past_date(day, F.lit("1998-01-01").cast("date")).alias("is_past")
    )


# Lexical retrieval.


@query
def inverted_index(d):
    return longs(d.search_tables.index.postings, "chunk_index", "tf_body", "tf_title", "len_body", "len_title")


@query
def idf_table(d):
    return lexical.idf_table(d.search_tables.index).withColumn("idf", F.round("idf", 6))


@query
def alias_expand(d):
    return longs(lexical.query_terms(d.asked, bd.ALIASES), "sub_no")


def _ranked(df: DataFrame) -> DataFrame:
    return longs(df, "sub_no", "rank", "chunk_index")


@query
def phrase_matches(d):
    """Benchmark items in which titles of pages and first words of documents occur."""
    few = F.array_join(F.slice(F.split("text", "[ \n]+"), 1, 2), " ")
    told = d.table("documents").select(F.substring(few, 1, 12).alias("phrase")).unionByName(d.table("region").select(F.lower(F.substring("r_name", 2, 2)).alias("phrase")))
    return phrases.matches(d.table("benchmark").select("item_id", "text"), ["item_id"], told)


@query
def bm25_top10(d):
    return _ranked(d.lists.lexical.where("rank <= 10"))


@query
def bm25_top40(d):
    return _ranked(d.lists.lexical)


@query
def bm25_title_boost(d):
    """Where the first entity of each question ranks without and with the title boost."""
    asked = d.asked.where("sub_no = 0")
    top = lambda weight, name: lexical.lexical_hits(
        d.search_tables.index, asked, 1, bd.ALIASES, title_weight=weight
    ).select("query_id", F.col("entity_id").alias(f"entity_{name}"), F.col("score").alias(f"score_{name}"))
    return top(1, "plain").join(top(8, "boosted"), "query_id")


# Vector retrieval.


@query
def chunk_vectors(d):
    v = d.search_tables.vectors
    return v.select(
        "entity_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), ",").alias("vector"),
    )


@query
def text_knn_top40(d):
    return _ranked(d.lists.vector).withColumn("distance", F.round("distance", 6))


@query
def knn_top10(d):
    near = neighbours.nearest(d.vector_queries(), d.exact_vectors, 10, digits=4)
    return longs(near.select("query_id", "rank", "vec_id", "distance"), "rank")


@query
def knn_approx(d):
    near = neighbours.nearest_approx(d.vector_queries(), d.unit_vectors, 10)
    return longs(near.select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance")), "rank")


@query
def distance_backstop(d):
    refused = vectors.refused(d.asked.select("query_id", "sub_no"), d.lists.vector.where("rank <= 10"), bd.DISTANCE_FLOOR)
    return longs(refused, "sub_no").withColumn("best_distance", F.round("best_distance", 6))


# Fusion.


@query
def rrf_fuse(d):
    ten = [d.lists.vector.where("rank <= 10"), d.lists.lexical.where("rank <= 10")]
    return _ranked(fusion.reciprocal_rank(ten)).withColumn("score", F.round("score", 9))


@query
def hybrid_top6_demoted(d):
    return _ranked(d.hits).withColumns({"score": F.round("score", 9), "distance": F.round("distance", 6)})


@query
def distance_labels(d):
    return _ranked(d.hits).select("query_id", "sub_no", "rank", tx.distance_label(F.col("distance")).alias("label"))


@query
def candidate_landscape(d):
    return longs(fusion.landscape(d.lists.vector, d.lists.lexical), "sub_no", "rank")


@query
def hint_subqueries(d):
    return longs(fusion.hint_subqueries(d.questions(), *fusion.hint_tables(d.spark, bd.HINTS)), "hint_no")


@query
def subquery_assembly(d):
    return longs(d.subqueries(), "sub_no")


@query
def round_robin_union(d):
    return longs(d.union, "rank", "chunk_index").withColumn("distance", F.round("distance", 6))


@query
def union_truncated(d):
    """Whether a union of 12 would hold everything found."""
    return fusion.union_truncated(d.hits, 12)


@query
def entities_first_seen(d):
    return longs(fusion.entity_order(d.hits), "sub_no", "first_rank", "entity_rank")


# Context.


@query
def chunk_index_sets(d):
    return longs(expansion.chunk_index_sets(d.chunks), "first_index", "last_index")


@query
def expand_context(d):
    return longs(
        d.reading[0].select("query_id", "entity_rank", "snapshot", "entity_id", "chunk_index", "whole_entity"),
        "entity_rank", "chunk_index",
    )


@query
def expand_neighbours(d):
    """The same with small limits, so that most hits bring neighbours only."""
    few = expansion.wanted_chunks(d.union, d.served, d.chunks, bd.CURRENT, whole=1, strong=1, strong_whole=2)
    return longs(
        few.select("query_id", "entity_rank", "snapshot", "entity_id", "chunk_index", "whole_entity"),
        "entity_rank", "chunk_index",
    )


@query
def reading_order(d):
    return longs(d.reading[1].select("query_id", "place", "chunk_id", "text"), "place")


@query
def context_blocks(d):
    return longs(expansion.context_blocks(d.reading[1]), "block_no")


def _facts(d) -> DataFrame:
    """What is known of the entities of each question at its date: of their existence, then of their texts."""
    asked = d.union.join(d.questions().select("query_id", "as_of"), "query_id").select("query_id", "entity_id", "as_of").distinct()
    existence = timelines.existence_facts(asked.select("entity_id", "as_of").distinct(), d.document_existence())
    texts = timelines.change_facts(d.resolved, timelines.change_dates(d.document_timeline()))
    both = existence.withColumn("kind", F.lit(1)).unionByName(texts.select("entity_id", "as_of", "fact", F.lit(2).alias("kind")))
    return asked.join(both, ["entity_id", "as_of"]).select("query_id", "entity_id", "kind", "fact")


@query
def grounding_record(d):
    facts = grounding.facts_per_query(d.union, _facts(d))
    covered = grounding.covered_entities(d.union, d.table("labels").select(F.col("doc_id").cast("string").alias("entity_id")))
    return grounding.grounding_records(
        d.questions(), facts, covered, expansion.contexts(expansion.context_blocks(d.reading[1])),
        bd.CURRENT, F.to_date(F.lit(bd.TODAY)),
    )


@query
def retrieved_sources(d):
    return longs(grounding.retrieved_sources(d.union, d.chunks, d.served, bd.CURRENT), "rank")


def _answers(d) -> DataFrame:
    """Nested answers as JSON: three hits to an obligation, ids written out as a model would."""
    cite = F.struct(
        F.concat(F.lit("Condition "), "entity_id", F.lit(" - as cited")).alias("entity_id"),
        F.concat(F.lit("title "), "entity_id").alias("title"),
        F.col("rank").cast("string").alias("pages"),
    )
    obligation = F.floor((F.col("rank") - 1) / 3)
    per = d.union.groupBy("query_id", obligation.alias("ob")).agg(
        F.array_sort(F.collect_list(F.struct("rank", cite.alias("c")))).alias("cs")
    )
    one = per.select(
        "query_id",
        "ob",
        F.struct(
            F.concat(F.lit("obligation "), F.col("ob").cast("string")).alias("obligation"),
            F.lit("").alias("detail"),
            F.transform("cs", lambda x: x["c"]).alias("citations"),
        ).alias("o"),
    )
    return one.groupBy("query_id").agg(
        F.to_json(
            F.struct(
                F.lit(False).alias("refused"),
                F.transform(F.array_sort(F.collect_list(F.struct("ob", "o"))), lambda x: x["o"]).alias("obligations"),
            )
        ).alias("answer_json")
    )


def _citations(d) -> DataFrame:
    return grounding.flattened_citations(grounding.parsed_answers(_answers(d)))


@query
def citation_flatten(d):
    return longs(_citations(d), "cite_no")


def _document_history(d) -> DataFrame:
    none = d.introductions().select("entity_id", "title", "introduced")
    return timelines.history_view(d.resolved, none)


@query
def citation_history(d):
    rows = grounding.history_rows(_citations(d), _document_history(d), d.questions())
    return longs(rows, "history_no")


# Dates.


@query
def timeline_segments(d):
    line = d.order_timeline().select("entity_id", "seg_idx", "start", "end", "snapshot", "note", "n_segments", "introduced")
    return longs(line, "seg_idx", "n_segments")


@query
def segment_gap_check(d):
    return timelines.gap_check(d.order_timeline())


def _segments(d) -> DataFrame:
    return d.customer_segments


@query
def segment_asof(d):
    return longs(
        _segments(d).select(
            "entity_id", "as_of", "state", "n_probes", "seg.seg_idx", "seg.snapshot", "seg.start", "seg.end"
        ),
        "seg_idx",
    )


@query
def shipment_asof(d):
    """Status segment of the ordering customer on every day something was shipped to them."""
    shipped = d.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("as_of"))
    buyers = d.table("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("entity_id"))
    found = timelines.as_of(d.order_timeline(), shipped.join(buyers, "o_orderkey").select("entity_id", "as_of"), d.rows("orders", "lineitem"))
    return longs(
        found.select("entity_id", "as_of", "n_probes", "state", "seg.seg_idx", "seg.snapshot"), "seg_idx"
    )


@query
def existence_asof(d):
    return timelines.existed(d.customer_probes(), d.introductions())


@query
def served_snapshot(d):
    return timelines.served_snapshot(_segments(d), "O").select("entity_id", "as_of", "served")


@query
def clamped_segment(d):
    return longs(timelines.clamped_index(_segments(d)).select("entity_id", "as_of", "served_idx"), "served_idx")


@query
def bracketed_change(d):
    return longs(
        timelines.bracketed_change(_segments(d)).select("entity_id", "as_of", "change_idx", "change_date"), "change_idx"
    )


@query
def existence_facts(d):
    return timelines.existence_facts(d.customer_probes(), d.introductions())


@query
def change_facts(d):
    return timelines.change_facts(_segments(d), timelines.change_dates(d.order_timeline()))


@query
def citation_notes(d):
    return timelines.citation_notes(_segments(d), d.introductions())


@query
def scope_notes(d):
    covered = grounding.covered_entities(d.union, d.table("labels").select(F.col("doc_id").cast("string").alias("entity_id")))
    note = timelines.scope_note(F.col("as_of"), F.to_date(F.lit(bd.TODAY)), F.coalesce("covered", F.lit("no entity")), bd.CURRENT)
    return d.questions().join(covered, "query_id", "left").select("query_id", "as_of", note.alias("note"))


@query
def timeline_markers(d):
    both = timelines.timeline_markers(d.turn_timeline()).unionByName(timelines.existence_markers(d.introductions()))
    return longs(both, "marker_no")


@query
def history_view(d):
    return longs(timelines.history_view(_segments(d), d.introductions()), "change_idx")


@query
def version_compare(d):
    return longs(timelines.compare_versions(d.turn_segments, d.turn_timeline()), "change_idx")


@query
def version_texts(d):
    """Both texts of every compared change."""
    sides = timelines.compare_versions(d.turn_segments, d.turn_timeline()).select("entity_id", "as_of", "change_idx", "old_snapshot", "new_snapshot")
    texts = d.turns().select("entity_id", F.col("idx").cast("string").alias("snapshot"), "text")
    return longs(timelines.with_texts(sides, texts), "change_idx")


@query
def version_comparables(d):
    return timelines.comparables(d.turn_timeline())


def _markers(d) -> DataFrame:
    texts = timelines.timeline_markers(d.turn_timeline()).withColumn("kind", F.lit("text-change"))
    return texts.unionByName(timelines.existence_markers(d.introductions()).withColumn("kind", F.lit("introduced")))


@query
def history_markers(d):
    """Histories with the markers that are shown beside them."""
    views = timelines.with_markers(_turn_history(d), _markers(d))
    shown = F.array_join(F.transform("markers", lambda m: F.concat_ws(": ", m["date"], m["label"], m["note"])), "\n")
    return views.select("entity_id", "as_of", "kind", "change_date", shown.alias("markers"))


@query
def version_compare_latest(d):
    return longs(timelines.compare_latest(d.turn_timeline()).drop("as_of"), "change_idx")


def _turn_history(d) -> DataFrame:
    return timelines.history_view(d.turn_segments, d.introductions())


def _invariant(d) -> DataFrame:
    """Whether the change a history names is the one its comparison shows, and one of its markers."""
    sides = timelines.compare_versions(d.turn_segments, d.turn_timeline())
    held = timelines.consistent_change(_turn_history(d), sides, timelines.timeline_markers(d.turn_timeline()))
    return held.select("entity_id", "as_of", "change_date", F.coalesce("consistent", F.lit(False)).alias("consistent"))


@query
def history_invariant(d):
    return _invariant(d)


def _bracketed_texts(d) -> DataFrame:
    """Texts on both sides of the change that each history describes."""
    sides = timelines.compare_versions(d.turn_segments, d.turn_timeline())
    texts = d.turns().select("entity_id", F.col("idx").cast("string").alias("snapshot"), "text")
    old = texts.select("entity_id", F.col("snapshot").alias("old_snapshot"), F.col("text").alias("old"))
    new = texts.select("entity_id", F.col("snapshot").alias("new_snapshot"), F.col("text").alias("new"))
    return sides.join(old, ["entity_id", "old_snapshot"]).join(new, ["entity_id", "new_snapshot"])


@query
def history_word_diff(d):
    """Each history with the word diff of the change it describes; each change is compared once."""
    told = _bracketed_texts(d).select("entity_id", "as_of", "old_snapshot", "new_snapshot", "old", "new")
    keys = ["entity_id", "old_snapshot", "new_snapshot"]
    diffs = textdiff.diff_pairs(told.drop("as_of").dropDuplicates(keys), keys).select(*keys, _lines("diff").alias("diff"), "truncated")
    return longs(_turn_history(d), "change_idx").join(told.join(diffs, keys).select("entity_id", "as_of", "diff", "truncated"), ["entity_id", "as_of"], "left")


# Changes.


def _classes(d) -> DataFrame:
    return changes.classify(changes.blocks_of_texts(d.customer_snapshots()), d.n_snapshots, min_chars=1)


@query
def presence_grid(d):
    present = changes.presence(changes.blocks_of_texts(d.customer_snapshots()), 1)
    return longs(changes.presence_grid(present, d.n_snapshots), "idx")


@query
def turn_presence(d):
    """Turns of conversations whose normalised text is long enough to count as present."""
    norm = tx.normalised(F.col("text"))
    return longs(
        d.turns().select("entity_id", "idx", F.coalesce(F.length(norm) >= 30, F.lit(False)).alias("present")), "idx"
    )


@query
def change_classes(d):
    classes = _classes(d)
    return longs(classes, "interval", "n_changes").withColumn(
        "changed_intervals", F.array_join(F.transform("changed_intervals", lambda i: i.cast("string")), ",")
    )


@query
def incremental_classes(d):
    """Customers classified from a state that takes in one snapshot after the other."""
    state = None
    for idx in range(d.n_snapshots):
        state = stored(changes.add_snapshot(state, d.customer_snapshots().where(F.col("idx") == idx), idx, min_chars=1), "change-state")
    classes = changes.classify_state(state, d.n_snapshots)
    return longs(classes, "interval", "n_changes").withColumn(
        "changed_intervals", F.array_join(F.transform("changed_intervals", lambda i: i.cast("string")), ",")
    )


@query
def turn_classes(d):
    """Conversations as entities whose snapshots are their turns."""
    n = d.turns().agg(F.max("idx") + 1).first()[0]
    classes = changes.classify(changes.blocks_of_texts(d.turns()), n)
    return longs(classes.select("entity_id", "presence", "class", "n_changes"), "n_changes")


@query
def change_intervals(d):
    """Changed intervals of documents between editions, compared in blocks of pieces of any length."""
    pieces = chunking.fresh_pieces(d.chunks).select(
        "entity_id",
        (F.col("snapshot") == bd.CURRENT).cast("int").alias("idx"),
        F.col("chunk_index").alias("place"),
        "piece",
    )
    classes = changes.classify(changes.blocks_of_pieces(pieces), 2)
    return longs(classes.select("entity_id", "presence", "class", "n_changes"), "n_changes")


@query
def class_counts(d):
    return changes.class_counts(_classes(d))


@query
def interval_labels(d):
    return longs(changes.interval_labels(d.snapshot_registry()), "interval")


@query
def change_report(d):
    titles = d.customer_snapshots().select("entity_id", "idx", F.concat(F.lit("status "), "text").alias("title"))
    return longs(changes.report_rows(_classes(d), titles), "interval", "n_changes")


@query
def change_candidates(d):
    """Customers with one change, by how unlike the two statuses are."""
    now = d.customer_snapshots().select("entity_id", "idx", F.col("text").alias("new"))
    before = d.customer_snapshots().select("entity_id", (F.col("idx") + 1).alias("idx"), F.col("text").alias("old"))
    near = textdiff.edit_similarity(now.join(before, ["entity_id", "idx"]), ["entity_id", "idx"])
    top = changes.candidates(_classes(d), near.select("entity_id", F.col("edit_similarity").alias("similarity")))
    return top.withColumn(
        "changed_intervals", F.array_join(F.transform("changed_intervals", lambda i: i.cast("string")), ",")
    )


def _customer_details(d, classes: DataFrame) -> DataFrame:
    now = d.customer_snapshots().select("entity_id", F.col("idx").alias("interval"), F.col("text").alias("new"))
    before = d.customer_snapshots().select("entity_id", (F.col("idx") + 1).alias("interval"), F.col("text").alias("old"))
    near = textdiff.edit_similarity(now.join(before, ["entity_id", "interval"]), ["entity_id", "interval"])
    labels = changes.interval_labels(d.snapshot_registry())
    similar = near.select("entity_id", "interval", F.col("edit_similarity").alias("similarity"))
    return changes.details(changes.blocks_of_texts(d.customer_snapshots()), classes, similar, labels, d.n_snapshots)


def _shown_details() -> list[Column]:
    one = lambda c: F.concat_ws(" ", c["label"], F.format_number(c["similarity"], 4), c["small_edit"].cast("string"))
    return [
        F.array_join(F.transform("chars", lambda n: n.cast("string")), ",").alias("chars"),
        F.coalesce(F.array_join(F.transform("changes", one), "; "), F.lit("")).alias("changes"),
    ]


@query
def change_details(d):
    """Lengths, labelled changes, their similarity and the mark of small edits, for conversations whose snapshots are their turns."""
    n = d.turns().agg(F.max("idx") + 1).first()[0]
    blocks = changes.blocks_of_texts(d.turns())
    pairs = d.turn_pairs().withColumnRenamed("idx", "interval")
    near = textdiff.edit_similarity(pairs, ["entity_id", "interval"]).select("entity_id", "interval", F.col("edit_similarity").alias("similarity"))
    labels = changes.interval_labels(d.turns().select("idx", F.concat(F.lit("turn "), F.col("idx").cast("string")).alias("snapshot")).distinct())
    return changes.details(blocks, changes.classify(blocks, n), near, labels, n).select("entity_id", "class", *_shown_details())


@query
def mapped_selfcheck(d):
    """Detected class of every user number and every part number taken as hand-mapped."""
    users = d.introductions().select(F.col("number").alias("entity_id"), F.lit("existence").alias("mapped_as"))
    users = users.unionByName(d.introductions().select("entity_id", F.lit("text-change").alias("mapped_as")))
    return changes.self_check(users, _classes(d))


def _lines(segments: str) -> Column:
    return F.array_join(F.transform(segments, lambda s: F.concat_ws(" ", s["op"], s["text"])), "\n")


def _turn_diffs(d) -> DataFrame:
    keys = ["entity_id", "idx"]
    return longs(textdiff.arranged(d.turn_pairs().select(*keys), d.turn_alignment, keys), "idx")


@query
def word_diff(d):
    return _turn_diffs(d).select("entity_id", "idx", _lines("diff").alias("diff"), "truncated")


@query
def side_by_side(d):
    return _turn_diffs(d).select("entity_id", "idx", _lines("old_side").alias("old_side"), _lines("new_side").alias("new_side"))


@query
def side_texts(d):
    """Both sides of a diff, put together again: they must be the two texts."""
    joined = lambda side: F.md5(F.array_join(F.transform(side, lambda s: s["text"]), " "))
    return _turn_diffs(d).select("entity_id", "idx", joined("old_side").alias("old_text"), joined("new_side").alias("new_text"))


@query
def text_similarity(d):
    return longs(textdiff.similar_pairs(d.turn_pairs(), ["entity_id", "idx"]), "idx")


@query
def edit_similarity(d):
    return longs(textdiff.edit_similarity(d.turn_pairs(), ["entity_id", "idx"]), "idx")


@query
def word_changes(d):
    return longs(textdiff.word_changes(d.turn_pairs(), ["entity_id", "idx"]), "idx", "added_words", "removed_words")


# Evaluation.


@query
def gold_passages(d):
    return d.gold_rows


def _cases(d) -> DataFrame:
    """Questions with gold expect an answer, the others a refusal."""
    gold = d.gold_rows.select("query_id").distinct().withColumn("has_gold", F.lit(True))
    asked = d.questions().join(gold, "query_id", "left")
    is_answer = F.col("has_gold").isNotNull()
    return asked.select(
        "query_id",
        F.when(is_answer, "answer").otherwise("refuse").alias("expected"),
        F.when(is_answer, F.split("text", r"\s+")[1]).alias("expect_contains"),
        F.when(is_answer & (F.col("as_of") > F.lit("2021-01-01")), F.when(F.col("as_of") < F.lit("2023-01-01"), bd.OLD).otherwise(bd.CURRENT)).alias("expect_snapshot"),
        F.when(is_answer & F.col("is_broad"), "text-change").alias("expect_history"),
    )


def _results(d) -> DataFrame:
    refused = vectors.refused(
        d.asked.where("sub_no = 0").select("query_id", "sub_no"), d.lists.vector.where("rank <= 10"), bd.DISTANCE_FLOOR
    )
    first = d.union.where("rank = 1").select("query_id", "entity_id", "chunk_index")
    now = d.chunks.where(F.col("snapshot") == bd.CURRENT).select("entity_id", "chunk_index", "text")
    answer = expansion.only_keys_of(now, first, ["entity_id", "chunk_index"]).join(first, ["entity_id", "chunk_index"])
    return refused.join(answer.select("query_id", F.col("text").alias("answer")), "query_id", "left").select(
        "query_id", "refused", "answer"
    )


def _retrieved(d) -> DataFrame:
    return d.union.join(d.served, ["query_id", "entity_id"]).select(
        "query_id", "rank", "entity_id", F.col("snapshot").alias("served")
    )


def _history(d) -> DataFrame:
    rows = grounding.history_rows(_citations(d), _document_history(d), d.questions())
    line = d.document_timeline()
    held = timelines.consistent_change(rows, timelines.compare_versions(d.resolved, line), timelines.timeline_markers(line))
    return held.select("query_id", "entity_id", "kind", "consistent")


def _graded(d) -> DataFrame:
    """The graded cases, stored once for all queries on them."""
    if "graded" not in d.__dict__:
        d.graded = stored(evaluation.graded_cases(_cases(d), d.gold_rows, _results(d), _retrieved(d), _citations(d), _history(d)), "graded")
    return d.graded


@query
def graded_cases(d):
    return longs(_graded(d), "rank")


@query
def recall_at_k(d):
    return evaluation.recall_at(_graded(d))


@query
def eval_summary(d):
    return evaluation.summary(_graded(d))


@query
def decision_lists(d):
    return evaluation.decision_lists(_graded(d))


def _surfaced(d) -> DataFrame:
    """Entities per question under five variants of retrieval."""
    one = lambda df, name: df.select(F.lit(name).alias("variant"), "query_id", "entity_id").distinct()
    vec, lex = d.lists.vector.where("sub_no = 0"), d.lists.lexical.where("sub_no = 0")
    return (
        one(vec.where("rank <= 6"), "vector")
        .unionByName(one(lex.where("rank <= 6"), "lexical"))
        .unionByName(one(d.hits.where("sub_no = 0"), "served"))
        .unionByName(one(d.union, "planned"))
        .unionByName(one(vec.select("query_id", "entity_id").union(lex.select("query_id", "entity_id")), "ceiling"))
    )


def _borderline(d) -> DataFrame:
    """Entities of a question's union that are labelled toxic; its gold documents are core."""
    return d.union.join(expansion.only_keys_of(d.demoted(), d.union, ["entity_id"]), "entity_id").select("query_id", "entity_id").distinct()


def _core(d) -> DataFrame:
    return evaluation.core_recall(d.gold_rows, _borderline(d), _surfaced(d), ["variant"])


@query
def core_recall_noise(d):
    """Counts per variant and question, and the list of what is missing."""
    missing = evaluation.missing_core(d.gold_rows, _surfaced(d), ["variant"])
    listed = missing.groupBy("variant", "query_id").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("missing"))
    rows = _core(d).join(listed, ["variant", "query_id"], "left").withColumn("missing", F.coalesce("missing", F.lit("")))
    return longs(rows, "n_core", "n_found", "n_noise")


@query
def variant_totals(d):
    return evaluation.core_totals(_core(d), ["variant"])


@query
def variant_compare(d):
    wide = evaluation.side_by_side(_core(d), ["served", "planned"])
    return longs(wide, "served_found", "served_noise", "planned_found", "planned_noise")


@query
def cited_passes(d):
    """Repeated passes: the citations of obligations 1, 1-2 and so on, scored like variants."""
    cited = _citations(d).select("query_id", "entity_id", F.floor((F.col("pages").cast("int") - 1) / 3).cast("int").alias("ob"))
    first = cited.groupBy("query_id", "entity_id").agg(F.min("ob").alias("ob"))
    last = first.agg(F.max("ob")).first()[0] or 0
    passes = first.select("query_id", "entity_id", F.explode(F.sequence(F.col("ob"), F.lit(last))).alias("p"))
    surfaced = passes.select((F.col("p") + 1).alias("pass"), "query_id", "entity_id")
    totals = evaluation.core_totals(evaluation.core_recall(d.gold_rows, _borderline(d), surfaced, ["pass"]), ["pass"])
    # Each pass refuses a little more readily than the one before.
    asked = d.asked.where("sub_no = 0").select("query_id", "sub_no")
    best = vectors.refused(asked, d.lists.vector.where("rank <= 10")).withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(last + 1))))
    results = best.withColumn("refused", F.coalesce("best_distance", F.lit(float("inf"))) > bd.DISTANCE_FLOOR - 0.02 * (F.col("pass") - 1))
    return longs(totals.join(evaluation.refusals(results, ["pass"]), "pass"), "pass")


@query
def entity_count(d):
    return evaluation.entity_count(d.chunks, bd.CURRENT)


def registered() -> dict[str, Query]:
    return dict(QUERIES)
