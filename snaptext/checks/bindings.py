"""How the given tables are read as corpora, timelines and snapshots.

Stored tables are built once per Spark application and folder, like a search index;
a new application sees new data.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snaptext.functions import html, text as tx
from snaptext.operators import chunking, fusion, neighbours, textdiff, timelines
from snaptext.plans import ingest, retrieval
from snaptext.scale import dealt, is_small, only_keys_of, shared_folder, small_side, spread, stored
from snaptext.sources import pages, published, tables

# Fixed values shared with the check SQL.
OLD, CURRENT = "2021-01-01", "2023-01-01"
TODAY = "2023-01-01"
RULES = [("prefix", "Licensed under"), ("contains", "example."), ("equals", "Of."), ("equals", "And ornd.")]
ALIASES = {"in the": ["thble", "onre"], "is the": ["erat"], "of the": ["tion", "tion", "edst"], "que la": ["eau"]}
HINTS = [
    (["anth", "whst"], ["The anea thble", "Ereaon"]),
    (["tionha", "the of"], ["the anea thble", "Thand erre"]),
]
BODY_START = {"en": 10, "fr": 5, "de": 1, "es": 12}
PAGE_KEYWORD = "Condition"
PAGE_SNAPSHOT = r"^https?://[^/]+/([a-z]{2})/"
DISTANCE_FLOOR = 0.45
PROBE_DAYS = ["1994-06-30", "1995-03-15", "1996-12-31", "1998-07-01", "2000-02-29", "2001-12-31", "2024-01-01"]
TURN_DAYS = ["2023-12-31", "2024-01-01", "2024-02-15", "2024-04-01", "2025-01-01"]
YEARS_PER_SNAPSHOT = 2
#: Characters by which passages of one or two words are looked for.
SHORT_KEY = 8


class Data:
    """The tables of one folder under one Spark application."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, *names: str) -> int:
        """Rows of the tables, which Parquet files know."""
        return sum(self.table(name).count() for name in names)

    def texts(self, name: str, key: str) -> DataFrame:
        return spread(self.table(name), key)

    # Documents as a corpus with two editions.

    def editions(self) -> DataFrame:
        """Each document twice: as it is, and an older edition without its last line.

        The first line is the title; a document of one line is new in the current edition
        and takes its source as title.
        """
        lines = F.split("text", "\n")
        n = F.size("ls")
        base = self.texts("documents", "doc_id").select(
            F.col("doc_id").cast("string").alias("entity_id"), F.col("source").alias("section"), "text", lines.alias("ls")
        )
        joined = lambda count: F.array_join(F.slice("ls", F.lit(2), F.greatest(count, F.lit(0))), "\n")
        bodies = F.array(
            F.struct(F.lit(OLD).alias("snapshot"), F.when(n > 1, joined(n - 2)).alias("body")),
            F.struct(
                F.lit(CURRENT).alias("snapshot"), F.when(n > 1, joined(n - 1)).otherwise(F.col("text")).alias("body")
            ),
        )
        title = F.when(n > 1, tx.strip(F.col("ls")[0])).otherwise(F.col("section"))
        rows = base.select(
            "entity_id",
            "section",
            title.alias("title"),
            F.lit(1).alias("page_start"),
            n.alias("page_end"),
            F.explode(bodies).alias("e"),
        )
        return rows.where("e.body IS NOT NULL").select(
            "e.snapshot", "entity_id", "title", "section", "page_start", "page_end", "e.body"
        )

    def chunk_rows(self) -> DataFrame:
        named = self.editions().withColumn(
            "body", chunking.stub_body(F.col("body"), F.col("entity_id"), F.col("title"))
        )
        return chunking.chunk_bodies(named).withColumn(
            "chunk_id", chunking.chunk_id(F.col("snapshot"), F.col("entity_id"), F.col("chunk_index"))
        )

    @cached_property
    def chunks(self) -> DataFrame:
        return stored(self.chunk_rows(), "chunks")

    def edition_registry(self) -> DataFrame:
        """The two editions with what is known of their sources."""
        rows = [(OLD, "first edition", "archive"), (CURRENT, "second edition", "publisher")]
        named = self.spark.createDataFrame(rows, "snapshot string, doc_title string, authority string")
        return named.select(
            "snapshot",
            F.to_date("snapshot").alias("date"),
            F.concat(F.lit("edition-"), "snapshot").alias("source"),
            "doc_title",
            "authority",
            F.concat(F.lit("https://example.org/"), "snapshot").alias("url"),
        )

    @cached_property
    def current(self) -> str:
        return pages.current_snapshot(self.edition_registry())

    @cached_property
    def published(self) -> str:
        """Folder of the published tables."""
        return f"{shared_folder(self.spark)}/published-{uuid.uuid4().hex}"

    @cached_property
    def published_pages(self) -> str:
        """The folder, with pages written once and then rebuilt in part: the same rows, in new folders."""
        pages.publish_pages(self.page_records(), self.published)
        pages.publish_pages(self.page_records().where("snapshot in ('de', 'en')"), self.published)
        return self.published

    @cached_property
    def _published_chunks(self) -> str:
        """The same of chunks."""
        tables.publish_chunks(self.chunks, self.published)
        tables.publish_chunks(self.chunks.where(F.col("snapshot") == OLD), self.published)
        return self.published

    def published_chunks(self) -> DataFrame:
        return published.read(self.spark, self._published_chunks, "chunks")

    @cached_property
    def search_tables(self) -> retrieval.SearchTables:
        return retrieval.build_search(self.chunks, self.current)

    # Benchmark items as questions.

    def questions(self) -> DataFrame:
        item = F.col("item_id")
        return self.table("benchmark").select(
            item.cast("string").alias("query_id"),
            "text",
            F.make_date((F.lit(2020) + item % 4).cast("int"), F.lit(6), F.lit(1)).alias("as_of"),
            (F.size(F.split("text", r"\.\s+")) >= 3).alias("is_broad"),
        )

    def planned(self) -> DataFrame:
        """Sentences of an item as its planned sub-queries."""
        return self.questions().select(
            "query_id", F.posexplode(F.split("text", r"\.\s+")).alias("plan_no", "text")
        )

    def subqueries(self) -> DataFrame:
        asked = self.questions()
        return fusion.assemble_subqueries(asked, fusion.hint_subqueries(asked, *fusion.hint_tables(self.spark, HINTS)), self.planned())

    @cached_property
    def asked(self) -> DataFrame:
        return stored(self.subqueries(), "subqueries")

    @cached_property
    def lists(self) -> retrieval.RankedLists:
        return retrieval.search(self.search_tables, self.asked, ALIASES)

    def demoted(self) -> DataFrame:
        return self.table("labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("entity_id"))

    @cached_property
    def _fused(self) -> tuple[DataFrame, DataFrame]:
        return retrieval.hybrid_union(self.lists, self.demoted())

    @property
    def hits(self) -> DataFrame:
        return self._fused[0]

    @property
    def union(self) -> DataFrame:
        return self._fused[1]

    def gold(self) -> DataFrame:
        """Documents that contain a benchmark passage, found through a word of the passage.

        A document that contains a passage of three and more words contains the inner ones as
        words of its own, so an equality join on the longest finds every candidate; a passage that
        may begin or end inside a word is found by a part of a word of its length. Ids are joined
        first, and only candidates fetch their text.
        """
        items = self.table("benchmark").select(
            F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("passage")
        )
        parts = F.split("passage", "[ \n]+")
        inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
        longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
        keyed = stored(items.withColumn("word", longest), "passages")
        docs = self.texts("documents", "doc_id").select(F.col("doc_id").cast("string").alias("entity_id"), "text")
        asked = keyed.where("word is not null").select("query_id", "word")
        found = _distinct_words(docs, asked.select("word")).join(small_side(asked), "word").select("query_id", "entity_id")
        # One or two words: found by their first characters, at most ``SHORT_KEY`` of them.
        short = keyed.where("word is null").select("query_id", F.substring("passage", 1, SHORT_KEY).alias("part"))
        lengths = sorted(r[0] for r in short.select(F.length("part")).distinct().collect())
        none = F.array().cast("array<string>")

        def substrings(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.length("text") - n + 1)
            return F.when(F.length("text") >= n, F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(n)))).otherwise(none)

        if lengths:
            cut = docs.select("entity_id", F.explode(F.array_distinct(F.concat(*map(substrings, lengths)))).alias("part"))
            found = found.unionByName(cut.join(small_side(short), "part").select("query_id", "entity_id"))
        found = stored(found, "candidates")
        checked = found.join(only_keys_of(docs, found, ["entity_id"]), "entity_id").join(small_side(keyed.select("query_id", "passage")), "query_id")
        return checked.where(F.contains("text", F.col("passage"))).select("query_id", "entity_id")

    @cached_property
    def gold_rows(self) -> DataFrame:
        return stored(self.gold(), "gold")

    # Histories of labelled documents.

    @cached_property
    def _document_timeline(self) -> DataFrame:
        labels = self.table("labels").select(F.col("doc_id").cast("string").alias("entity_id"), "quality")
        one = self.editions().select("entity_id", "title", "snapshot").join(labels, "entity_id")
        changes = one.select(
            "entity_id",
            F.to_date("snapshot").alias("start"),
            F.lit(0).alias("seq"),
            "snapshot",
            F.concat(F.lit("edition of "), "snapshot").alias("note"),
        )
        about = one.groupBy("entity_id").agg(
            F.max("title").alias("title"),
            F.when(F.max("quality") == 1, F.to_date(F.min("snapshot"))).alias("introduced"),
        )
        return stored(timelines.build_timeline(changes, about), "document-timeline")

    def document_timeline(self) -> DataFrame:
        return self._document_timeline

    def document_existence(self) -> DataFrame:
        """Documents known to be introduced: those labelled good, with their first edition."""
        line = self.document_timeline().where("seg_idx = 0 and introduced is not null")
        return line.select("entity_id", "title", "introduced")

    @cached_property
    def resolved(self) -> DataFrame:
        """Segments in force for the entities of each question's union at its date."""
        probes = self.union.join(self.questions().select("query_id", "as_of"), "query_id").select("entity_id", "as_of")
        few = probes.select("entity_id").distinct()
        line = self.document_timeline()
        return stored(timelines.as_of(only_keys_of(line, few, ["entity_id"]), probes), "resolved")

    @cached_property
    def served(self) -> DataFrame:
        by_day = timelines.served_snapshot(self.resolved, CURRENT).select(
            "entity_id", "as_of", F.col("served").alias("snapshot")
        )
        pairs = self.union.join(self.questions().select("query_id", "as_of"), "query_id").select(
            "query_id", "entity_id", "as_of"
        ).distinct()
        return stored(pairs.join(by_day, ["entity_id", "as_of"]).select("query_id", "entity_id", "snapshot"), "served")

    @cached_property
    def reading(self) -> tuple[DataFrame, DataFrame]:
        return retrieval.reading(self.search_tables, self.union, self.served)

    # Orders as timelines and snapshots of customers.

    def order_changes(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").cast("string").alias("entity_id"),
            F.to_date("o_orderdate").alias("start"),
            F.col("o_orderkey").alias("seq"),
            F.col("o_orderstatus").alias("snapshot"),
            F.col("o_orderpriority").alias("note"),
        )

    def introductions(self) -> DataFrame:
        """First sign-up per user, as the date an entity came into being."""
        number = F.col("user_id").cast("string")
        return (
            self.table("events")
            .where("event_type = 'signup'")
            .groupBy(number.alias("number"))
            .agg(F.to_date(F.min("ts")).alias("introduced"))
            .select(
                "number",
                F.concat(F.lit("u"), "number").alias("entity_id"),
                F.concat(F.lit("user "), "number").alias("title"),
                "introduced",
            )
        )

    def order_timeline(self) -> DataFrame:
        """Customers whose number is a user's count as introduced with the first order year."""
        about = self.introductions().select(
            F.col("number").alias("entity_id"), "title", F.to_date(F.lit("1995-01-01")).alias("introduced")
        )
        return timelines.build_timeline(self.order_changes(), about, self.rows("orders"))

    def customer_probes(self) -> DataFrame:
        """Every customer and every user at fixed dates; dealt out before there is a row for each date."""
        days = F.explode(F.array(*[F.to_date(F.lit(d)) for d in PROBE_DAYS])).alias("as_of")
        customers = self.table("customer").select(F.col("c_custkey").cast("string").alias("entity_id"))
        spread_out = dealt(customers, self.rows("customer") * len(PROBE_DAYS), "entity_id").select("entity_id", days)
        return spread_out.unionByName(self.introductions().select("entity_id", days))

    @cached_property
    def customer_segments(self) -> DataFrame:
        # No more users than events.
        rows = self.rows("orders") + (self.rows("customer") + self.rows("events")) * len(PROBE_DAYS)
        return stored(timelines.as_of(self.order_timeline(), self.customer_probes(), rows), "customers")

    @cached_property
    def order_years(self) -> tuple[int, int]:
        """First and last year with an order."""
        row = self.table("orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
        return (row[0], row[1]) if row[0] is not None else (0, 0)

    @property
    def n_snapshots(self) -> int:
        first, last = self.order_years
        return (last - first) // YEARS_PER_SNAPSHOT + 1

    def customer_snapshots(self) -> DataFrame:
        """One short text per customer and two-year bucket from the first order year on: its highest order status."""
        idx = F.floor((F.year("o_orderdate") - self.order_years[0]) / YEARS_PER_SNAPSHOT).cast("int")
        return (
            self.table("orders")
            .groupBy(F.col("o_custkey").cast("string").alias("entity_id"), idx.alias("idx"))
            .agg(F.max("o_orderstatus").alias("text"))
        )

    def snapshot_registry(self) -> DataFrame:
        """The buckets that occur, with their first day."""
        return (
            self.customer_snapshots()
            .groupBy("idx")
            .agg(F.count("*").alias("n_entities"))
            .withColumn(
                "date", F.make_date((F.lit(self.order_years[0]) + YEARS_PER_SNAPSHOT * F.col("idx")).cast("int"), F.lit(1), F.lit(1))
            )
            .withColumn("snapshot", F.col("date").cast("string"))
        )

    # Conversations as texts that change with every turn.

    def turns(self) -> DataFrame:
        return self.texts("conversations", "conv_id").select(
            F.col("conv_id").cast("string").alias("entity_id"), F.col("turn").cast("int").alias("idx"), "text", "role"
        )

    def turn_pairs(self) -> DataFrame:
        """Each turn with the one before it."""
        now = self.turns().select("entity_id", "idx", F.col("text").alias("new"))
        before = self.turns().select("entity_id", (F.col("idx") + 1).alias("idx"), F.col("text").alias("old"))
        return now.join(before, ["entity_id", "idx"])

    @cached_property
    def turn_alignment(self) -> DataFrame:
        """The words of each turn and the one before it, with their partners."""
        keys = ["entity_id", "idx"]
        return stored(textdiff.aligned(textdiff.pair_words(self.turn_pairs(), keys), keys), "turn-words")

    def turn_timeline(self) -> DataFrame:
        changes = self.turns().select(
            "entity_id",
            F.add_months(F.lit("2024-01-01").cast("date"), F.col("idx")).alias("start"),
            F.lit(0).alias("seq"),
            F.col("idx").cast("string").alias("snapshot"),
            F.col("role").alias("note"),
        )
        labels = self.table("labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("entity_id"))
        about = labels.select(
            "entity_id",
            F.concat(F.lit("conversation "), F.col("entity_id")).alias("title"),
            F.to_date(F.lit("2024-01-01")).alias("introduced"),
        )
        return timelines.build_timeline(changes, about)

    @cached_property
    def turn_segments(self) -> DataFrame:
        days = F.explode(F.array(*[F.to_date(F.lit(d)) for d in TURN_DAYS])).alias("as_of")
        probes = self.turns().select("entity_id").distinct().select("entity_id", days)
        return stored(timelines.as_of(self.turn_timeline(), probes), "turns")

    # Web pages as page records.

    def page_records(self) -> DataFrame:
        """Language as snapshot; the top-level domain opens an outer section, ``<h1>`` a section."""
        url, markup = F.col("url"), F.col("html")
        outer = F.concat(
            F.lit("SECTION "), F.upper(F.substring(F.regexp_extract(url, r"^https?://[^/]*\.([a-z])[a-z]*/", 1), 1, 1)), F.lit(": web")
        )
        number = F.regexp_extract(url, r"/[a-z]{2}/(\d+)", 1)
        marked = F.regexp_replace(
            markup, html.TITLE, F.concat(F.lit(f"\n{PAGE_KEYWORD} "), number, F.lit(". $1\n"))
        )
        return self.texts("pages", "page_id").select(
            F.regexp_extract(url, PAGE_SNAPSHOT, 1).alias("snapshot"),
            F.col("page_id").cast("int").alias("page"),
            F.concat(outer, F.lit("\n"), html.plain(marked)).alias("text"),
        )

    def page_registry(self) -> DataFrame:
        starts = F.create_map(*[F.lit(x) for pair in BODY_START.items() for x in pair])
        labels = self.table("pages").select(F.regexp_extract("url", PAGE_SNAPSHOT, 1).alias("snapshot"))
        return labels.distinct().withColumn(
            "body_start", F.coalesce(F.try_element_at(starts, F.col("snapshot")), F.lit(1))
        )

    @cached_property
    def parsed_pages(self) -> ingest.Parsed:
        return ingest.parse_pages(self.page_records(), self.page_registry(), RULES)

    # Vectors.

    def vector_queries(self) -> DataFrame:
        """The vector with a benchmark item's number is its query vector."""
        items = self.table("benchmark").select(F.col("item_id").alias("vec_id"))
        return only_keys_of(self.table("embeddings"), items, ["vec_id"]).select(
            F.col("vec_id").cast("string").alias("query_id"), F.lit(0).alias("sub_no"), F.col("embedding").alias("vector")
        )

    def vector_rows(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.col("embedding").alias("vector"))

    @cached_property
    def exact_vectors(self) -> neighbours.VectorIndex:
        return neighbours.build(self.vector_rows(), ["vec_id"], "squared_l2", lists_per_root=0.25)

    @cached_property
    def unit_vectors(self) -> neighbours.VectorIndex:
        return neighbours.build(self.vector_rows(), ["vec_id"])


def _distinct_words(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The distinct words of each document (``entity_id, text``); if few words are ``asked`` for, only those of them, found in Python."""
    if not is_small(asked):
        return docs.select("entity_id", F.explode(F.array_distinct(F.split("text", "[ \n]+"))).alias("word"))
    wanted = docs.sparkSession.sparkContext.broadcast({r[0] for r in asked.distinct().collect()})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [sorted(wanted.value.intersection(t.replace("\n", " ").split(" "))) if t is not None else [] for t in batch.column("text").to_pylist()]
            of = np.repeat(np.arange(len(said)), [len(x) for x in said])
            words = pa.array([w for x in said for w in x], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("entity_id").take(pa.array(of, pa.int64())), words], names=["entity_id", "word"])

    return docs.mapInArrow(find, "entity_id string, word string")


_open: dict[tuple[str, str], Data] = {}


def data(spark: SparkSession, folder: str) -> Data:
    key = (spark.sparkContext.applicationId, str(folder))
    if key not in _open:
        _open[key] = Data(spark, str(folder))
    return _open[key]
