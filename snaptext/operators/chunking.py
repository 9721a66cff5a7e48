"""Overlapping word windows, and the way back from windows to text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from snaptext import settings
from snaptext.functions import text as tx
from snaptext.scale import small_side, carry_forward

#: Texts that are cut into windows at once.
CUT_ROWS = 256


def chunk_id(snapshot: Column, entity: Column, index: Column) -> Column:
    return F.concat(snapshot, F.lit("__"), entity, F.lit("_"), index.cast("string"))


def stub_body(body: Column, entity: Column, title: Column, keyword: str = settings.HEADING_KEYWORD) -> Column:
    """An empty body becomes ``Condition 12: Title`` so that the entity can still be found."""
    stub = F.concat(F.lit(f"{keyword} "), entity, F.lit(": "), title)
    return F.when(F.coalesce(tx.strip(body), F.lit("")) == "", stub).otherwise(body)


def windows(bodies: list[str | None], size: int, overlap: int) -> Iterator[tuple[int, list[str], int]]:
    """The place, the windows and the number of words of each body that isn't null.

    An edition often goes on where the one before it ends: its first words and whole windows are known then.
    """
    step = size - overlap
    before, said, whole = None, [], []
    for row, body in enumerate(bodies):
        if body is None:
            continue
        if before and body.startswith(before) and (body[len(before) :] + " ")[0] in tx.BLANKS:
            said = said + tx.split_words(body[len(before) :])
        else:
            said, whole = tx.split_words(body), []
        starts = range(0, max(len(said) - overlap, 1), step)
        found = whole + [" ".join(said[i : i + size]) for i in starts[len(whole) :]]
        before, whole = body, found[: max(len(said) - size + step, 0) // step]
        yield row, found, len(said)


def chunk_bodies(
    bodies: DataFrame,
    text: str = "body",
    size: int = settings.WINDOW_WORDS,
    overlap: int = settings.WINDOW_OVERLAP,
) -> DataFrame:
    """Windows of texts that are one row each; no shuffle. A null text has none, one without a word an empty window."""
    step = size - overlap
    types = {f.name: f.dataType.simpleString() for f in bodies.schema if f.name != text} | {"chunk_index": "int", "text": "string", "n_words": "int"}
    rest = list(types)[:-3]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CUT_ROWS):
                batch = whole.slice(at, CUT_ROWS)
                of, index, texts, sizes = [], [], [], []
                for row, mine, n in windows(batch.column(text).to_pylist(), size, overlap):
                    of += [row] * len(mine)
                    index += range(len(mine))
                    texts += mine
                    sizes += [min(size, n - i * step) for i in range(len(mine))]
                kept = batch.select(rest).take(pa.array(of, pa.int64()))
                columns = [*kept.columns, pa.array(index, pa.int32()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=list(types))

    return bodies.select(*rest, text).mapInArrow(cut, ", ".join(f"`{c}` {t}" for c, t in types.items()))


def chunk_lines(
    lines: DataFrame,
    size: int = settings.WINDOW_WORDS,
    overlap: int = settings.WINDOW_OVERLAP,
) -> DataFrame:
    """The same windows straight from placed lines, without assembling any section.

    Each line learns how many words of its entity precede it and hands the matching
    slices to the windows it touches, so every group is one window of ``size`` words
    however long the entity is.
    """
    step = size - overlap
    entity_keys = ["snapshot", "entity_id"]
    page_keys = [*entity_keys, "page"]
    split = lines.select(*page_keys, "line_no", tx.words(F.col("line")).alias("_words")).where(
        F.size("_words") > 0
    )
    per_page = split.groupBy(*page_keys).agg(F.sum(F.size("_words")).alias("_n"))
    offsets = carry_forward(per_page, entity_keys, "page", totals={"_before_page": F.col("_n")})
    in_page = (
        Window.partitionBy(*page_keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = split.join(offsets.drop("_n"), page_keys).withColumn(
        "_at",
        F.col("_before_page") + F.coalesce(F.sum(F.size("_words")).over(in_page), F.lit(0)),
    )
    m = F.size("_words")
    first = F.greatest(F.lit(0), F.floor((F.col("_at") - size) / step) + 1)
    last = F.floor((F.col("_at") + m - 1) / step)
    touched = placed.select("*", F.explode(F.sequence(first, last)).alias("_chunk"))
    start = F.greatest(F.lit(0), F.col("_chunk") * step - F.col("_at"))
    stop = F.least(m, F.col("_chunk") * step + size - F.col("_at"))
    pieces = touched.select(
        *page_keys,
        "line_no",
        F.col("_chunk").cast("int").alias("chunk_index"),
        F.array_join(F.slice("_words", (start + 1).cast("int"), (stop - start).cast("int")), " ").alias("piece"),
        (stop - start).cast("int").alias("n"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("page", "line_no", "piece")))
    windows = pieces.groupBy(*entity_keys, "chunk_index").agg(
        F.array_join(F.transform(ordered, lambda x: x["piece"]), " ").alias("text"),
        F.sum("n").cast("int").alias("n_words"),
    )
    # A window no longer than the overlap lies inside the one before it.
    return windows.where((F.col("chunk_index") == 0) | (F.col("n_words") > overlap))


def chunk_sections(entities: DataFrame, lines: DataFrame, keyword: str = settings.HEADING_KEYWORD) -> DataFrame:
    """Chunk table of parsed pages: windows of every entity, and a stub for each empty one."""
    keys = ["snapshot", "entity_id"]
    about = entities.select(*keys, "title", "section", "page_start", "page_end", "n_words")
    filled = about.drop("n_words").join(chunk_lines(lines), keys)
    empty = chunk_bodies(
        about.where(F.col("n_words") == 0)
        .drop("n_words")
        .withColumn("body", stub_body(F.lit(""), F.col("entity_id"), F.col("title"), keyword))
    )
    both = filled.unionByName(empty)
    return both.withColumn("chunk_id", chunk_id(F.col("snapshot"), F.col("entity_id"), F.col("chunk_index")))


def with_snapshot(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks with the metadata of their snapshot: ``source``, ``doc_title``, ``version_date``, ``authority``, ``url``.

    The registry has one row per snapshot (``snapshot, date`` and these); what it doesn't know is null.
    """
    known = registry.select("snapshot", "source", "doc_title", F.col("date").alias("version_date"), "authority", "url")
    return chunks.join(small_side(known), "snapshot", "left")


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Per snapshot: entities, chunks, words per chunk and characters."""
    return chunks.groupBy("snapshot").agg(
        F.countDistinct("entity_id").alias("n_entities"),
        F.count("*").alias("n_chunks"),
        F.min("n_words").alias("min_words"),
        F.max("n_words").alias("max_words"),
        F.floor(F.sum("n_words") / F.count("*")).cast("long").alias("mean_words"),
        F.sum(F.length("text")).alias("n_chars"),
    )


def entity_sizes(chunks: DataFrame) -> DataFrame:
    """Chunks and characters of each entity in each snapshot."""
    return chunks.groupBy("snapshot", "entity_id").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars")
    )


def fresh_pieces(chunks: DataFrame, overlap: int = settings.WINDOW_OVERLAP) -> DataFrame:
    """Each chunk without the words it repeats; in order they are the whole text. No shuffle.

    Words of a chunk are joined by single spaces, so the repeated ones end at a known space.
    """
    repeated = F.length(F.substring_index("text", " ", overlap))
    own = F.substring(F.col("text"), repeated + 2, F.length("text"))
    return chunks.select(
        "snapshot",
        "entity_id",
        "chunk_index",
        F.when(F.col("chunk_index") == 0, F.col("text")).otherwise(own).alias("piece"),
    )


def rebuilt_texts(chunks: DataFrame, overlap: int = settings.WINDOW_OVERLAP) -> DataFrame:
    """The text of each entity as one row."""
    return fresh_pieces(chunks, overlap).groupBy("snapshot", "entity_id").agg(_joined(F.struct("chunk_index", "piece")).alias("text"))


def _joined(piece: Column) -> Column:
    """The pieces of a group in order, as one text; null ones don't count."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["piece"]), " ")


def rebuilt_beside(chunks: DataFrame, originals: DataFrame, overlap: int = settings.WINDOW_OVERLAP) -> DataFrame:
    """``originals`` (``snapshot, entity_id, original``), each with the rebuilt ``text`` of its entity; those without a chunk are left out.

    Pieces and originals meet in one grouping.
    """
    keys = ["snapshot", "entity_id"]
    pieces = fresh_pieces(chunks, overlap).select(*keys, F.struct("chunk_index", "piece").alias("piece"), F.lit(None).alias("whole"))
    wholes = originals.select(*keys, F.lit(None).alias("piece"), F.struct("original").alias("whole"))
    met = pieces.unionByName(wholes).where("snapshot is not null and entity_id is not null").groupBy(*keys)
    both = met.agg(F.count("piece").alias("n"), _joined(F.col("piece")).alias("text"), F.collect_list("whole").alias("wholes"))
    return both.where("n > 0").select(*keys, "text", F.explode("wholes").alias("whole")).select(*keys, "text", "whole.original")
