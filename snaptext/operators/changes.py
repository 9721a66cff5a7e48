"""How entities come, go and change over the ordered snapshots of a corpus.

Texts come as blocks: ``entity_id, idx`` (0-based snapshot number), ``block, norm``.
Comparing blocks instead of whole texts keeps every row and group small, and is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from snaptext import settings
from snaptext.functions import text as tx
from snaptext.scale import carry_forward

# Class names, in report order.
CLASSES = ("STABLE", "INTRODUCED", "REMOVED", "SINGLE-CHANGE", "MULTI-CHANGE", "ANOMALY", "TRANSIENT", "EMPTY")


def blocks_of_texts(texts: DataFrame, size: int = settings.COMPARE_BLOCK_CHARS) -> DataFrame:
    """Normalised texts (``entity_id, idx, text``, one row each) cut into blocks; no shuffle."""
    norm = texts.select("entity_id", "idx", tx.normalised(F.coalesce("text", F.lit(""))).alias("_norm"))
    last = F.greatest(F.ceil(F.length("_norm") / size).cast("int") - 1, F.lit(0))
    return norm.select("entity_id", "idx", "_norm", F.explode(F.sequence(F.lit(0), last)).alias("block")).select(
        "entity_id",
        "idx",
        F.col("block").cast("long").alias("block"),
        F.substring(F.col("_norm"), F.col("block") * size + 1, F.lit(size)).alias("norm"),
    )


def blocks_of_pieces(pieces: DataFrame, size: int = settings.COMPARE_BLOCK_CHARS) -> DataFrame:
    """The same blocks from ordered pieces (``entity_id, idx, place, piece``) of texts of any length.

    A text without a letter or digit has one empty block.
    """
    keys = ["entity_id", "idx"]
    filled = pieces.where(F.lower("piece").rlike("[a-z0-9]"))
    norm = filled.select(*keys, "place", tx.normalised(F.col("piece")).alias("_norm"))
    placed = carry_forward(norm, keys, "place", totals={"_at": F.length("_norm")})
    end = F.col("_at") + F.length("_norm")
    cut = placed.select(
        "*", F.explode(F.sequence(F.floor(F.col("_at") / size), F.floor((end - 1) / size))).alias("block")
    )
    start = F.greatest(F.lit(0), F.col("block") * size - F.col("_at"))
    stop = F.least(F.length("_norm"), (F.col("block") + 1) * size - F.col("_at"))
    parts = cut.select(
        *keys,
        "block",
        "place",
        F.substring(F.col("_norm"), (start + 1).cast("int"), (stop - start).cast("int")).alias("part"),
    )
    first = pieces.groupBy(*keys).agg(F.min("place").alias("place")).select(
        *keys, F.lit(0).cast("long").alias("block"), "place", F.lit("").alias("part")
    )
    parts = parts.unionByName(first)
    ordered = F.array_sort(F.collect_list(F.struct("place", "part")))
    return parts.groupBy(*keys, "block").agg(
        F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias("norm")
    )


def presence(blocks: DataFrame, min_chars: int = settings.MIN_PRESENT_CHARS) -> DataFrame:
    """``entity_id, idx, present`` for every snapshot with a text, present if the normalised text is long enough."""
    lengths = blocks.groupBy("entity_id", "idx").agg(F.sum(F.length("norm")).alias("n"))
    return lengths.select("entity_id", "idx", (F.col("n") >= min_chars).alias("present"))


def differing_intervals(blocks: DataFrame, n_snapshots: int) -> DataFrame:
    """``entity_id, interval`` for every text that differs between snapshots interval-1 and interval.

    Exact, never a threshold. Each block is compared with the one before it; where a snapshot
    lacks the block, it counts as empty.
    """
    steps = Window.partitionBy("entity_id", "block").orderBy("idx")
    seen = blocks.where("norm != ''").select(
        "entity_id",
        "idx",
        "norm",
        F.lag("idx").over(steps).alias("_last"),
        F.lag("norm").over(steps).alias("_was"),
        F.lead("idx").over(steps).alias("_next"),
    )
    follows = F.coalesce(F.col("_last") == F.col("idx") - 1, F.lit(False))
    goes_on = F.coalesce(F.col("_next") == F.col("idx") + 1, F.lit(False))
    into = F.when(~follows | (F.col("norm") != F.col("_was")), F.col("idx"))
    out_of = F.when(~goes_on, F.col("idx") + 1)
    changed = seen.select("entity_id", F.explode(F.array(into, out_of)).alias("interval"))
    return changed.where(F.col("interval").between(1, n_snapshots - 1)).distinct()


def presence_grid(present: DataFrame, n_snapshots: int) -> DataFrame:
    """Every entity in every snapshot with a presence flag."""
    every = present.select("entity_id").distinct().select(
        "entity_id", F.explode(F.sequence(F.lit(0), F.lit(n_snapshots - 1))).alias("idx")
    )
    return every.join(present, ["entity_id", "idx"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def classify(
    blocks: DataFrame, n_snapshots: int, min_chars: int = settings.MIN_PRESENT_CHARS
) -> DataFrame:
    """Class of every entity with its presence pattern and changed intervals.

    Interval i lies between snapshots i-1 and i (0-based). ``n_changes`` counts changed
    texts between neighbouring snapshots that both hold the entity, whatever the class.
    Any number of snapshots: work is on one row per entity and snapshot, and only the
    two lists of the result, of at most one entry per snapshot, are gathered.
    """
    flags = presence(blocks, min_chars)
    steps = Window.partitionBy("entity_id").orderBy("idx")
    held_before = F.lag(F.struct("idx", "present")).over(steps)
    kept = (
        flags.withColumn("_before", held_before)
        .where(F.col("present") & F.col("_before.present") & (F.col("_before.idx") == F.col("idx") - 1))
        .select("entity_id", F.col("idx").alias("interval"))
    )
    changed = (
        kept.join(differing_intervals(blocks, n_snapshots), ["entity_id", "interval"], "left_semi")
        .groupBy("entity_id")
        .agg(F.sort_array(F.collect_list("interval")).alias("changed_intervals"))
    )
    held = flags.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.when(F.col("present"), F.col("idx")))).alias("held"))
    none = F.array().cast("array<int>")
    return _classified(held.join(changed, "entity_id", "left").withColumn("changed_intervals", F.coalesce("changed_intervals", none)), n_snapshots)


STATE = "entity_id, idx, digest, present, held, changed_intervals"


def add_snapshot(
    state: DataFrame | None, texts: DataFrame, idx: int, min_chars: int = settings.MIN_PRESENT_CHARS
) -> DataFrame:
    """The state after snapshot ``idx``, whose texts are ``entity_id, text``, from the state after the one before it (none at first).

    A state has one row per entity (``STATE``): the last snapshot with a text of it, that text's SHA-256 and whether it was
    present, the snapshots it was present in and the intervals in which it changed. Texts are hashed where they are read; only
    hashes are shuffled, and older texts are not read at all. Take in snapshots in order, each once.
    """
    norm = tx.normalised(F.coalesce("text", F.lit("")))
    new = texts.select("entity_id", F.sha2(norm, 256).alias("_digest"), (F.length(norm) >= min_chars).alias("_present"))
    none = F.array().cast("array<int>")
    if state is None:
        one = F.when(F.col("_present"), F.array(F.lit(idx))).otherwise(none)
        return new.select("entity_id", F.lit(idx).alias("idx"), F.col("_digest").alias("digest"), F.col("_present").alias("present"), one.alias("held"), none.alias("changed_intervals"))
    both = state.join(new, "entity_id", "full_outer")
    seen, kept = F.col("_digest").isNotNull(), lambda c: F.coalesce(c, none)
    changed = F.col("_present") & F.col("present") & (F.col("idx") == idx - 1) & (F.col("digest") != F.col("_digest"))
    more = lambda c, when: F.when(F.coalesce(when, F.lit(False)), F.concat(kept(c), F.array(F.lit(idx)))).otherwise(kept(c))
    return both.select(
        "entity_id",
        F.when(seen, F.lit(idx)).otherwise(F.col("idx")).alias("idx"),
        F.coalesce("_digest", "digest").alias("digest"),
        F.coalesce("_present", "present").alias("present"),
        more("held", F.col("_present")).alias("held"),
        more("changed_intervals", changed).alias("changed_intervals"),
    )


def classify_state(state: DataFrame, n_snapshots: int) -> DataFrame:
    """What ``classify`` gives, from the state after ``n_snapshots`` snapshots; no shuffle."""
    return _classified(state, n_snapshots)


def _classified(rows: DataFrame, n_snapshots: int) -> DataFrame:
    """Classes from ``entity_id, held, changed_intervals``."""
    work = rows.select(
        "entity_id",
        F.col("held").alias("_held"),
        "changed_intervals",
        F.size("held").alias("_n"),
        F.get("held", F.lit(0)).alias("_first"),
        F.get("held", F.size("held") - 1).alias("_last"),
    )
    gap = lambda x, i: x - F.coalesce(F.get("_held", i - 1), F.lit(-1)) - 1
    pattern = F.concat(
        F.array_join(F.transform("_held", lambda x, i: F.concat(F.repeat(F.lit("0"), gap(x, i)), F.lit("1"))), ""),
        F.repeat(F.lit("0"), F.lit(n_snapshots - 1) - F.coalesce("_last", F.lit(-1))),
    )
    n = F.size("changed_intervals")
    from_start, to_end = F.col("_first") == 0, F.col("_last") == n_snapshots - 1
    klass = (
        F.when(F.col("_n") == 0, "EMPTY")
        .when(F.col("_last") - F.col("_first") + 1 > F.col("_n"), "ANOMALY")
        .when(~from_start & to_end, "INTRODUCED")
        .when(from_start & ~to_end, "REMOVED")
        .when(~from_start, "TRANSIENT")
        .when(n == 0, "STABLE")
        .when(n == 1, "SINGLE-CHANGE")
        .otherwise("MULTI-CHANGE")
    )
    interval = F.when(klass == "INTRODUCED", F.col("_first")).when(klass == "REMOVED", F.col("_last") + 1)
    return work.select(
        "entity_id", pattern.alias("presence"), klass.alias("class"), interval.alias("interval"), "changed_intervals", n.alias("n_changes")
    )


def interval_labels(registry: DataFrame) -> DataFrame:
    """``I1 = a -> b`` for each pair of neighbouring snapshots of the registry (``idx, snapshot``)."""
    following = F.lead("snapshot").over(Window.partitionBy(F.lit(0)).orderBy("idx"))
    return (
        registry.select((F.col("idx") + 1).alias("interval"), F.col("snapshot"), following.alias("_next"))
        .where(F.col("_next").isNotNull())
        .select(
            "interval",
            F.concat(F.lit("I"), F.col("interval").cast("string"), F.lit(" = "), "snapshot", F.lit(" -> "), "_next").alias("label"),
        )
    )


def details(
    blocks: DataFrame, classes: DataFrame, similarities: DataFrame, labels: DataFrame, n_snapshots: int, small: float = settings.SMALL_EDIT_RATIO
) -> DataFrame:
    """The detail arrays of each classified entity: one number per snapshot and one row per changed interval.

    ``chars`` are lengths of the normalised texts, 0 where there is none. ``changes`` are (``interval``, ``label``, ``similarity``,
    ``small_edit``) in order; ``similarities`` has ``entity_id, interval, similarity``, ``labels`` what ``interval_labels`` gives.
    """
    lengths = blocks.groupBy("entity_id", "idx").agg(F.sum(F.length("norm")).alias("n"))
    held = lengths.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "n"))).alias("_held"))
    chars = F.transform(F.sequence(F.lit(0), F.lit(n_snapshots - 1)), lambda i: F.coalesce(F.try_element_at("_held", i), F.lit(0)).cast("long"))
    each = classes.select("entity_id", F.explode("changed_intervals").alias("interval"))
    named = each.join(F.broadcast(labels), "interval").join(similarities, ["entity_id", "interval"], "left")
    change = F.struct("interval", "label", "similarity", (F.col("similarity") >= small).alias("small_edit"))
    listed = named.groupBy("entity_id").agg(F.sort_array(F.collect_list(change)).alias("changes"))
    return classes.select("entity_id", "class").join(held, "entity_id").join(listed, "entity_id", "left").select("entity_id", "class", chars.alias("chars"), "changes")


def class_counts(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class").agg(F.count("*").alias("n_entities"))


def latest_titles(titles: DataFrame) -> DataFrame:
    """Title of each entity in the last snapshot that has it (``entity_id, idx, title``)."""
    return titles.groupBy("entity_id").agg(F.max_by("title", "idx").alias("title"))


def report_rows(classes: DataFrame, titles: DataFrame) -> DataFrame:
    """One row per entity for the report tables, with its latest title and sort keys.

    Introduced and removed entities sort by interval, multi-change ones by title,
    all others by natural id.
    """
    return classes.join(latest_titles(titles), "entity_id", "left").select(
        "class",
        "entity_id",
        F.coalesce("title", F.lit("?")).alias("title"),
        "presence",
        "interval",
        F.array_join(F.transform("changed_intervals", lambda i: F.concat(F.lit("I"), i.cast("string"))), ", ").alias(
            "changed_in"
        ),
        "n_changes",
        tx.natural_number(F.col("entity_id")).alias("id_number"),
    )


def candidates(
    classes: DataFrame, similarities: DataFrame, n: int = settings.REPORT_CANDIDATES
) -> DataFrame:
    """The ``n`` single-change entities with the largest change.

    ``similarities`` has ``entity_id, similarity`` per interval; the smallest counts.
    """
    smallest = similarities.groupBy("entity_id").agg(F.min("similarity").alias("similarity"))
    one = classes.where("class = 'SINGLE-CHANGE'").join(smallest, "entity_id")
    order = [F.asc("similarity"), tx.natural_number(F.col("entity_id")), F.asc("entity_id")]
    return one.orderBy(*order).limit(n).select("entity_id", "changed_intervals", "similarity")


def self_check(mapped: DataFrame, classes: DataFrame) -> DataFrame:
    """Detected class of every hand-mapped entity (``entity_id, mapped_as``); ``?`` if not seen."""
    return mapped.join(classes.select("entity_id", "class"), "entity_id", "left").select(
        "entity_id", "mapped_as", F.coalesce("class", F.lit("?")).alias("detected")
    )
