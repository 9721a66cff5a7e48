"""Which snapshot's text applied on a date, and what to say about it.

A timeline has one row per entity and start date: ``entity_id, title, introduced,
seg_idx, start, end, snapshot, note, n_segments, first_start, first_end, first_note``.
Intervals are half-open; a null end is open. As dates are calendar days, an entity
has at most one row per day, which bounds every window here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from snaptext.functions.text import long_date, natural_number
from snaptext.scale import dealt

STATES = ("UNMAPPED", "TOO_EARLY", "IN_FORCE", "GAP")


def build_timeline(changes: DataFrame, about: DataFrame | None = None, rows: int = 0) -> DataFrame:
    """Contiguous segments from dated changes (``entity_id, start, seq, snapshot, note``).

    Of several changes on a day the last (by ``seq``) stands. Reducing to days happens
    before the shuffle, so an entity with very many changes stays small. ``about`` adds
    ``title`` and ``introduced`` per entity. ``rows``, the number of changes if it is known,
    tells how many tasks there are at least.
    """
    days = changes.groupBy("entity_id", "start").agg(
        F.max_by(F.struct("snapshot", "note"), "seq").alias("last")
    )
    return segments(dealt(days.select("entity_id", "start", "last.snapshot", "last.note"), rows, "entity_id"), about)


def segments(starts: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """Timeline of distinct start dates; each segment ends where the next begins."""
    per_entity = Window.partitionBy("entity_id")
    by_start = per_entity.orderBy("start")
    whole = by_start.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = starts.select(
        "entity_id",
        (F.row_number().over(by_start) - 1).cast("int").alias("seg_idx"),
        "start",
        F.lead("start").over(by_start).alias("end"),
        "snapshot",
        "note",
        F.count("*").over(per_entity).cast("int").alias("n_segments"),
        F.first("start").over(whole).alias("first_start"),
        F.nth_value("start", 2).over(whole).alias("first_end"),
        F.first("note").over(whole).alias("first_note"),
    )
    if about is None:
        return rows.withColumns({"title": F.col("entity_id"), "introduced": F.lit(None).cast("date")})
    return rows.join(about.select("entity_id", "title", "introduced"), "entity_id", "left").withColumn(
        "title", F.coalesce("title", "entity_id")
    )


def gap_check(timeline: DataFrame) -> DataFrame:
    """Per entity: do the segments follow each other without gap, overlap or empty ones?

    Works on any segment rows (``entity_id, start, end``), also hand-written ones.
    """
    by_start = Window.partitionBy("entity_id").orderBy("start", F.col("end").asc_nulls_last())
    following = F.lead("start").over(by_start)
    checked = timeline.select(
        "entity_id",
        (following.isNotNull() & (F.col("end") < following)).alias("gap"),
        (following.isNotNull() & (F.col("end").isNull() | (F.col("end") > following))).alias("overlap"),
        (F.col("end") <= F.col("start")).alias("empty"),
    )
    count = lambda flag: F.count_if(F.coalesce(F.col(flag), F.lit(False)))
    sums = checked.groupBy("entity_id").agg(
        F.count("*").alias("n_segments"),
        count("gap").alias("n_gaps"),
        count("overlap").alias("n_overlaps"),
        count("empty").alias("n_empty"),
    )
    return sums.withColumn("contiguous", F.col("n_gaps") + F.col("n_overlaps") + F.col("n_empty") == 0)


def as_of(timeline: DataFrame, probes: DataFrame, rows: int = 0) -> DataFrame:
    """The segment in force for each distinct ``entity_id, as_of`` of ``probes``.

    ``seg`` is the segment (null if none) and ``state`` one of ``STATES``; ``n_probes``
    counts equal probes. Segments and probes are merged in date order, so no probe is
    ever paired with more than one segment. ``rows``, how many segments and probes there
    are at most if that is known, tells how many tasks there are at least.
    """
    # Dealt out first, as a task that reads many probes would have to hold them all.
    distinct = dealt(probes, rows, "entity_id").groupBy("entity_id", "as_of").agg(F.count("*").alias("n_probes"))
    payload = F.struct(*[c for c in timeline.columns if c != "entity_id"])
    merged = timeline.select(
        "entity_id", F.col("start").alias("as_of"), F.lit(None).cast("long").alias("n_probes"), payload.alias("seg")
    ).unionByName(distinct, allowMissingColumns=True)
    merged = dealt(merged, rows, "entity_id")
    is_segment = F.col("n_probes").isNull()
    upto = Window.partitionBy("entity_id").orderBy("as_of", F.col("n_probes").isNotNull())
    everything = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    started = F.last("seg", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("seg", ignorenulls=True).over(everything)
    found = merged.select(
        "entity_id", "as_of", "n_probes", is_segment.alias("_is_segment"), started.alias("seg"), first.alias("first")
    ).where("NOT _is_segment")
    ended = F.col("seg.end") <= F.col("as_of")
    state = (
        F.when(F.col("first").isNull(), "UNMAPPED")
        .when(F.col("seg").isNull(), "TOO_EARLY")
        .when(F.coalesce(ended, F.lit(False)), "GAP")
        .otherwise("IN_FORCE")
    )
    held = F.when(state == "IN_FORCE", F.col("seg"))
    return found.select("entity_id", "as_of", "n_probes", state.alias("state"), held.alias("seg"), "first")


def existed(probes: DataFrame, existence: DataFrame) -> DataFrame:
    """Whether each entity existed on the date; null when its introduction is not mapped."""
    return probes.join(existence.select("entity_id", "introduced"), "entity_id", "left").withColumn(
        "existed", F.col("as_of") >= F.col("introduced")
    )


def served_snapshot(resolved: DataFrame, current: str) -> DataFrame:
    """Snapshot whose text is served: the segment's, the current one, or none (null).

    Too early a date serves the current text for an entity known to have been introduced
    later, and nothing for one whose older text is simply not held.
    """
    served = (
        F.when(F.col("state") == "IN_FORCE", F.col("seg.snapshot"))
        .when((F.col("state") == "TOO_EARLY") & F.col("first.introduced").isNull(), F.lit(None).cast("string"))
        .otherwise(F.lit(current))
    )
    return resolved.withColumn("served", served)


def clamped_index(resolved: DataFrame) -> DataFrame:
    """Index of the segment shown in a history: clamped to the first and the last."""
    index = F.when(F.col("state") == "IN_FORCE", F.col("seg.seg_idx")).when(
        F.col("state") == "TOO_EARLY", F.lit(0)
    ).when(F.col("state") == "GAP", F.col("first.n_segments") - 1)
    return resolved.withColumn("served_idx", index.cast("int"))


def bracketed_change(resolved: DataFrame) -> DataFrame:
    """The one change to describe: what produced the served segment, else the first upcoming one."""
    work = clamped_index(resolved)
    idx = F.col("served_idx")
    return work.withColumn(
        "change_idx", F.when(idx >= 1, idx).when((idx == 0) & (F.col("first.n_segments") > 1), F.lit(1))
    ).withColumn(
        "change_date", F.when(idx >= 1, F.col("seg.start")).when(idx == 0, F.col("first.first_end"))
    )


def change_dates(timeline: DataFrame) -> DataFrame:
    """All change dates of an entity as one text; the first segment is not a change."""
    later = F.array_sort(F.collect_list(F.when(F.col("seg_idx") > 0, F.col("start"))))
    return timeline.groupBy("entity_id").agg(F.array_join(F.transform(later, long_date), ", ").alias("change_dates"))


def _named(entity: Column, title: Column) -> Column:
    return F.concat(entity, F.lit(" ("), title, F.lit(")"))


def existence_facts(probes: DataFrame, existence: DataFrame) -> DataFrame:
    """A sentence on the existence of each mapped entity at each date."""
    known = probes.join(existence.select("entity_id", "title", "introduced"), "entity_id")
    state = F.when(F.col("as_of") >= F.col("introduced"), "it was in force with its current text").otherwise(
        "it did not exist yet"
    )
    return known.select(
        "entity_id",
        "as_of",
        F.concat(
            _named(F.col("entity_id"), F.col("title")),
            F.lit(" came in on "),
            long_date(F.col("introduced")),
            F.lit("; on "),
            long_date(F.col("as_of")),
            F.lit(" "),
            state,
            F.lit("."),
        ).alias("fact"),
    )


def change_facts(resolved: DataFrame, dates: DataFrame) -> DataFrame:
    """A sentence on which text applied to each entity with a timeline.

    Three cases: introduced later, older text not held, in force with range and note.
    """
    known = resolved.where(F.col("state").isin("TOO_EARLY", "IN_FORCE")).join(dates, "entity_id")
    first, seg, day = F.col("first"), F.col("seg"), F.col("as_of")
    name = _named(F.col("entity_id"), first["title"])
    introduced_later = F.concat(
        name, F.lit(" came in on "), long_date(first["introduced"]), F.lit("; on "), long_date(day),
        F.lit(" it did not exist yet, so nothing in it applied."),
    )
    not_held = F.concat(
        name, F.lit(" changed on "), F.col("change_dates"), F.lit("; the earliest text held is of "),
        long_date(first["start"]), F.lit(", so its text on "), long_date(day), F.lit(" cannot be confirmed."),
    )
    until = F.coalesce(F.concat(F.lit(" until "), long_date(seg["end"])), F.lit(" to now"))
    in_force = F.concat(
        name, F.lit(" changed on "), F.col("change_dates"), F.lit("; on "), long_date(day),
        F.lit(" the text of snapshot "), seg["snapshot"], F.lit(" applied, from "), long_date(seg["start"]), until,
        F.lit(": "), seg["note"],
    )
    fact = (
        F.when(F.col("state") == "IN_FORCE", in_force)
        .when(first["introduced"].isNotNull(), introduced_later)
        .otherwise(not_held)
    )
    return known.select("entity_id", "as_of", "state", fact.alias("fact"))


def citation_notes(resolved: DataFrame, existence: DataFrame) -> DataFrame:
    """Short note for a citation: snapshot and effective date, or existence, or empty."""
    known = resolved.join(
        existence.select("entity_id", F.col("introduced").alias("exists_from")), "entity_id", "left"
    )
    seg, first, day = F.col("seg"), F.col("first"), F.col("as_of")
    not_yet = F.concat(F.lit("; did not exist on "), long_date(day))
    effective = F.when(
        first["introduced"].isNotNull() | (seg["seg_idx"] > 0),
        F.concat(F.lit("; this wording from "), long_date(seg["start"])),
    ).otherwise("")
    introduced_on = lambda d: F.concat(F.lit("introduced "), long_date(d))
    note = (
        F.when(F.col("state") == "IN_FORCE", F.concat(F.lit("snapshot "), seg["snapshot"], effective))
        .when(
            (F.col("state") == "TOO_EARLY") & first["introduced"].isNotNull(),
            F.concat(introduced_on(first["introduced"]), not_yet),
        )
        .when(F.col("state") != "UNMAPPED", "")
        .when(F.col("exists_from").isNull(), "")
        .when(day >= F.col("exists_from"), introduced_on(F.col("exists_from")))
        .otherwise(F.concat(introduced_on(F.col("exists_from")), not_yet))
    )
    return known.select("entity_id", "as_of", note.alias("note"))


def scope_note(as_of_day: Column, today: Column, covered: Column, current: str) -> Column:
    """For a past date, which entities have a known history; null for today and later."""
    text = F.concat(
        F.lit("As of "), long_date(as_of_day), F.lit(" history is known only for "), covered,
        F.lit(f"; every other text is the current one ({current}) and cannot be confirmed for that date."),
    )
    return F.when(as_of_day < today, text)


def timeline_markers(timeline: DataFrame) -> DataFrame:
    """What a history shows per segment: date, label, note."""
    label = (
        F.when(F.col("seg_idx") > 0, "text changed")
        .when(F.col("introduced").isNotNull(), "introduced")
        .otherwise("original text")
    )
    return timeline.select(
        "entity_id", F.col("seg_idx").alias("marker_no"), long_date(F.col("start")).alias("date"),
        label.alias("label"), "note",
    )


def existence_markers(existence: DataFrame) -> DataFrame:
    """The two markers of an entity of which only the introduction is known."""
    markers = F.array(
        F.struct(F.lit("earlier").alias("date"), F.lit("did not exist").alias("label"), F.lit("not held").alias("note")),
        F.struct(
            long_date(F.col("introduced")).alias("date"), F.lit("introduced").alias("label"), F.col("title").alias("note")
        ),
    )
    return existence.select("entity_id", F.posexplode(markers).alias("marker_no", "m")).select(
        "entity_id", "marker_no", "m.date", "m.label", "m.note"
    )


def history_view(resolved: DataFrame, existence: DataFrame) -> DataFrame:
    """One row per probe with a history: of its text if there is a timeline, else of its existence."""
    work = bracketed_change(resolved).join(
        existence.select("entity_id", F.col("introduced").alias("exists_from"), F.col("title").alias("exists_title")),
        "entity_id",
        "left",
    )
    has_text = F.col("state") != "UNMAPPED"
    showing = F.when(F.col("served_idx") == 0, F.col("first.start")).otherwise(F.col("seg.start"))
    return work.where(has_text | F.col("exists_from").isNotNull()).select(
        "entity_id",
        "as_of",
        F.when(has_text, "text-change").otherwise("introduced").alias("kind"),
        F.when(has_text, F.col("first.title")).otherwise(F.col("exists_title")).alias("title"),
        F.when(has_text, F.col("change_idx")).alias("change_idx"),
        F.when(has_text, long_date(F.col("change_date"))).alias("change_date"),
        F.when(has_text, F.col("served_idx") >= 1).alias("on_after"),
        F.when(has_text, long_date(showing)).alias("showing"),
        F.when(~has_text, long_date(F.col("exists_from"))).alias("introduced"),
        F.when(~has_text, F.col("as_of") >= F.col("exists_from")).alias("existed"),
    )


def compare_versions(resolved: DataFrame, timeline: DataFrame) -> DataFrame:
    """Both sides of the change that a history describes, with their ranges in force.

    The same change as in ``history_view``: found by its index, then read from the
    timeline as two neighbouring segments.
    """
    asked = bracketed_change(resolved).where(F.col("change_idx").isNotNull()).select(
        "entity_id", "as_of", F.col("change_idx").alias("seg_idx")
    )
    return _sides(asked, timeline)


def compare_latest(timeline: DataFrame) -> DataFrame:
    """Both sides of the last change of every entity that has one."""
    asked = timeline.where("seg_idx > 0 AND end IS NULL").select(
        "entity_id", F.lit(None).cast("date").alias("as_of"), "seg_idx"
    )
    return _sides(asked, timeline)


def with_texts(sides: DataFrame, texts: DataFrame) -> DataFrame:
    """Both texts beside the compared sides; ``texts`` has ``entity_id, snapshot, text``. A text that isn't held is null."""
    for side in ("old", "new"):
        named = texts.select("entity_id", F.col("snapshot").alias(f"{side}_snapshot"), F.col("text").alias(f"{side}_text"))
        sides = sides.join(named, ["entity_id", f"{side}_snapshot"], "left")
    return sides


def comparables(timeline: DataFrame) -> DataFrame:
    """The entities with a change to compare: title, number of changes and date of the last one, in natural order by ``place``."""
    changed = timeline.where("seg_idx > 0").groupBy("entity_id").agg(
        F.max("title").alias("title"), F.count("*").alias("n_changes"), long_date(F.max("start")).alias("last_change")
    )
    return changed.withColumn("id_number", natural_number(F.col("entity_id")))


def with_markers(views: DataFrame, markers: DataFrame) -> DataFrame:
    """Histories with the ``markers`` (``date``, ``label``, ``note``) of their entity, in order; those with a text history get its markers."""
    order = F.array_sort(F.collect_list(F.struct("marker_no", "date", "label", "note")))
    listed = markers.groupBy("entity_id", "kind").agg(
        F.transform(order, lambda m: F.struct(m["date"].alias("date"), m["label"].alias("label"), m["note"].alias("note"))).alias("markers")
    )
    return views.join(listed, ["entity_id", "kind"], "left")


def consistent_change(views: DataFrame, sides: DataFrame, markers: DataFrame) -> DataFrame:
    """Histories with ``consistent``: whether the change they name is the one that their comparison shows, and one of their markers.

    ``markers`` are those of texts; histories of another kind have null.
    """
    compared = sides.select("entity_id", "as_of", F.col("change_date").alias("_compared"))
    dates = markers.groupBy("entity_id").agg(F.collect_set("date").alias("_dates"))
    held = F.col("_compared").isNotNull() & (F.col("_compared") == F.col("change_date")) & F.array_contains("_dates", F.col("change_date"))
    joined = views.join(compared, ["entity_id", "as_of"], "left").join(dates, "entity_id", "left")
    return joined.withColumn("consistent", F.when(F.col("kind") == "text-change", F.coalesce(held, F.lit(False)))).drop("_compared", "_dates")


def _sides(asked: DataFrame, timeline: DataFrame) -> DataFrame:
    by_start = Window.partitionBy("entity_id").orderBy("seg_idx")
    pairs = timeline.select(
        "entity_id",
        "seg_idx",
        "title",
        "note",
        F.col("snapshot").alias("new_snapshot"),
        F.lag("snapshot").over(by_start).alias("old_snapshot"),
        F.lag("start").over(by_start).alias("old_start"),
        "start",
        "end",
    )
    dash = F.lit(" - ")
    right = F.when(F.col("end").isNull(), F.concat(F.lit("from "), long_date(F.col("start")), F.lit(" (current)")))
    return asked.join(pairs, ["entity_id", "seg_idx"]).select(
        "entity_id",
        "as_of",
        F.col("seg_idx").alias("change_idx"),
        long_date(F.col("start")).alias("change_date"),
        "note",
        "old_snapshot",
        F.concat(long_date(F.col("old_start")), dash, long_date(F.col("start"))).alias("old_in_force"),
        "new_snapshot",
        right.otherwise(F.concat(long_date(F.col("start")), dash, long_date(F.col("end")))).alias("new_in_force"),
    )
