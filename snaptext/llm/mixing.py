"""Mix sources to target weights by weighted sampling without replacement.

Targets: sources share the corpus' size by weight; none gets more than ``max_epochs`` times its own size,
and what is cut off is shared again by weight. In one step: sources sorted by cap / weight are capped
as long as the level that the rest reaches is above them.

Documents: every document is taken once per complete epoch. The fraction left is filled in the order of
exponential keys, -ln(u) / weight with u from a hash of the document (so that reruns agree): documents
of larger weight tend to come first. The last document is taken only as far as the budget goes.

The fill never sorts a source: keys fall into ranges of at most about ``BUCKET`` documents, whatever the
weights are (the logarithm of an exponential key has a density of 1/e at most, so its ranges are even),
sizes are summed per range, and only the one range per source where the budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from snaptext.llm.common import KEY, SPACE, keyed_rows, n_words, whole
from snaptext.scale import stored

MAX_EPOCHS = 3
BUCKET = 4096


def cyclic_weight(rank: Column, cycle: int = 3) -> Column:
    """1, 2, ..., cycle, 1, 2, ... over ranks from 1."""
    return (F.pmod(rank - 1, F.lit(cycle)) + 1).cast("double")


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(``source``, ``source_size``, ``target``) from one row per source.

    Sources in order of code points, null last, weigh 1, 2, 3, 1, ... Sizes are whole numbers, so every
    sum is exact. Sources without words have target 0. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("weight", cyclic_weight(F.row_number().over(by_name)))
    cap = F.col("source_size") * max_epochs
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("lighter"))
    return (
        weighed.select("*", cap.cast("double").alias("cap"), (cap / F.col("weight")).alias("ratio"))
        .select(
            "*",
            F.sum("source_size").over(every).alias("total"),
            F.sum("weight").over(every).alias("weights"),
            F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)).alias("lighter"),
        )
        .select("*", F.when(F.col("ratio") >= level, level).alias("level"))
        .select(
            "source",
            "source_size",
            F.least(F.col("cap"), F.coalesce(F.max("level").over(every) * F.col("weight"), F.col("cap"))).alias("target"),
        )
    )


def unit(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the document alone."""
    head = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text))), 1, 12)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / float(1 << 48)


def letter_share(text: Column) -> Column:
    """Weight of a document: the share of its visible characters that are not punctuation marks, from 0.05 to 1."""
    visible = F.length(F.regexp_replace(text, SPACE, ""))
    marks = F.length(F.regexp_replace(text, r"[^!-/:-@\[-`{-~]+", ""))
    return F.greatest(F.lit(0.05), F.when(visible > 0, 1.0 - marks / visible).otherwise(0.05))


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, bucket: int = BUCKET) -> DataFrame:
    """(``doc_id``, ``text_key``, ``source``, ``size``, ``source_size``, ``target``, ``taken``) for every row of ``docs``.

    ``docs`` has ``doc_id``, ``text``, ``source``. ``size`` counts words, ``taken`` the words that the mix
    takes, repeats counted, at most ``max_epochs`` times the size. A source's taken words are its target
    without the fraction of a word. Null texts have size 0, a null source is a source. Rows that are the
    same in all respects are interchangeable: which of them is cut is arbitrary, the rows returned are not.
    """
    text = whole("text")
    sized = stored(
        docs.select(
            "doc_id", F.xxhash64(text).alias("text_key"), "source", n_words(text).alias("size"), (-F.log(unit(F.col("doc_id"), text)) / letter_share(text)).alias("key")
        ),
        "mixing",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(per_source.select("source", "source_size"), max_epochs).withColumnRenamed("source", "_s")
    plan = stored(
        per_source.join(targets.drop("source_size"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .withColumn("ranges", F.ceil(F.col("n_docs") / bucket).cast("double")),
        "mixing-plan",
    )
    named = plan.withColumnRenamed("source", "_source")
    ranged = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "range", F.floor(F.log("key") * F.col("ranges"))
    )
    # One row per range.
    before = Window.partitionBy("_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        ranged.groupBy("_source", "range", "rest")
        .agg(F.sum("size").alias("in_range"))
        .withColumn("before", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
        .filter("before <= rest and before + in_range > rest")
        .select(F.col("_source").alias("_end_source"), F.col("range").alias("end_range"), F.col("before").alias("end_before"))
    )
    placed = ranged.join(ends, F.col("source").eqNullSafe(F.col("_end_source")), "left")
    full = F.col("epochs") * F.col("size")
    columns = ["doc_id", "text_key", "source", "size", "source_size", "target"]
    # A source without an end has no fraction to fill.
    aside = placed.filter("end_range is null or range != end_range").select(
        *columns, (full + F.when(F.col("range") < F.col("end_range"), F.col("size")).otherwise(0)).cast("long").alias("taken")
    )
    # In the range of the end: equal rows are counted first, however many there are.
    equal = placed.filter("range = end_range").groupBy(*columns, "key", "range", "epochs", "rest", "end_before").agg(F.count("*").alias("copies"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("end_before") - F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))
    cut = (
        equal.withColumn("left", left)
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select(
            *columns,
            (full + F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("copy") * F.col("size")))).cast("long").alias("taken"),
        )
    )
    return aside.unionByName(cut)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, for a text of more than n words, n > 0."""
    trimmed = F.regexp_replace(text, rf"^{SPACE}", "")
    rest = F.element_at(F.split(trimmed, SPACE, n + 1), -1)
    return F.regexp_replace(F.substring(trimmed, F.lit(1), F.length(trimmed) - F.length(rest)), rf"{SPACE}$", "")


def mixed_documents(docs: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Rows of ``docs`` as the mix takes them: one per time taken, the cut one of a source with its first words only.

    Documents that are not taken go, and a text without words is never taken. All columns stay; of rows
    alike in id, text and source the other columns of one of them stand for all.
    """
    key = [*KEY, "_source_key"]
    taken = (
        mix(docs, max_epochs)
        .filter("taken > 0")
        .groupBy(F.xxhash64("doc_id").alias(KEY[0]), F.col("text_key").alias(KEY[1]), F.xxhash64("source").alias(key[2]))
        .agg(F.sum("taken").alias("taken"), F.max("size").alias("size"))
    )
    found = keyed_rows(docs).withColumn(key[2], F.xxhash64("row.source")).dropDuplicates(key).join(taken, key)
    cut = (F.col("taken") % F.col("size")).cast("int")
    text = F.when((F.col("copy") * F.col("size") > F.col("taken")) & (cut > 0), first_words(F.col("row.text"), cut)).otherwise(F.col("row.text"))
    return (
        found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
        .select(F.col("row").withField("text", text).alias("row"))
        .select("row.*")
    )
