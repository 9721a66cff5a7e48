"""Document fingerprints from closed syncmers of words, and of characters where words are few or very long.

A text is a sequence of units: its words, where a word of more than ``LONG_WORD`` characters, as in scripts without
spaces, is cut into its characters, and so is every word of a text of fewer than ``SHORT_TEXT`` characters. What a
word becomes doesn't depend on its neighbours, and a changed text of about the same length is cut alike.

A k-mer of units is an anchor if the smallest hash of its inner s-unit substrings lies at its first or
last position. That depends on the k-mer alone, so a passage has the same anchors in any document. About
2 in k - s + 1 k-mers are anchors, and every window of k - s k-mers has one.

Anchors keep their order and position, for positional matching. A text with fewer than k units has
one anchor, its whole sequence; a text without words has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from snaptext.llm.common import KEY, whole, with_key, words
from snaptext.scale import stored

K, S = 5, 2
#: Words of more characters, and all words of texts of fewer, are cut into characters.
LONG_WORD, SHORT_TEXT = 32, 160


def units(text: Column) -> Column:
    """Array of the units of a text."""
    found, short = words(text), F.length(text) < SHORT_TEXT
    cut = F.transform(found, lambda w: F.when(short | (F.length(w) > LONG_WORD), F.array_remove(F.split(w, ""), "")).otherwise(F.array(w)))
    return F.when(short | F.exists(found, lambda w: F.length(w) > LONG_WORD), F.flatten(cut)).otherwise(found)


def with_anchors(df: DataFrame, text: str, name: str, k: int = K, s: int = S) -> DataFrame:
    """Add ``name``: array of (``at``: position of its first unit from 0, ``anchor``: 32-bit hash of the k-mer)."""
    w, inner, n = f"_{name}_w", f"_{name}_s", k - s + 1
    steps = [F.col(w), *[F.slice(F.col(w), i + 1, F.greatest(F.size(w) - i, F.lit(0))) for i in range(1, s)]]
    df = df.withColumn(w, F.transform(units(whole(text)), lambda x: F.xxhash64(x)))
    # The s-mers, without those at the end that are cut short.
    zipped = F.transform(F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(steps)]), lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(s)]))
    df = df.withColumn(inner, F.slice(zipped, 1, F.greatest(F.size(w) - (s - 1), F.lit(0))) if s > 1 else F.col(w))

    def least_at_edge(i: Column) -> Column:
        own = [F.get(F.col(inner), i + j) for j in range(n)]
        edge = F.least(own[0], own[-1])
        if n <= 2:
            return F.lit(True)
        return edge <= (own[1] if n == 3 else F.least(*own[1:-1]))

    at = F.filter(F.sequence(F.lit(0), F.size(w) - k), least_at_edge)
    many = F.transform(at, lambda i: F.struct(i.alias("at"), F.hash(*[F.get(F.col(w), i + j) for j in range(k)]).alias("anchor")))
    whole_text = F.array(F.struct(F.lit(0).alias("at"), F.hash(F.lit("short"), F.array_join(F.transform(w, lambda x: x.cast("string")), " ")).alias("anchor")))
    none = F.array().cast("array<struct<at:int,anchor:int>>")
    return df.withColumn(name, F.when(F.size(w) == 0, none).when(F.size(w) < k, whole_text).otherwise(many)).drop(w, inner)


def as_string(anchors: Column) -> Column:
    """Anchors in order, 8 hex digits each."""
    return F.array_join(F.transform(anchors["anchor"], lambda a: F.lpad(F.hex(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Shared distinct anchors, twice, by both sides' distinct anchors (0 to 1); 1 if neither has any."""
    both = F.size(F.array_distinct(left)) + F.size(F.array_distinct(right))
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(left, right)) / both)


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Positional matches of pairs: (``key``, ``shift``, ``n``, ``first``, ``last``), one row per diagonal.

    Both sides have ``key`` and ``anchors``. Anchors found once on each side are paired; those with the
    same shift of position lie in one common passage, from unit ``first`` to unit ``last`` of the left side.
    """

    def once(df: DataFrame, name: str) -> DataFrame:
        flat = df.select(key, F.inline("anchors"))
        return flat.groupBy(key, "anchor").agg(F.min("at").alias(name), F.count("*").alias("n")).filter("n = 1").drop("n")

    pairs = once(left, "l").join(once(right, "r"), [key, "anchor"])
    return pairs.groupBy(key, (F.col("r") - F.col("l")).alias("shift")).agg(
        F.count("*").alias("n"), F.min("l").alias("first"), (F.max("l")).alias("last")
    )


def next_rows(keys: DataFrame, by: list[str]) -> DataFrame:
    """Each row of ``keys`` (no repeats) with ``next``: a struct of the row that follows it by ``by``, the first after the last.

    Nulls come last. Rows are dealt by range and numbered; neighbours are looked up inside a range, and
    between ranges from one row per range.
    """
    order = [F.asc_nulls_last(c) for c in by]
    spark = keys.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = stored(
        keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()),
        "syncmers-order",
    )
    row = F.struct(*keys.columns)
    part = F.shiftright("_n", 33)
    ranged = numbered.withColumn("_part", part)
    inside = ranged.withColumn("next", F.lead(row).over(Window.partitionBy("_part").orderBy("_n")))
    firsts = ranged.groupBy("_part").agg(F.min_by(row, F.col("_n")).alias("first"))
    later = F.lead("first").over(Window.orderBy("_part"))
    starts = firsts.select("_part", F.coalesce(later, F.min_by("first", "_part").over(Window.partitionBy())).alias("after"))
    return inside.join(starts, "_part").select(*keys.columns, F.coalesce("next", "after").alias("next"))


def compare_edited(docs: DataFrame, share: int = 4, k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness.

    Edited: the last floor(n_chars / ``share``) code points are replaced by the first as many, or all, of
    the next document by ascending id. Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next`` for every row. Null texts are empty. Null ids come
    last. Rows equal in id and text count as one document (and get one result each); rows that share only
    the id follow each other by the hash of their text. A single document follows itself.
    """
    base = with_key(docs.select("doc_id", whole("text").alias("text")))
    keys = base.groupBy(*KEY).agg(
        F.first("doc_id").alias("doc_id"), F.first(F.length("text")).alias("n"), F.count("*").alias("copies")
    )
    follows = next_rows(keys, ["doc_id", KEY[1]]).select(
        *[F.col(f"next.{c}").alias(c) for c in KEY], *[F.col(c).alias(f"for{c}") for c in KEY], F.col("n").alias("for_n"), F.col("copies").alias("for_copies")
    )
    # Both joins below take the same rows from the same shuffle of the texts; repeated rows meet before it.
    once = base.groupBy(*KEY).agg(F.first(F.struct("doc_id", "text")).alias("row"))
    # The next document sends the piece of text that is needed, and its anchors.
    sent = once.join(follows, KEY).withColumn("text", F.col("row.text"))
    sent = with_anchors(sent, "text", "next_anchors", k, s).select(
        *[F.col(f"for{c}").alias(c) for c in KEY],
        F.col("for_copies").alias("copies"),
        F.substring(F.col("text"), F.lit(1), F.floor(F.col("for_n") / share).cast("int")).alias("piece"),
        F.col("next_anchors.anchor").alias("next_anchors"),
    )
    met = once.join(sent, KEY).select("row.*", "copies", "piece", "next_anchors")
    met = met.withColumn("n_chars", F.length("text").cast("long"))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / share)).cast("int")
    met = met.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), kept), F.col("piece")))
    met = with_anchors(with_anchors(met, "text", "anchors", k, s), "edited", "edited_anchors", k, s)
    compared = met.select(
        "doc_id",
        "copies",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("anchors")).alias("fingerprint"),
        as_string(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors.anchor"), F.col("edited_anchors.anchor")).alias("near_edited"),
        likeness(F.col("anchors.anchor"), F.col("next_anchors")).alias("near_next"),
    )
    return compared.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy", "copies")
