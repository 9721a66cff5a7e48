"""Quality rules: base rules on words, then a hashed n-gram log-likelihood ratio.

Single words and pairs of neighbours are hashed into ``BUCKETS``. Two multinomials over the buckets, one of the
trusted documents and one of the whole corpus, give each bucket a log ratio; a document's verdict is its
mean over all its n-grams against a fixed threshold, the same for every document. At 0 a text is as
likely in the corpus as in the trusted part. The trusted counts are smoothed towards the corpus, by as
many n-grams as ``PRIOR`` says, about six to a bucket, so that a few trusted documents cannot condemn what they lack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from snaptext.llm.common import SPACE, whole, words
from snaptext.scale import small_side, stored

BUCKETS = 1 << 15
#: Mean log ratio (nats per n-gram) below which a document is rejected.
THRESHOLD = -0.13
PRIOR = 200_000.0
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Up to so many different repeated windows are looked up one by one, more by sorting; only a matter of speed.
_FEW = 32


def with_buckets(df: DataFrame, text: Column, buckets: int = BUCKETS) -> DataFrame:
    """Add ``buckets``: the bucket of every word and of every pair of neighbours, repeats included."""
    df = df.withColumn("_hashes", F.transform(words(text), lambda w: F.xxhash64(w)))
    slot = lambda h: F.pmod(h, F.lit(buckets)).cast("smallint")
    pairs = F.when(
        F.size("_hashes") > 1,
        F.transform(F.sequence(F.lit(0), F.size("_hashes") - 2), lambda i: slot(F.xxhash64(F.get("_hashes", i), F.get("_hashes", i + 1)))),
    ).otherwise(F.array().cast("array<smallint>"))
    return df.withColumn("buckets", F.concat(F.transform("_hashes", slot), pairs)).drop("_hashes")


def with_base(df: DataFrame, text: Column) -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    df = df.withColumns({"_words": words(text), "_lines": lines})
    n = F.size("_words")
    windows = F.when(
        n > 2, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    ).otherwise(F.array().cast("array<long>"))
    df = df.select(
        *[c for c in df.columns if c not in ("_words", "_lines")],
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    # Windows found twice or more: none, a few that are looked up, or many that are found by sorting.
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.array().cast("array<long>")).otherwise(F.sort_array("_windows")))
    df = df.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda x, i: F.coalesce(x == F.get("_sorted", i - 1), F.lit(False)))))
    df = df.withColumn(
        "_ordered",
        F.when(
            F.size("_twice") > _FEW, F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        ).otherwise(F.array().cast("array<struct<x:long,i:int>>")),
    )
    same = lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False))
    many = F.sort_array(
        F.transform(
            F.filter("_ordered", lambda p, j: same(p, F.get("_ordered", j - 1)) | same(p, F.get("_ordered", j + 1))), lambda p: p["i"]
        )
    )
    few = F.filter(
        F.transform("_windows", lambda x, i: F.when(F.array_contains("_twice", x), i)), lambda i: i.isNotNull()
    )
    df = df.withColumn(
        "_at", F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(F.size("_twice") <= _FEW, few).otherwise(many)
    )
    covered = F.aggregate(
        F.transform("_at", lambda a, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - a, F.lit(3)))), F.lit(0), lambda s, x: s + x
    )
    df = df.withColumn("n_repeat_words", covered.cast("long")).drop("_windows", "_sorted", "_twice", "_ordered", "_at")
    return df.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )


def log_ratios(features: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """log p(trusted) - log p(corpus) per bucket, from a stored (``doc_id``, ``buckets``) and the ids of trusted documents.

    Counts cover all n-grams of all documents; one row per bucket comes to the driver. Without trusted
    documents, and for buckets that the corpus lacks, ratios are 0.
    """
    # Measured, and broadcast while it is small, so that the n-grams stay where they are; else both sides are shuffled.
    known = small_side(trusted.filter("doc_id is not null").select("doc_id").distinct().withColumn("_trusted", F.lit(1)))
    counts = (
        features.select("doc_id", "buckets").join(known, "doc_id", "left")
        .select(F.coalesce("_trusted", F.lit(0)).alias("t"), F.explode("buckets").alias("bucket"))
        .groupBy("bucket").agg(F.sum("t").alias("trusted"), F.count("*").alias("corpus"))
        .collect()
    )
    n_trusted, n_corpus = sum(r["trusted"] for r in counts), sum(r["corpus"] for r in counts)
    out = [0.0] * buckets
    for r in counts if n_trusted else []:
        share = r["corpus"] / n_corpus
        out[r["bucket"]] = math.log((r["trusted"] + prior * share) / (n_trusted + prior)) - math.log(share)
    return out


def mean_ratio(ratios: list[float]) -> Column:
    """Mean log ratio of ``buckets``; 0 for a text without n-grams."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = F.aggregate("buckets", F.lit(0.0), lambda s, b: s + F.get(table, b))
    return F.when(F.size("buckets") > 0, total / F.size("buckets")).otherwise(0.0)


def assess(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the base features, ``base_failed``, ``log_ratio`` and ``kept`` for every row of (``doc_id``, ``text``).

    ``trusted`` has a column ``doc_id``. Null texts count as empty and fail the base rule; null ids are
    never trusted; repeated rows give repeated rows (and count as often); an empty table gives none.
    """
    text = whole("text")
    features = with_base(with_buckets(docs.select("doc_id", "text"), text), text).drop("text")
    features = stored(features, "quality")
    ratios = log_ratios(features, trusted)
    return (
        features.withColumn("log_ratio", mean_ratio(ratios))
        .withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))
        .drop("buckets")
    )


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that ``assess`` keeps, all columns."""
    counted = stored(with_buckets(docs.select("doc_id", "text"), whole("text")).select("doc_id", "buckets"), "quality-buckets")
    ratios = log_ratios(counted, trusted)
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), whole("text").alias("text"))
    judged = with_base(with_buckets(inner, F.col("text")), F.col("text"))
    # The row number keeps the optimizer from writing all of the above into the filter, once per use.
    judged = judged.select(
        "row", F.monotonically_increasing_id().alias("at"), (~F.col("base_failed") & (mean_ratio(ratios) >= threshold)).alias("kept")
    )
    return judged.filter((F.col("at") >= 0) & F.col("kept")).select("row.*")
