"""Which of any number of phrases occur in texts.

Every phrase is looked for by its rarest run of a few characters, through an equality join with the runs of the texts;
only texts that have that run are compared with the phrase. Phrases are a table, so the plan doesn't grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from snaptext.scale import small_side

#: Characters of a run; a shorter phrase is looked for whole.
RUN = 6


def _runs(text: Column, n: int) -> Column:
    """All distinct runs of ``n`` characters."""
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def rarest_runs(phrases: DataFrame) -> DataFrame:
    """(``phrase``, ``run``) of every distinct non-empty phrase: the run that fewest phrases have, ties to the least."""
    distinct = phrases.select("phrase").where("phrase <> ''").distinct()
    whole = F.length("phrase") < RUN
    each = distinct.select("phrase", F.explode(F.when(whole, F.array("phrase")).otherwise(_runs(F.col("phrase"), RUN))).alias("run"))
    # All phrases may share a run: its count is one row, and phrases are counted before they meet it.
    counts = each.groupBy("run").agg(F.count("*").alias("n"))
    return each.join(counts, "run").groupBy("phrase").agg(F.min(F.struct("n", "run")).alias("least")).select("phrase", "least.run")


def matches(texts: DataFrame, keys: list[str], phrases: DataFrame) -> DataFrame:
    """(*keys*, ``phrase``) for every phrase that is a substring of a row's ``text``, once each; keys are unique.

    Empty and null phrases occur nowhere.
    """
    wanted = small_side(rarest_runs(phrases))
    lengths = range(1, RUN + 1)
    some = texts.select(*keys, "text")
    cut = some.select(*keys, F.explode(F.flatten(F.array(*[_runs(F.col("text"), n) for n in lengths]))).alias("run"))
    found = cut.join(wanted, "run").select(*keys, "phrase")
    return found.join(some, keys).where(F.contains("text", F.col("phrase"))).select(*keys, "phrase")
