"""Base rules and log-likelihood ratios against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from snaptext.llm import quality
from snaptext.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, row string, buckets int, kept string"


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [(x,) for x in w] + list(zip(w, w[1:]))


def plain_ratios(spark, docs, trusted):
    """Mean ratio per document, with buckets looked up in Spark's hash."""
    each = sorted({g for _, t in docs for g in grams(t)})
    one = spark.createDataFrame([(g[0], g[1] if len(g) > 1 else None) for g in each], "a string, b string")
    slot = F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64(F.xxhash64("a"), F.xxhash64("b")))
    bucket = {((r[0],) if r[1] is None else (r[0], r[1])): r[2] for r in one.select("a", "b", F.pmod(slot, F.lit(quality.BUCKETS))).collect()}
    corpus, good = Counter(), Counter()
    for d, t in docs:
        own = Counter(bucket[g] for g in grams(t))
        corpus.update(own)
        if d in trusted:
            good.update(own)
    n, m = sum(corpus.values()), sum(good.values())
    prior = quality.PRIOR
    ratio = lambda b: math.log((good[b] + prior * corpus[b] / n) / (m + prior)) - math.log(corpus[b] / n) if m else 0.0
    return [sum(ratio(bucket[g]) for g in grams(t)) / len(grams(t)) if grams(t) else 0.0 for _, t in docs]


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def many_repeats(seed):
    return " ".join(f"w{(i * i + seed) % 97} v{i % (60 + seed)}" for i in range(400))


def test_base_features(spark):
    texts = [None, "", " \n ", "a", "a b", "a b c", "a b c a b c", "x y z\n\nx y z\n \nq", "of " * 80, "a\tb\rc\x0bd\x0ce\x1cf g", "#*$%&|<> ä\n#*$\n#*$", "one two three " * 20 + "end"]
    texts += [many_repeats(s) for s in range(4)] + [" ".join(f"u{i}" for i in range(200)) + " u1 u2 u3 u4", "Ä€\U0001f600 b " * 30]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    out = quality.assess(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "doc_id long")).collect()
    for r in out:
        assert tuple(r[c] for c in COLUMNS) == plain_base(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert r["log_ratio"] == 0.0 and r["kept"] == (not r["base_failed"])


def test_query_and_filter(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    trusted = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op8_quality_rules"](spark, SMALL).collect()}
    assert len(rows) == len(docs)
    for (d, t), ratio in zip(docs, plain_ratios(spark, docs, trusted)):
        assert tuple(rows[d][c] for c in COLUMNS) == plain_base(t)
        assert rows[d]["log_ratio"] == pytest.approx(ratio, abs=1e-9)
        assert rows[d]["kept"] == (not rows[d]["base_failed"] and ratio >= quality.THRESHOLD)
    clean = [d for d in trusted if d in rows and not rows[d]["base_failed"]]
    assert all(rows[d]["kept"] for d in clean)
    kept = quality.keep_good(spark.read.parquet(f"{SMALL}/documents.parquet"), labels.filter("quality = 1"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d in rows if rows[d]["kept"]}


def test_shuffled_letters_score_below_their_original(spark):
    """Every word of a good text with its letters in another order: the same letters, lengths and marks, other words."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 10))) for _ in range(400)]
    good = {i: " ".join(rng.choice(vocabulary) for _ in range(120)) for i in range(300)}
    odd = {1000 + i: " ".join("".join(rng.sample(w, len(w))) for w in good[i].split()) for i in range(40)}
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in (good | odd).items()], SCHEMA)
    score = {r["doc_id"]: r["log_ratio"] for r in quality.assess(df, spark.createDataFrame([(i,) for i in range(50, 300)], "doc_id long")).collect()}
    assert all(score[1000 + i] < score[i] for i in range(40))


def test_edge_rows(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, "x", 1, "y"), (1, good, "x", 1, "y"), (None, good, None, None, None), (2, None, "x", 1, "y"), (3, "", "x", 1, "y"), (4, " ".join(f"long{i}" for i in range(150_000)), "x", 1, "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    trusted = spark.createDataFrame([(1,), (1,), (None,), (99,)], "doc_id long")
    out = quality.assess(df, trusted).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in out) == [(0, True), (1, True), (1, True), (2, False), (3, False), (4, True)]
    kept = quality.keep_good(df, trusted)
    assert kept.columns == df.columns and kept.count() == 4
    assert quality.assess(df.limit(0), trusted).count() == 0 and quality.keep_good(df.limit(0), trusted).count() == 0


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op8_quality_rules"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
