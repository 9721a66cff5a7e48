"""Kneser-Ney models against a plain implementation; predictions on held-out documents."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from snaptext.llm import langid
from snaptext.llm.queries import QUERIES

TEXTS = {"aa": ["banana bandana, band!", "an ant and a banana"], "bb": ["zoo zulu zz top", "uzo luz toz pot zoo"]}


def plain_model(texts):
    """p(symbol | context) by the textbook recursion."""
    raw = Counter()
    for t in texts:
        s = "".join(c.lower() if c.isalpha() else " " for c in t)
        s = "\x01\x01" + " " + " ".join(s.split()) + " "
        for i in range(len(s) - 3):
            raw[s[i : i + 4]] += 1
    counts = {4: raw}
    for k in (3, 2, 1):
        counts[k] = Counter()
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    stats = {}
    for k in counts:
        total, types = defaultdict(int), defaultdict(int)
        for g, n in counts[k].items():
            total[g[:-1]] += n
            types[g[:-1]] += 1
        n1, n2 = sum(n == 1 for n in counts[k].values()), sum(n == 2 for n in counts[k].values())
        d = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0.5))
        stats[k] = total, types, d
    alphabet = len(counts[1])

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (alphabet + 1)
        total, types, d = stats[k]
        lower = p(gram[1:])
        h = gram[:-1]
        if not total[h]:
            return lower
        return max(counts[k][gram] - d, 0) / total[h] + d * types[h] / total[h] * lower

    return p


def model_of(spark):
    rows = [(lang, t) for lang, texts in TEXTS.items() for t in texts]
    return langid.train(spark.createDataFrame(rows, "lang string, text string").repartition(3))


def test_model_is_interpolated_kneser_ney(spark):
    model = model_of(spark)
    assert model.langs == ["aa", "bb"]
    for text in ["banana zoo", "Quiz!", "an", "ünter der linde", "x" * 50]:
        s = "".join(c.lower() if c.isalpha() else " " for c in text)
        s = "\x01\x01" + " " + " ".join(s.split()) + " "
        grams = [s[i : i + 4] for i in range(len(s) - 3)]
        for k, lang in enumerate(model.langs):
            p = plain_model(TEXTS[lang])
            expected = -sum(math.log(p(g)) for g in grams) / len(grams)
            assert model.entropies(text)[k] == pytest.approx(expected, rel=1e-5)


def test_probabilities_sum_to_one(spark):
    model = model_of(spark)
    alphabet = sorted({c for t in TEXTS["aa"] for c in t.lower() if c.isalpha()} | {" "})
    for context in ("ban", "\x01\x01 ", "xyz", "an "):
        packed = [sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(context + a)) for a in alphabet]
        total = np.exp(model.logs(np.array(packed, dtype=np.uint64))[:, 0]).sum()
        assert 0.5 < total <= 1.0 + 1e-5


def test_counts_do_not_depend_on_partitions(spark, monkeypatch):
    rows = [("aa", "some words of text"), ("aa", ""), ("bb", "mehr wörter"), ("aa", "12 !?")] * 5
    df = spark.createDataFrame(rows, "lang string, text string")
    one = {(r["lang"], r["gram"]): r["n"] for r in langid.count_grams(df.coalesce(1)).collect()}
    many = {(r["lang"], r["gram"]): r["n"] for r in langid.count_grams(df.repartition(7)).collect()}
    expected = Counter()
    for lang, t in rows:
        for g in langid.grams(t).view(np.int64).tolist():
            expected[lang, g] += 1
    assert one == many == dict(expected)


def test_rare_grams_go_first(spark):
    df = spark.createDataFrame([("aa", "abcabcabc abcabc"), ("aa", "xyz")], "lang string, text string")
    whole, small = langid.train(df), langid.train(df, max_grams=4)
    assert 0 < len(small.grams[4].hashes) <= 4 < len(whole.grams[4].hashes)


def test_edge_rows(spark):
    rows = [(i, t, lang, 7, "x") for i, (t, lang) in enumerate([(x, k) for k, v in TEXTS.items() for x in v] * 12)]
    rows += [(900, None, "aa", 1, "x"), (901, "", None, 1, "x"), (902, "123 !?", "aa", 1, "x"), (903, "banana", None, 1, "x"), (None, "zoo", "bb", 1, None), (904, "zoo " * 60_000, None, 1, "x"), (903, "banana", None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    out = langid.predict(docs, fold == 0, fold == 1).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    for i in (900, 901, 902):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["accepted"]) == ("und", 0.0, False)
    assert by[903]["lang_pred"] == "aa" and by[904]["lang_pred"] == "bb" and by[None]["lang_pred"] == "bb"
    assert by[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in out)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    out = langid.predict(docs, F.lit(False), F.lit(False)).collect()
    assert [r["lang_pred"] for r in out] == ["und", "und"]
    assert langid.predict(docs.limit(0), F.lit(False), F.lit(False)).count() == 0


def test_query_on_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op2_language"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(rows[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0) for d in docs)
    held = [d for d in docs if rows[d["doc_id"]]["held_out"] and d["lang"]]
    right = sum(rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held)
    assert right >= 0.97 * len(held)
