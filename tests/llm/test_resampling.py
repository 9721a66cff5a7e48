"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from snaptext.llm import counting, resampling
from snaptext.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, rank string, weight int, pos int, _score string"


def plain_runs(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in plain_runs(text)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log(((b + 1) * (sum(s) + 10000)) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text in docs:
        words, runs = plain_runs(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in runs)
        out.append([doc_id, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in out]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def got(df):
    return ordered([(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()])


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert got(QUERIES["op11_importance_resample"](spark, SMALL)) == ordered(plain_resample(docs, target))


def test_nulls_ties_repeated_rows_and_clashing_names(spark):
    rng = random.Random(1)
    texts = [None, "", "...", "One", "two words", "x" * 500 + " y " + "é" * 90 + " z", "A-b_c'D 9\x7f9 ünï 中文 ok"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(i, " ".join(rng.choice(["ab", "c1", "ÉÉ", "d" * 70, "we"]) for _ in range(rng.randrange(15, 60)))) for i in range(-40, 0)]
    docs += [(None, docs[-1][1]), (None, "same words " * 30), (9, "same words " * 30), (9, "same words " * 30)]
    target = [None, "", "ab c1", "same words same"]
    df = spark.createDataFrame([(*d, "r", 1, 2, "s") for d in docs], SCHEMA)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    mine = resampling.resample(df, wanted, percent=60, digit_bits=7)
    assert got(mine) == ordered(plain_resample(docs, target, percent=60))


def test_ids_over_the_whole_range(spark):
    docs = [(i, "same words " * 12) for i in (-(1 << 63), (1 << 63) - 1, 0, -1, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(resampling.resample(df, df.limit(0), percent=80, digit_bits=14)) == ordered(plain_resample(docs, [], percent=80))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    short = spark.createDataFrame([(1, "few words"), (2, None)], "doc_id long, text string")
    assert [r["rank"] for r in resampling.resample(short, none).collect()] == [None, None]


def test_long_texts_come_in_pieces():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcé9Z-") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(0, 300))) for _ in range(20)]
    texts += [None, "", "w" * 4000, "a" * 100 + " " + "b" * 64 + " " + "c" * 63]
    for at_once in (1, 17, 400, 1 << 20):
        found = [[] for _ in texts]
        for of, bucket, size in resampling.features([None if t is None else t.encode() for t in texts], at_once=at_once):
            for o, b, n in zip(of.tolist(), bucket.tolist(), size.tolist()):
                found[o].append((b, n))
        for t, f in zip(texts, found):
            assert sorted(f) == sorted((zlib.crc32(r.encode()) % 10000, r.count(" ") + 1) for r in plain_runs(t)[1])


def test_counting_ranks(spark):
    rng = random.Random(7)
    rows = [(i * 3, 0 if i % 3 else rng.randrange(9), f"p{i}") for i in range(900)]
    df = counting.numbered(spark.createDataFrame(rows, "n long, key int, payload string").repartition(7), "test")
    for block in (1, 10, 1000):
        out = counting.ranked(df, F.col("key"), block).collect()
        sort = counting.ranked(df, F.col("key"), block, across=9).collect()
        assert {r["payload"] for r in out} == {r[2] for r in rows}
        for key in range(9):
            same = sorted((r["pos"], r["rank"]) for r in out if r["key"] == key)
            assert [rank for _, rank in same] == list(range(len(same)))
        assert [r["rank"] for r in sorted(sort, key=lambda r: (r["key"], r["pos"]))] == list(range(900))


def test_digits(spark):
    rng = random.Random(3)
    rows = [(rng.getrandbits(20), rng.getrandbits(1), rng.getrandbits(64) - (1 << 63)) for _ in range(50)]
    parts = [(F.col("a"), 20), (F.col("b"), 1), (F.col("c"), 64)]
    columns = [counting.digit(parts, 11 * i, 11) for i in range(8)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    for row, digits in zip(rows, df.select(*columns).collect()):
        number = (row[0] << 65) | (row[1] << 64) | (row[2] % (1 << 64))
        assert list(digits) == [(number >> 11 * i) & 2047 for i in range(8)]


def test_gains_are_smoothed():
    gain = resampling.gains(np.array([0, 3, 0]), np.array([2, 0, 0]))
    assert gain.tolist() == [math.floor(1000 * math.log(x)) for x in (3 * 6 / 5, 6 / (4 * 5), 6 / 5)]
