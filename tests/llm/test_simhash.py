"""Fingerprints, the vantage-point tree and groups against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SMALL
from snaptext.llm import simhash
from snaptext.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, fingerprint string, group int"


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=2):
    """Smallest index of each point's group."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", ["", "one", "One two", "a b c", "Ä É a\tb\nc  d e f", "x " * 500, "the cat sat on the mat " * 40])
def test_fingerprint(text):
    assert simhash.simhash(text.encode()) == plain_print(text)


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    points = [int(x) for x in rng.integers(0, 1 << 63, n // 2)]
    while len(points) < n:
        p = points[rng.integers(len(points))]
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            p ^= 1 << int(b)
        points.append(p)
    return points


def test_every_near_pair_meets_once():
    points = np.array(sorted(set(clustered(600))), dtype=np.uint64)
    for levels in (1, 4, 7, 12):
        tree = simhash.build_tree(points[::3], levels)
        shard, at, guest = simhash.shards_of(tree, points, 2)
        home = {int(i): int(s) for s, i, g in zip(shard, at, guest) if not g}
        assert len(home) == len(points)
        visits = {(int(s), int(i)) for s, i, g in zip(shard, at, guest) if g}
        for i in range(len(points)):
            for j in range(i):
                if int(points[i] ^ points[j]).bit_count() <= 2:
                    met = (home[i] == home[j]) + ((home[i], j) in visits) + ((home[j], i) in visits)
                    assert met >= 1
        # Few shards are entered.
        assert len(shard) < len(points) * 30


@pytest.mark.parametrize("shard", [4, 64, 4096])
def test_groups(spark, shard):
    points = sorted(set(clustered(400, 7)))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(s,) for s in signed], "fingerprint long").repartition(5)
    roots = {r["a"]: r["b"] for r in simhash.components(simhash.near_groups(df, 2, shard)).collect()}
    got = [roots.get(s, s) for s in signed]
    expected = plain_groups(points)
    assert len(set(zip(got, expected))) == len(set(got)) == len(set(expected))


def test_chain_is_one_group(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 200)], "a long, b long").repartition(7)
    assert {r["b"] for r in simhash.components(links).collect()} == {0}


def test_dense_group_gives_few_links():
    base = np.uint64(0x0123456789ABCDEF)
    ball = np.array([int(base) ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)] + [int(base)], dtype=np.uint64)
    members, roots = simhash.local_groups(ball, ball[:0], 2)
    assert len(members) == len(ball) - 1 and len(set(roots.tolist())) == 1


def edge_rows():
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    return [
        (5, None, "x", 1), (6, "", "y", 2), (7, " \n ", "z", 3), (1, "same old text here again", "x", 4), (2, "same old text here again", "x", 5),
        (2, "same old text here again", "x", 5), (None, "only one without an id", "x", 6), (None, None, None, None), (9, long, "x", 7), (4, long + " end", "x", 8),
    ]


def test_edge_rows(spark):
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 10
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    assert by[5, "0" * 16] == by[6, "0" * 16] == by[7, "0" * 16] == by[None, "0" * 16] == 5
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert [r["component_id"] for r in rows if r["doc_id"] is None and r["fingerprint"] != "0" * 16] == [None]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (True, 0)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0


def test_query_against_all_pairs(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op1_simhash_groups"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_print(d["text"]) for d in docs]
    groups = plain_groups(prints)
    assert len(rows) == len(docs)
    for d, p, g in zip(docs, prints, groups):
        assert rows[d["doc_id"]]["fingerprint"] == f"{p:016x}"
        assert rows[d["doc_id"]]["component_id"] == docs[g]["doc_id"]


def test_tree_and_joins_are_no_cross_joins(spark):
    plan = QUERIES["op1_simhash_groups"](spark, SMALL)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert F is not None
