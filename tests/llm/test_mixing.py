"""Targets by repeated resharing and budgets by a plain fill, against the operator."""

import hashlib
import math
import re

import pytest

from conftest import SMALL
from snaptext.llm import mixing
from snaptext.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string, size int, taken string, row int"


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    cap = {s: 3.0 * n for s, n in sizes.items()}
    total, capped = float(sum(sizes.values())), set()
    while True:
        open_ = [s for s in names if s not in capped]
        rest = total - sum(cap[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        if not over:
            return {s: cap[s] if s in capped else share[s] for s in names}
        capped |= over


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def key(doc_id, text):
    text = text or ""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    u = (int(md5(f"{'' if doc_id is None else doc_id}:{md5(text)}")[:12], 16) + 0.5) / (1 << 48)
    visible = len(re.sub(r"[\x20\x09-\x0D]+", "", text))
    marks = len(re.findall(r"[!-/:-@\[-`{-~]", text))
    return -math.log(u) / max(0.05, 1 - marks / visible if visible else 0.05)


def plain_mix(rows):
    """Sorted (doc_id, size, taken) of (doc_id, text, source)."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    targets, out = plain_targets(sizes), []
    for s in sizes:
        budget = math.floor(targets[s])
        epochs = budget // sizes[s] if sizes[s] else 0
        left = budget - epochs * sizes[s]
        for d, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (key(r[0], r[1]), -1 if r[0] is None else r[0])):
            n = len(words(t))
            out.append((-1 if d is None else d, n, epochs * n + max(0, min(n, left))))
            left -= n
    return sorted(out)


def operator(df, **kw):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(df, **kw).collect())


def test_targets(spark):
    for sizes in [{"a": 10, "b": 1000, "c": 5, None: 300, "é": 7}, {"a": 1}, {"a": 0, "b": 0}, {"a": 0, "b": 9, "c": 1}, {f"s{i}": (i * 37) % 11 for i in range(40)}]:
        rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        expected = plain_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
        for r in rows:
            assert r["target"] == pytest.approx(expected[r["source"]], abs=1e-9)


@pytest.mark.parametrize("bucket", [2, 50, 4096])
def test_mix(spark, bucket):
    rows = [(i, "w " * (i * 7 % 40) + "!#$ " * (i % 5), f"s{i % 4}" if i % 3 else "s0") for i in range(300)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(6)
    assert operator(df, bucket=bucket) == plain_mix(rows)


def test_query(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = QUERIES["op5_mix_sources"](spark, SMALL).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in out) == plain_mix(rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)


def edge_rows():
    same = (7, "one two three four five six", "hot")
    rows = [same] * 30 + [(None, "a null id", "hot"), (None, None, None), (1, "", "b"), (2, " \n\t ", "b"), (3, "no source " * 30, None)]
    return rows + [(4, "long " * 50_000, "c"), (5, "x", "c")]


def test_edge_rows(spark):
    rows = edge_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert operator(df, bucket=3) == plain_mix(rows)
    assert operator(df.repartition(5), bucket=3) == operator(df.coalesce(1))
    assert operator(df.limit(0)) == []


def test_documents_of_the_mix(spark):
    rows = [(i, f"alpha\tbeta {i}\n" + "w " * (i % 9), f"s{i % 3}" if i > 20 else "tiny") for i in range(60)] + edge_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    took, given = {}, {}
    for r in out.collect():
        k = (r["doc_id"], r["source"])
        took[k] = took.get(k, 0) + len(words(r["text"]))
        assert any(t and t.lstrip().startswith(r["text"].strip()[:5]) for d, t, s in rows if (d, s) == k)
    for r in mixing.mix(df).collect():
        given[r["doc_id"], r["source"]] = given.get((r["doc_id"], r["source"]), 0) + r["taken"]
    assert took == {k: n for k, n in given.items() if n}
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op5_mix_sources"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
