"""Extendible hashing against splitting one bucket at a time."""

import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from snaptext.llm import sharding
from snaptext.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, shard string, depth int, bits string"


def bits(doc_id, text):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    return f"{int(md5(f'{chr(0)[:0] if doc_id is None else doc_id}:{md5(text or chr(0)[:0])}')[:12], 16):048b}"


def plain_shards(rows, limit, prefix=""):
    """prefix -> rows, splitting while a bucket is too large."""
    inside = [r for r in rows if bits(*r).startswith(prefix)]
    size = sum(len((t or "").encode()) for _, t in inside)
    if size <= limit or len(prefix) == 48:
        return {prefix: size} if inside else {}
    return plain_shards(inside, limit, prefix + "0") | plain_shards(inside, limit, prefix + "1")


def located(df, limit):
    return sharding.assign(df, limit).collect()


@pytest.mark.parametrize("limit", [40, 700, 1 << 20])
def test_splits(spark, limit, monkeypatch):
    monkeypatch.setattr(sharding, "ROUND_BITS", 3)
    rows = [(i, f"é{i} " * (i % 7)) for i in range(200)]
    out = located(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5), limit)
    expected = plain_shards(rows, limit)
    assert len(out) == len(rows)
    for r in out:
        assert expected[r["shard"]] == r["shard_bytes"] <= max(limit, r["n_bytes"])
        assert len(r["shard"]) == r["depth"] and bits(*rows[r["doc_id"]]).startswith(r["shard"])


def test_equal_rows_go_to_pages(spark):
    rows = [(1, "0123456789")] * 25 + [(2, "x" * 95), (3, "y" * 300), (None, None), (4, "")]
    out = located(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA), 100)
    assert len(out) == len(rows)
    pages = sorted((r["page"], r["shard_bytes"]) for r in out if r["doc_id"] == 1)
    assert pages == [(0, 100)] * 10 + [(1, 100)] * 10 + [(2, 50)] * 5
    assert [r["shard_bytes"] for r in out if r["doc_id"] == 3] == [300]
    assert located(spark.createDataFrame([], SCHEMA), 100) == []


def test_written_shards(spark, tmp_path):
    """Columns called as the folders or as our own stay; equal rows go to pages; a null id and text are no harm."""
    rows = [(i, "word " * (i % 50), "mine", 1, "y", 7) for i in range(120)] + [(500, "ten chars!", "mine", 1, "y", 7)] * 450 + [(None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, depth int, bits string, Page int")
    names = sharding.write_shards(df, str(tmp_path / "out"), 2000)
    assert names == ("_shard", "_page") and sharding.folder_names(["_shard", "SHARD"]) == ("__shard", "page")
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in back.select(*df.columns).collect()), key=key) == sorted(rows, key=key)
    sizes = back.groupBy(*names).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()
    assert len(sizes) > 4 and all(r["n"] <= 2000 for r in sizes)
    assert sorted(r["n"] for r in back.where("doc_id = 500").groupBy("_page").agg(F.sum(F.octet_length("text")).alias("n")).collect()) == [500, 2000, 2000]
    assert sharding.write_shards(df.limit(0), str(tmp_path / "none")) == names


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op10_shards"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
