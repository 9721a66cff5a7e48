"""Merkle trees and audits against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from check import compare, connect
from conftest import SMALL
from snaptext.llm import warc
from snaptext.llm.oracles import SQL
from snaptext.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, offset int, seq string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_root(rows, fanout):
    """rows: (offset, length, sha256) in order."""
    nodes = [(o, o + n, sha(f"{o}:{o + n}:{h}")) for o, n, h in rows]
    while True:
        groups = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        nodes = [(g[0][0], g[-1][1], sha(f"{g[0][0]}:{g[-1][1]}:" + "".join(x[2] for x in g))) for g in groups]
        if len(nodes) == 1:
            return nodes[0][2]


def page_rows(n):
    return [(i, f"http://x/{i}", f"<p>é {i}</p>" * (i % 5), 1, "x") for i in range(n)]


@pytest.mark.parametrize("fanout", [2, 16])
def test_tree(spark, fanout):
    records = warc.archive_pages(spark.createDataFrame(page_rows(90), SCHEMA), per_archive=40)
    tree = warc.build_tree(records, warc.levels_of(records, fanout), fanout)
    top = tree.agg(F.max("level")).first()[0]
    roots = {r["archive"]: r["hash"] for r in tree.filter(F.col("level") == top).collect()}
    for archive in (0, 1):
        rows = [(r["offset"], r["length"], sha(r["record"])) for r in records.filter(F.col("archive") == archive).orderBy("seq").collect()]
        assert all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:]))
        assert roots[archive] == plain_root(rows, fanout)


def test_audit_finds_each_kind(spark):
    records = warc.archive_pages(spark.createDataFrame(page_rows(300), SCHEMA), per_archive=100).drop("record")
    replica = records.filter("not (archive = 1 and seq = 99) and archive < 2").withColumn("sha256", F.when((F.col("archive") == 0) & F.col("seq").isin(0, 63), "bad").otherwise(F.col("sha256")))
    extra = replica.filter("archive = 1 and seq = 0").withColumn("seq", F.lit(150).cast("long"))
    found = {(r["archive"], r["seq"]): r["status"] for r in warc.audit(records, replica.unionByName(extra)).collect()}
    assert {k: v for k, v in found.items() if k[0] < 2} == {(0, 0): "changed", (0, 63): "changed", (1, 99): "missing", (1, 150): "extra"}
    assert sum(v == "missing" for v in found.values()) == 101
    assert warc.audit(records, records).count() == 0


def test_edge_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "u", "text", 1, "x"), (2, "", "", 1, "x"), (5000, "u", "long " * 300_000, 1, "x")]
    records = warc.archive_pages(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["archive"], r["seq"]) for r in records.collect()) == [(-1, 0), (0, 0), (0, 1), (0, 2), (5, 0)]
    assert warc.audit(records, records.filter("archive != 5")).collect()[0]["status"] == "missing"
    none = records.limit(0)
    assert warc.audit(none, none).count() == 0


def test_query(spark):
    result = compare(spark, connect(SMALL), SMALL, "op4_warc_audit", QUERIES["op4_warc_audit"], SQL["op4_warc_audit"])
    assert result.startswith("ok"), result
