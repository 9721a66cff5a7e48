"""Stages of the pipeline on small data, and check SQL of the operators that have it."""

import re

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from check import compare, connect
from conftest import SMALL
from snaptext.llm import pii
from snaptext.llm.oracles import SQL
from snaptext.llm.queries import QUERIES
from test_mixing import plain_mix
from test_shingles import plain_kept


@pytest.mark.parametrize("name", sorted(SQL))
def test_check_sql(spark, name):
    result = compare(spark, connect(SMALL), SMALL, name, QUERIES[name], SQL[name])
    assert result.startswith("ok"), result


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry_point.queries())
    assert set(SQL) <= set(entry_point.oracle_sql())
    assert len(corpus_pipeline.STAGES) == 5


def test_stages(spark, tmp_path):
    docs, columns = spark.read.parquet(f"{SMALL}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    verdict = {r["doc_id"]: r["kept"] for r in QUERIES["op8_quality_rules"](spark, SMALL).collect()}
    before = None
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(n)))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / str(n)))
        rows = docs.collect()
        if n < 4:
            assert docs.columns == columns
            assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
        if name == "quality rules":
            assert {r["doc_id"] for r in rows} == {d for d, kept in verdict.items() if kept}
        elif name == "simhash near-dedup":
            assert {r["doc_id"] for r in rows} == plain_kept([(r["doc_id"], r["text"]) for r in before])
        elif name == "pii":
            assert len(rows) == len(before)
            assert not any(list(pii.base_spans(r["text"])) for r in rows)
        elif name == "mixing":
            taken = plain_mix([(r["doc_id"], r["text"], r["source"]) for r in before])
            got = {}
            for r in rows:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
            assert got == {d: n for d, _, n in taken if n}
    assert len(rows) == len(before) and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(docs.columns)
    assert corpus_pipeline.run(spark, SMALL).count() == len(rows)
