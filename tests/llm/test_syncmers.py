"""Syncmers against a plain implementation."""

import hashlib
import random

import pytest
from pyspark.sql import Row, functions as F

from conftest import SMALL
from snaptext.llm import syncmers
from snaptext.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, fingerprint string, copies int, n int"


def hashes(spark, words):
    """Spark's hash of each word and of pairs and fives of hashes, by plain loops over single rows."""
    w = [r[0] for r in spark.createDataFrame(list(enumerate(words)), "i int, w string").orderBy("i").select(F.xxhash64("w")).collect()]
    return w


def plain_units(text):
    return [u for w in text.split() for u in (w if len(text) < 160 or len(w) > 32 else [w])]


def plain_anchors(spark, text):
    """Positions of closed syncmers, k = 5 and s = 2 units."""
    words = plain_units(text or "")
    if len(words) < 5:
        return [0] if words else []
    w = hashes(spark, words)
    pairs = spark.createDataFrame([(i, w[i], w[i + 1]) for i in range(len(w) - 1)], "i int, a long, b long")
    inner = [r[0] for r in pairs.orderBy("i").select(F.xxhash64("a", "b")).collect()]
    out = []
    for i in range(len(w) - 4):
        four = inner[i : i + 4]
        if min(four) in (four[0], four[3]):
            out.append(i)
    return out


@pytest.mark.parametrize("text", ["", None, "one", "a b c d", "a b c d e", "the cat sat on the mat and the dog sat on the log " * 4, "words before " + "日本語" * 90 + " and after", "短い文章です", "x" * 33 + " ab" * 60, " ".join(f"w{i * i % 17}" for i in range(80))])
def test_anchors(spark, text):
    r = syncmers.with_anchors(spark.createDataFrame([Row(id=1, t=text)], "id int, t string"), "t", "anchors").first()
    assert [a["at"] for a in r["anchors"]] == plain_anchors(spark, text)


def test_anchors_do_not_depend_on_the_rest(spark):
    passage = " ".join(f"p{i * 7 % 31}" for i in range(60))
    rows = [(1, passage), (2, "something else first of all " + passage + " and more")]
    out = {r["id"]: r["anchors"] for r in syncmers.with_anchors(spark.createDataFrame(rows, "id int, t string"), "t", "anchors").collect()}
    moved = {(a["at"] - 5, a["anchor"]) for a in out[2]}
    assert len(plain_units(passage)) == 60
    assert all((a["at"], a["anchor"]) in moved for a in out[1])


def test_aligned(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    left = syncmers.with_anchors(spark.createDataFrame([(1, "x y z " + passage)], "pair int, t string"), "t", "anchors").select("pair", "anchors")
    right = syncmers.with_anchors(spark.createDataFrame([(1, passage + " q r s")], "pair int, t string"), "t", "anchors").select("pair", "anchors")
    best = max(syncmers.aligned(left, right, "pair").collect(), key=lambda r: r["n"])
    assert best["shift"] == -3 and best["first"] >= 3 and best["last"] - best["first"] > 40


def test_next_rows(spark):
    rows = [(i * 3 % 50, i) for i in range(50)] + [(None, 1), (None, 2)]
    keys = spark.createDataFrame(rows, "a long, b long").distinct()
    got = {(r["a"], r["b"]): (r["next"]["a"], r["next"]["b"]) for r in syncmers.next_rows(keys, ["a", "b"]).collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r))
    assert got == {a: b for a, b in zip(order, order[1:] + order[:1])}


def plain_edits(rows):
    """doc_id -> (text, edited text, next text)."""
    out = {}
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        out[d] = t, t[: len(t) - cut] + after[:cut], after
    return out


def test_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    expected = plain_edits(docs)
    rows = {r["doc_id"]: r for r in QUERIES["op6_syncmer_prints"](spark, SMALL).collect()}
    assert rows.keys() == expected.keys()
    of = lambda s: set(s[i : i + 8] for i in range(0, len(s), 8))
    dice = lambda a, b: 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
    prints = {d: rows[d]["fingerprint"] for d, _ in docs}
    for i, (d, t) in enumerate(docs):
        r, (text, edited, _) = rows[d], expected[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(dice(of(r["fingerprint"]), of(r["edited_fingerprint"])))
        assert r["near_next"] == pytest.approx(dice(of(r["fingerprint"]), of(prints[docs[(i + 1) % len(docs)][0]])))
    same = {}
    for d, t in docs:
        assert same.setdefault(t, prints[d]) == prints[d]
    long = [d for d, t in docs if len(t.split()) > 60]
    assert sum(rows[d]["near_edited"] for d in long) / len(long) > 0.6


def test_short_and_unsegmented_texts_stay_alike(spark):
    """A quarter changed leaves more than half of the anchors of texts of 2 to 8 words, and of a paragraph without spaces."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    rows = [(i, " ".join(word() for _ in range(2 + i % 7)), "x", 1, 1) for i in range(300)]
    rows += [(1000 + i, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300 + 40 * i)), "x", 1, 1) for i in range(20)]
    out = syncmers.compare_edited(spark.createDataFrame(rows, SCHEMA)).collect()
    short, long = ([r["near_edited"] for r in out if (r["doc_id"] >= 1000) == late and r["doc_id"] != 299] for late in (False, True))
    assert sum(short) / len(short) > 0.5 and sum(long) / len(long) > 0.6
    assert sum(r["near_next"] for r in out if r["doc_id"] < 299) / 299 < 0.1


def test_edge_rows(spark):
    rows = [(1, "a b c d e f g h", "x", 1, 1), (3, None, "x", 1, 1), (2, "", "x", 1, 1), (2, "", "x", 1, 1), (2, "é€ zwei", "x", 1, 1), (None, "no id here at all", None, None, None), (4, "long word " * 40_000, "x", 1, 1)]
    out = syncmers.compare_edited(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert [r["fingerprint"] for r in out if r["n_chars"] == 0] == [""] * 3
    last = [r for r in out if r["doc_id"] is None][0]
    assert last["edited_sha256"] == hashlib.sha256(("no id here at all"[:13] + "a b ").encode()).hexdigest()
    one = syncmers.compare_edited(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert syncmers.compare_edited(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op6_syncmer_prints"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
