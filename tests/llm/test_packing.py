"""Packing: every id once, offsets without gaps, little padding, whatever the lengths."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from snaptext.llm import packing
from snaptext.llm.queries import QUERIES, vocabulary

SCHEMA = "doc_id long, text string, pos string, ids int, length string"


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(vocabulary())


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def checked(rows, expected, window):
    """Padding of rows over lists of ids, as (doc_id, ids), after checking all that must hold."""
    left = {}
    for doc_id, ids in expected:
        left.setdefault(doc_id, []).append(ids)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(left)
    for doc_id, lists in left.items():
        wanted = Counter((len(ids), s, n, zlib.crc32(packed(ids[s : s + n]))) for ids in lists for s, n in {(r["start"], r["length"]) for r in by_doc[doc_id]} if s + n <= len(ids))
        for r in by_doc[doc_id]:
            assert wanted[r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]]
        assert sum(r["length"] for r in by_doc[doc_id]) == sum(map(len, lists))
        if len(lists) == 1:
            ends = sorted((r["start"], r["start"] + r["length"]) for r in by_doc[doc_id])
            assert [s for s, _ in ends] == [0, *(e for _, e in ends[:-1])] and ends[-1][1] == len(lists[0])
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for some in sequences.values():
        some.sort()
        assert [o for o, _ in some] == [0, *np.cumsum([n for _, n in some])[:-1].tolist()]
        total = sum(n for _, n in some)
        assert 0 < total <= window
        padding += 0 if total & (total - 1) == 0 else window - total
    return padding


def test_query(spark, reference):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    ids = [(d["doc_id"], [*reference.encode(d["text"], add_special_tokens=False).ids, 1]) for d in docs]
    padding = checked(QUERIES["op13_pack_sequences"](spark, SMALL).collect(), ids, 2048)
    assert padding < 0.03 * sum(len(i) for _, i in ids)


@pytest.mark.parametrize("window,grid", [(64, 8), (64, 1), (100, 5)])
def test_small_windows_nulls_and_repeated_rows(spark, reference, window, grid):
    rng = random.Random(window)
    texts = [None, "", "a", "<|endoftext|>", " ".join("word" for _ in range(window * 5))] + [" ".join(rng.choice(["the", "of", "zyx", "é"]) for _ in range(rng.randrange(1, 2 * window))) for _ in range(150)]
    rows = [(i, t, "p", 1, "n") for i, t in enumerate(texts)] + [(None, "null id", "p", 1, "n"), (3, "other", "p", 1, "n"), (4, texts[4], "p", 1, "n"), (4, texts[4], "p", 1, "n")]
    df = spark.createDataFrame(rows, SCHEMA)
    cut = packing.pieces(df, vocabulary(), window)
    expected = [(r[0], [*reference.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows]
    out = packing.pack(cut, window, grid, keep_ids=True).collect()
    checked(out, expected, window)
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    assert packing.pack(packing.pieces(df.limit(0), vocabulary()), window, grid).count() == 0


def lengths_as_pieces(spark, lengths):
    rows = [(i, 0, n, n, b"\x07\0\0\0" * n) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "doc_id long, start long, length long, doc_tokens long, ids binary"), [(i, [7] * n) for i, n in enumerate(lengths)]


@pytest.mark.parametrize("kind", ["one length over half", "mostly one length", "ones", "thirds", "mixed"])
def test_padding_stays_small_for_any_lengths(spark, kind):
    rng = random.Random(2)
    lengths = {
        "one length over half": [150] * 2000,
        "mostly one length": [170] * 900 + [rng.randrange(1, 256) for _ in range(900)],
        "ones": [1] * 3000,
        "thirds": [85] * 1500 + [86] * 700,
        "mixed": [rng.randrange(1, 257) for _ in range(3000)],
    }[kind]
    df, expected = lengths_as_pieces(spark, lengths)
    padding = checked(packing.pack(df, 256, 4).collect(), expected, 256)
    assert padding <= 0.04 * sum(lengths)


def test_combinations():
    classes = [7, 5, 4, 3, 2, 1]
    plain = {(a,) for a in classes if a == 9} | {(a, b) for a in classes for b in classes if a >= b and a + b == 9}
    plain |= {(a, b, c) for a in classes for b in classes for c in classes if a >= b >= c and a + b + c == 9}
    assert sorted(packing.combinations(classes, 9)) == sorted(plain)


def test_nnls_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.random((rng.integers(1, 12), rng.integers(1, 25))), rng.normal(size=1)
        b = rng.normal(size=a.shape[0])
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient < 1e-6).all() and np.abs(gradient[x > 0]).max(initial=0) < 1e-6


def test_greedy_places_all():
    rng = random.Random(6)
    for _ in range(50):
        left = {rng.randrange(1, 33): rng.randrange(1, 40) for _ in range(rng.randrange(1, 12))}
        placed = Counter()
        for content, n in packing.greedy(left, 32):
            assert sum(c * m for c, m in content) <= 32 and n > 0
            for c, m in content:
                placed[c] += m * n
        assert placed == left
