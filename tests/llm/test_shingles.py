"""Near-duplicates of the pipeline against brute-force Jaccard similarity of five-word shingles."""

import random

import pytest

import corpus_pipeline
from conftest import SMALL
from snaptext.llm import shingles, simhash


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_kept(rows):
    """Ids that stay, from (id, text)."""
    rows = sorted(rows)
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            shared = len(a & b)
            if label[i] != label[j] and (a == b or 5 * shared >= 4 * (len(a) + len(b) - shared)):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return {rows[g][0] for g in label}


def edited_copies(n=150, seed=5):
    """Unrelated texts, copies of some with a few words changed, a chain of edits, short and empty texts."""
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(5, 120))) for _ in range(n // 3)]
    while len(texts) < n:
        words = rng.choice(texts).split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
        texts.append(" ".join(words))
    return list(enumerate([*texts, "", None, " ", "One two", "one TWO", "one two three"]))


@pytest.mark.parametrize("tile", [dict(), dict(tile_sets=4), dict(tile_shingles=300)])
def test_edited_copies(spark, tile):
    rows = edited_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r["doc_id"] for r in shingles.one_of_each(docs, **tile).collect()]
    want = plain_kept(rows)
    assert len(want) < 130 and len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_stage_on_documents(spark, size):
    folder = SMALL.replace("sf0.001", size)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, folder).collect()]
    want = plain_kept(rows)
    assert len(got) == len(want) and set(got) == want


def test_empty_and_repeated(spark):
    assert shingles.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in shingles.one_of_each(docs).collect()) == [("1", "a b"), ("None", "c")]


def test_near_fingerprints_are_candidates(spark):
    """SimHash finds what no band does; a set without shingles isn't linked."""
    rows = [(5, 3, 0b1000, [1]), (7, 3, 0b1011, [2]), (9, 3, -1, [3]), (11, 3, 0b1011, [4]), (2, 0, 0b1000, []), (20, 4, 0x0F0F0F0F0F0F0F0F, [3])]
    links = shingles.candidate_links(spark.createDataFrame(rows, "set_key long, n long, fingerprint long, bands array<long>"))
    assert sorted(map(tuple, links.collect())) == [(7, 5), (11, 5), (20, 9)]
    text = "one two three four five six"
    got = shingles.sketches(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["fingerprint"]
    assert got % (1 << 64) == simhash.simhash(text.encode(), 5)
