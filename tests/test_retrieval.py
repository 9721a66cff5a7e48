"""Ranking, fusion, union and expansion against plain Python on small fixtures."""

import contextlib
import io
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from snaptext.checks import bindings
from snaptext.operators import expansion, fusion, lexical, neighbours, phrases, vectors
from snaptext.plans import retrieval

CORPUS = [
    ("1", 0, "Back office", "the rules of the back-office and the desk"),
    ("2", 0, "Desk", "the desk is in the office"),
    ("3", 0, "Garden", "the tree and the grass"),
    ("3", 1, "Garden", "the flowers"),
    ("4", 0, "Empty", "the"),
]


def tokens(text):
    import re

    low = text.lower()
    return re.findall("[a-z0-9]+", low) + [a + b for a, b in re.findall("([a-z0-9]+)-([a-z0-9]+)", low)]


def plain_bm25(corpus, query, weight=8):
    docs = {(e, i): tokens((title + " ") * weight + text) for e, i, title, text in corpus}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    average = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * average for t, v in idf.items()}
    scores = {}
    for key, doc in docs.items():
        if set(query) & set(doc):
            scores[key] = round(
                sum(
                    idf.get(t, 0) * doc.count(t) * 2.5 / (doc.count(t) + 1.5 * (0.25 + 0.75 * len(doc) / mean))
                    for t in query
                ),
                6,
            )
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


@pytest.fixture(scope="module")
def index(spark):
    chunks = spark.createDataFrame(CORPUS, "entity_id string, chunk_index int, title string, text string")
    return lexical.build_index(chunks)


def queries(spark, texts):
    return spark.createDataFrame([(f"q{i}", 0, t) for i, t in enumerate(texts)], "query_id string, sub_no int, text string")


TEXTS = ["the desk desk", "back-office", "unknown words", "flowers of the garden", "office"]


@pytest.mark.parametrize("block", [1, 64])
def test_bm25(spark, block):
    index = lexical.build_index(spark.createDataFrame(CORPUS, "entity_id string, chunk_index int, title string, text string"), block=block)
    got = {}
    for r in lexical.lexical_hits(index, queries(spark, TEXTS), 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], (r["entity_id"], r["chunk_index"]), r["score"]))
    for i, text in enumerate(TEXTS):
        want = [(n, key, score) for n, (key, score) in enumerate(plain_bm25(CORPUS, tokens(text))[:3], 1)]
        found = sorted(got.get(f"q{i}", []))
        assert [(n, k) for n, k, _ in found] == [(n, k) for n, k, _ in want]
        assert np.allclose([s for *_, s in found], [s for *_, s in want], atol=2e-6)
    index.drop()


def test_a_term_without_weight_still_matches(spark):
    """A term in exactly half of the chunks has no weight, yet its chunks still match."""
    rows = [("1", 0, "t", "alpha beta"), ("2", 0, "t", "alpha"), ("3", 0, "t", "gamma"), ("4", 0, "t", "delta")]
    index = lexical.build_index(spark.createDataFrame(rows, "entity_id string, chunk_index int, title string, text string"))
    assert lexical.lexical_hits(index, queries(spark, ["alpha", "alpha gamma", "beta"])).count() == 6


@pytest.fixture(scope="module")
def uneven(spark):
    """A word in every chunk, common words, rare ones; a third of all chunks in one entity."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1500):
        body = ["every"] + [f"w{int(x)}" for x in rng.zipf(1.3, 40) if x < 400] * int(rng.integers(1, 3))
        rows.append(("1" if i % 3 == 0 else str(i), i, f"t{i % 7}", " ".join(body)))
    chunks = spark.createDataFrame(rows, "entity_id string, chunk_index int, title string, text string")
    return lexical.build_index(chunks, shards=2, block=8)


ASKED = ["w300", "every w200", "w1 w250 w2", "every w1 w2 w3", "w90 w90 w91 t3", "nothing", "t5 w7"]


def skipped(index, asked, n, shape=(8, 1.5, 0.75)):
    weights, _ = lexical._numbered(lexical.term_weights(index, lexical.query_terms(asked), 0.25, lexical._bound(index, *shape)))
    needed = lexical.needed_blocks(index, weights, n, True, *shape).count()
    return 1 - needed / lexical._matches(index, weights, True, *shape).count()


@pytest.mark.parametrize("title_weight", [8, 1])
def test_skipped_blocks_change_nothing(spark, uneven, title_weight):
    asked = queries(spark, ASKED)
    order = [F.desc("score"), F.asc("entity_id"), F.asc("chunk_index")]
    full = lexical.scores(uneven, lexical.query_terms(asked), title_weight).withColumn("score", F.round("score", 6))
    full = lexical.first_n(full, 5, lexical.QUERY_KEYS, order)
    hits = lexical.lexical_hits(uneven, asked, 5, title_weight=title_weight)
    key = lambda r: (r["query_id"], r["rank"], r["entity_id"], r["chunk_index"], round(r["score"], 5))
    assert sorted(map(key, full.collect())) == sorted(map(key, hits.collect())) and hits.count() == 30


@pytest.mark.parametrize("title_weight", [8, 1])
def test_most_blocks_of_a_common_word_are_skipped(spark, uneven, title_weight):
    """What other words may add keeps blocks in, so that longer questions skip fewer."""
    shape = (title_weight, 1.5, 0.75)
    assert skipped(uneven, queries(spark, ["w1"]), 5, (8, 1.5, 0.75)) > 0.5
    assert skipped(uneven, queries(spark, ["w1", "w2"]), 5, shape) >= skipped(uneven, queries(spark, ["w1 w2", "w2 w3"]), 5, shape) >= 0


def test_blocks_are_summed_in_arrays(spark, uneven, monkeypatch):
    """No row per query and posting; a batch that meets the parts in several groups gets the same."""
    asked = queries(spark, ASKED)
    key = lambda r: (r["query_id"], r["rank"], r["entity_id"], r["chunk_index"], round(r["score"], 5))
    hits = lexical.lexical_hits(uneven, asked, 5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate" not in plan
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)
    assert sorted(map(key, lexical.lexical_hits(uneven, asked, 5).collect())) == sorted(map(key, hits.collect()))


def test_parts_hold_the_postings_of_their_chunks(spark, monkeypatch):
    """Also of chunks with equal keys, without a key, a text or a title; vectors are those that postings give."""
    monkeypatch.setattr(lexical, "PART_CHUNKS", 2)
    rows = CORPUS + [("9", 0, "The title", "back-office desk"), ("9", 0, "The title", "desk Desk-top"), (None, 1, "t", "desk"), ("8", 0, None, "desk"), ("7", 0, "t", None), ("6", 0, "t", "")]
    index = lexical.build_index(spark.createDataFrame(rows, "entity_id string, chunk_index int, title string, text string"), shards=2, block=2)
    want = Counter()
    for entity, at, title, text in rows:
        if title is not None and text is not None:
            body, heading = tokens(text), tokens(title)
            want.update((entity, at, t, body.count(t), heading.count(t), len(body), len(heading)) for t in {*body, *heading})
    assert Counter(tuple(r) for r in index.postings.select("entity_id", "chunk_index", "term", "tf_body", "tf_title", "len_body", "len_title").collect()) == want
    assert index.blocks.agg(F.max("part")).first()[0] >= 4 and index.blocks.select("block_id").distinct().count() == index.blocks.count()
    idf = lexical.idf_table(index)
    one, other = vectors.chunk_vectors(index, idf), vectors.chunk_vectors(index.postings, idf)
    assert one.exceptAll(other).count() == 0 and one.count() == other.count() > len(CORPUS)
    index.drop()


def test_phrases_are_substrings(spark):
    rng = np.random.default_rng(5)
    texts = {i: "".join(rng.choice(list("aab c"), 30)) for i in range(40)} | {90: "", 91: None, 92: "in the end"}
    told = ["", None, "a", "in the end", "in the end of"] + ["".join(rng.choice(list("aab c"), n)) for n in range(1, 12) for _ in range(8)]
    df = spark.createDataFrame(list(texts.items()), "k int, text string")
    got = {tuple(r) for r in phrases.matches(df, ["k"], spark.createDataFrame([(p,) for p in told + told], "phrase string")).collect()}
    assert got == {(k, p) for k, t in texts.items() for p in told if t and p and p in t}


def test_a_hundred_thousand_phrases(spark):
    """The plan stays the same, also where a third of all phrases start alike."""
    n = F.col("id").cast("string")
    table = lambda size: spark.range(size).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("common beginning "), n)).otherwise(F.concat(F.lit("p"), n, F.lit("q"))).alias("phrase"))
    df = spark.createDataFrame([(1, "say p4711q and common beginning 99 twice"), (2, "common beginning 3"), (3, "nothing")], "k int, text string")
    assert {tuple(r) for r in phrases.matches(df, ["k"], table(100_000)).collect()} == {
        (1, "p4711q"), (1, "common beginning 99"), (1, "common beginning 9"), (2, "common beginning 3")
    }
    size = lambda k: len(phrases.matches(df, ["k"], table(k))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(100_000) - size(10)) < 50


def test_alias_tokens_count_again(spark):
    terms = lexical.query_terms(queries(spark, ["Cut the desk"]), {"cut the": ["desk", "off"], "no": ["x"]})
    assert {r["term"]: r["qtf"] for r in terms.collect()} == {"cut": 1, "the": 1, "desk": 2, "off": 1}


@pytest.mark.parametrize("metric", ["cosine", "squared_l2"])
def test_nearest_equals_brute_force_with_many_equal_distances(spark, metric):
    rng = np.random.default_rng(3)
    base = rng.integers(-2, 3, size=(12, 4)).astype(float)
    corpus = np.vstack([base, np.repeat(base[:1], 30, axis=0)])  # a third and more are copies
    asked = np.vstack([base[:3], np.zeros((1, 4))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id int, vector array<float>").repartition(5)
    qs = spark.createDataFrame([(f"q{i}", 0, v.tolist()) for i, v in enumerate(asked)], "query_id string, sub_no int, vector array<float>")
    got = {}
    for r in neighbours.nearest(qs, neighbours.build(rows, ["id"], metric), 6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["distance"]))
    for i, q in enumerate(asked):
        scored = []
        for j, c in enumerate(corpus):
            if metric == "squared_l2":
                scored.append((float(q @ q + c @ c - 2 * (q @ c)), j))
            elif (q @ q) * (c @ c) > 0:
                scored.append((max(0.0, 1.0 - (q @ c) / math.sqrt((q @ q) * (c @ c))), j))
        want = [(n, j, d) for n, (d, j) in enumerate(sorted(scored)[:6], 1)]
        assert sorted(got.get(f"q{i}", [])) == want


def clustered(spark, n=900, clusters=12, seed=4):
    rng = np.random.default_rng(seed)
    base = 4 * rng.normal(size=(clusters, 16))
    rows = base[rng.integers(0, clusters, n)] + 0.2 * rng.normal(size=(n, 16))
    rows[: n // 3] = rows[0]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id int, vector array<float>")
    return rows.astype(np.float32).astype(float), corpus, asked(corpus, 20)


def asked(corpus, every):
    return corpus.where(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("string").alias("query_id"), F.lit(0).alias("sub_no"), "vector")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(int(r["query_id"]), []).append(r["vec_id"])
    return out


@pytest.mark.parametrize("metric,block,parts", [("squared_l2", 8192, 8192), ("cosine", 64, 8192), ("squared_l2", 50, 9)])
def test_exact_search_of_clusters_skips_lists(spark, monkeypatch, metric, block, parts):
    """A third of all rows are equal, so that their list has many blocks; most lists are never visited."""
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", parts)
    rows, corpus, queries = clustered(spark)
    index = neighbours.build(corpus, ["vec_id"], metric, block=block)
    got = found(neighbours.nearest(queries, index, 5, digits=6))
    if metric == "cosine":
        unit = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
        d = np.round(np.maximum(1 - unit @ unit.T, 0), 6)
    else:
        d = np.round(((rows[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2), 6)
    assert got == {q: np.argsort(d[q], kind="stable")[:5].tolist() for q in range(0, 900, 20)}
    near = neighbours._prepared(queries, ["query_id", "sub_no"], index.unit)
    near = neighbours._coded(near, index.scale)
    first = neighbours.nearest(queries, index, 5, digits=6, first_lists=7)
    beyond = neighbours._visits(*neighbours._bounded(near, index, first, 5, 7, 6))
    assert beyond.count() + 7 * 45 < 0.3 * 45 * index.n_lists


def test_search_of_nothing(spark):
    rows, corpus, queries = clustered(spark, 60)
    empty = neighbours.build(corpus.limit(0), ["vec_id"])
    assert neighbours.nearest(queries, empty, 3).count() == 0 and neighbours.nearest_approx(queries, empty, 3).count() == 0
    index = neighbours.build(corpus.unionByName(spark.createDataFrame([(999, None), (998, [0.0] * 16)], corpus.schema)), ["vec_id"])
    assert neighbours.nearest(queries.limit(0), index, 3).count() == 0
    assert {r["vec_id"] for r in neighbours.nearest(queries, index, 70).collect()} == set(range(60))
    index.drop()


def recall(spark, folder, **kw):
    """Recall at 10 for the ids divisible by 20 against all rows, and the share of pairs whose codes are compared."""
    from snaptext.checks.bindings import data

    d = data(spark, folder)
    queries, index = asked(d.vector_rows(), 20), d.unit_vectors
    exact, near = found(neighbours.nearest(queries, index, 10)), found(neighbours.nearest_approx(queries, index, 10, **kw))
    hits = sum(len(set(exact[q]) & set(near[q])) for q in exact)
    return hits / sum(map(len, exact.values())), neighbours.probe_count(index, kw.get("probes", 0.6)) / index.n_lists


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_almost_random_vectors(spark, folder):
    got, share = recall(spark, f"/root/testdata/{folder}")
    assert got >= 0.9 and share <= 0.61, (got, share)


def test_recall_of_clusters_from_few_lists(spark):
    rows, corpus, queries = clustered(spark)
    index = neighbours.build(corpus, ["vec_id"])
    exact, near = found(neighbours.nearest(queries, index, 5, digits=6)), found(neighbours.nearest_approx(queries, index, 5, probes=0.15, rerank=8))
    hits = sum(len(set(exact[q]) & set(near[q])) for q in exact)
    assert hits >= 0.9 * 5 * len(exact)


def test_centroids(spark):
    rng = np.random.default_rng(8)
    points = rng.integers(-127, 128, (300, 4)).astype(float)
    first, last = neighbours.fit_centroids(points, 7, rounds=0), neighbours.fit_centroids(points, 7, rounds=5)
    spread = lambda c: ((points[:, None, :] - c[None, :, :]) ** 2).sum(axis=2).min(axis=1).sum()
    assert (first == points[:7]).all() and spread(last) < spread(first) and (last == np.floor(last)).all()
    one = neighbours.fit_centroids(points, 7, rounds=1)
    nearest = ((points[:, None, :] - points[None, :7, :]) ** 2).sum(axis=2).argmin(axis=1)
    assert all((one[k] == np.floor(points[nearest == k].mean(axis=0))).all() for k in range(7))
    assert neighbours.fit_centroids(np.zeros((0, 0)), 0).shape == (0, 0)


def test_vectors_are_the_same_each_time_and_unit_length_when_scaled(spark, index):
    idf = lexical.idf_table(index)
    one, other = vectors.chunk_vectors(index.postings, idf), vectors.chunk_vectors(index.postings.repartition(3), idf)
    assert one.exceptAll(other).count() == 0
    unit = vectors.unit_vector(F.col("vector"))
    norms = one.select(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-6 for r in norms)


def ranked(spark, rows, distance=False):
    schema = "query_id string, sub_no int, rank int, entity_id string, chunk_index int"
    return spark.createDataFrame(rows, schema + (", distance double" if distance else ""))


def test_fusion(spark):
    a = [("q", 0, 1, "x", 0), ("q", 0, 2, "y", 0), ("p", 0, 1, "x", 0)]
    b = [("q", 0, 1, "z", 0), ("q", 0, 2, "x", 0)]
    fused = fusion.reciprocal_rank([ranked(spark, a), ranked(spark, b)])
    rows = [(r["query_id"], r["rank"], r["entity_id"]) for r in fused.orderBy("query_id", "rank").collect()]
    assert rows == [("p", 1, "x"), ("q", 1, "x"), ("q", 2, "z"), ("q", 3, "y")]
    single = fusion.reciprocal_rank([ranked(spark, a)]).where("query_id = 'q'").orderBy("rank").collect()
    assert [r["entity_id"] for r in single] == ["x", "y"]
    tie = fusion.reciprocal_rank([ranked(spark, a[:1]), ranked(spark, [("q", 0, 1, "a", 0)])]).orderBy("rank").collect()
    assert [r["entity_id"] for r in tie] == ["x", "a"]  # first seen first


def test_hybrid_demotes_but_does_not_remove(spark):
    vec = ranked(spark, [("q", 0, 1, "x", 0, 0.1), ("q", 0, 2, "y", 0, 0.2)], True)
    lex = ranked(spark, [("q", 0, 1, "z", 0)])
    demoted = spark.createDataFrame([("x",), ("other",)], "entity_id string")
    rows = fusion.hybrid_hits(vec, lex, demoted, k=3).orderBy("rank").collect()
    assert [(r["entity_id"], r["distance"]) for r in rows] == [("z", None), ("y", 0.2), ("x", 0.1)]
    assert [r["entity_id"] for r in fusion.hybrid_hits(vec, lex, demoted, k=2).orderBy("rank").collect()] == ["z", "y"]


def test_round_robin_union(spark):
    lists = {0: "abc", 1: "ad", 2: "efgh"}
    rows = [("q", s, i, e, 0, None) for s, found in lists.items() for i, e in enumerate(found, 1)]
    hits = ranked(spark, rows, True)
    got = [r["entity_id"] for r in fusion.round_robin(hits, 4).orderBy("rank").collect()]
    assert got == ["a", "e", "b", "d"]
    assert fusion.union_truncated(hits, 4).first()["truncated"] is True
    assert fusion.union_truncated(hits, 8).first()["truncated"] is False


def test_subquery_list(spark):
    asked = spark.createDataFrame([("q", "Back billing rules", True), ("n", "Back billing", False)], "query_id string, text string, is_broad boolean")
    told = lambda hints: fusion.hint_subqueries(asked, *fusion.hint_tables(spark, hints))
    assert told([]).count() == 0
    assert told([([], ["x"]), (["billing"], [])]).count() == 0
    hints = told([(["billing", "other"], ["Time limits", "TIME LIMITS"]), (["prices"], ["x"])])
    assert [(r["query_id"], r["text"]) for r in hints.collect()] == [("q", "Time limits")]
    planned = spark.createDataFrame(
        [("q", i, t) for i, t in enumerate(["time limits", " ", "a", "b", "c", "d", "e", "f"])], "query_id string, plan_no int, text string"
    )
    rows = fusion.assemble_subqueries(asked, hints, planned).where("query_id = 'q'").orderBy("sub_no").collect()
    assert [r["text"] for r in rows] == ["Back billing rules", "Time limits", "a", "b", "c", "d", "e"]


def test_expansion_rules(spark):
    sizes = {"s3": 3, "m8": 8, "m9": 9, "l30": 30, "l31": 31}
    rows = [("now", e, i) for e, n in sizes.items() for i in range(n)] + [("old", "l31", i) for i in range(40)]
    chunks = spark.createDataFrame(rows, "snapshot string, entity_id string, chunk_index int")
    union = spark.createDataFrame(
        [("q", 1, "l31", 0), ("q", 2, "l30", 5), ("q", 3, "m9", 8), ("q", 4, "m8", 1), ("q", 5, "s3", 0), ("q", 6, "gone", 0)]
        + [("p", 1, "l31", 30), ("r", 1, "l31", 3)],
        "query_id string, rank int, entity_id string, chunk_index int",
    )
    served = union.select("query_id", "entity_id").distinct().withColumn(
        "snapshot", F.when(F.col("entity_id") == "gone", None).when(F.col("query_id") == "r", "old").otherwise("now")
    )
    got = {}
    for r in expansion.wanted_chunks(union, served, chunks, "now").collect():
        got.setdefault((r["query_id"], r["entity_id"]), []).append(r["chunk_index"])
    got = {k: sorted(v) for k, v in got.items()}
    assert got == {
        ("q", "l31"): [0, 1],  # too long even for a strong entity
        ("q", "l30"): list(range(30)),
        ("q", "m9"): [7, 8],
        ("q", "m8"): list(range(8)),
        ("q", "s3"): [0, 1, 2],
        ("p", "l31"): [29, 30],
        ("r", "l31"): list(range(40)),  # an older snapshot is served whole
    }


@pytest.mark.parametrize("passage", ["alpha", "alpha beta", "pha be", "gamma delta epsilon", "lta epsilon zet"])
def test_passages_of_any_length_find_their_documents(spark, tmp_path, passage):
    from snaptext.checks.bindings import Data

    docs = [(1, "alpha beta gamma delta epsilon zeta"), (2, "nothing of it"), (3, "alphabet"), (4, "x")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {(r["query_id"], r["entity_id"]) for r in Data(spark, str(tmp_path)).gold().collect()}
    assert found == {("7", str(d)) for d, t in docs if passage in t}


def test_vectors_do_not_shuffle_postings(spark, uneven, monkeypatch):
    """However many terms there are: blocks get their weights by number, and only vectors move to their keys."""
    monkeypatch.setattr(vectors, "small_side", lambda df: df)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        vectors._part_vectors(uneven, lexical.idf_table(uneven), 64).explain("formatted")
    moved = re.findall(r"Exchange\nInput \[\d+\]: (.*)", out.getvalue())
    assert moved and not any("entries" in row or "tf_body" in row for row in moved)


def test_points_and_codes_are_made_in_arrays(spark):
    """The same as by expressions on each component, of vectors with and without a direction too."""
    nan, inf, rng = float("nan"), float("inf"), np.random.default_rng(3)
    rows = [[0.0, 0.0], [], None, [1.0, None], [nan, 1.0], [inf, 1.0], [3.0, -4.0, 12.0], *rng.normal(size=(50, 64)).tolist()]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id int, vector array<double>")
    made = neighbours._coded(neighbours._prepared(df, ["vec_id"], True), 127.0)
    point = vectors.unit_vector(F.col("vector"))
    scaled = F.transform(point, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x * 127.0 + 0.5))).cast("int"))
    want = df.select("vec_id", point.alias("point"), scaled.alias("code")).where("point is not null")
    assert sorted(map(str, made.select("vec_id", "point", "code").collect())) == sorted(map(str, want.collect()))
    assert "transform(" not in made._jdf.queryExecution().optimizedPlan().toString()
    plain = neighbours._coded(neighbours._prepared(df.where("vec_id <> 3"), ["vec_id"], False), 2.0).collect()
    assert {r["vec_id"]: r["code"] for r in plain if r["vec_id"] < 7} == {0: [0, 0], 1: [], 4: [0, 2], 5: [127, 2], 6: [6, -8, 24]}


def test_thresholds_read_first_blocks_only(spark, uneven):
    """And terms are counted without their postings."""
    weights, _ = lexical._numbered(lexical.term_weights(uneven, lexical.query_terms(queries(spark, ASKED)), 0.25, lexical._bound(uneven, 8, 1.5, 0.75)))
    matches = lexical._matches(uneven, weights, True, 8, 1.5, 0.75)
    first = lexical._summed(uneven, matches.where("block_no = 0"), weights, True, len(ASKED), 5, 8, 1.5, 0.75, "block_no = 0")
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter [^\n]*block_no[^\n]*= 0[^\n]*\n[^\n]*Relation[^\n]*chunk_no", plan)
    assert uneven.blocks.where("n <> size(chunk_no)").count() == 0


def test_parts_follow_chunks_not_shuffle_partitions(spark):
    """A term costs a row in each part that it is in, so many shuffle partitions must not make many parts."""
    chunks = spark.createDataFrame([(str(i), 0, "t", f"word w{i}") for i in range(200)], "entity_id string, chunk_index int, title string, text string")
    index = lexical.build_index(chunks, shards=50)
    most = lexical.PARTS * spark.sparkContext.defaultParallelism
    assert index.blocks.select("part").distinct().count() <= most and index.blocks.where("term = 'word'").count() <= most
    index.drop()


def test_counts_of_a_block_are_bytes(spark, uneven):
    """Of large counts too; without a posting there are none."""
    assert {t for c, t in uneven.blocks.dtypes if c in lexical.COUNTS} == {"binary"}
    rows = [("1", 0, "t", "much " * 70_000), ("2", 0, "t t", "little")]
    index = lexical.build_index(spark.createDataFrame(rows, "entity_id string, chunk_index int, title string, text string"))
    got = {(r["entity_id"], r["term"]): (r["tf_body"], r["tf_title"], r["len_body"], r["len_title"]) for r in index.postings.collect()}
    assert got == {("1", "much"): (70_000, 0, 70_000, 1), ("1", "t"): (0, 1, 70_000, 1), ("2", "t"): (0, 2, 1, 2), ("2", "little"): (1, 0, 1, 2)}
    index.drop()
    empty = lexical.build_index(spark.createDataFrame([], "entity_id string, chunk_index int, title string, text string"))
    assert empty.postings.count() == 0
    empty.drop()


def test_lexical_lists_need_no_vectors(spark, uneven, monkeypatch):
    """They are made once, when vector lists are asked for."""
    built = []
    monkeypatch.setattr(retrieval.vectors, "chunk_vectors", lambda *a, f=vectors.chunk_vectors: built.append(1) or f(*a))
    tables = retrieval.SearchTables(spark.range(0), "now", uneven)
    lists = retrieval.search(tables, queries(spark, ASKED), n=5)
    assert lists.lexical.count() == 30 and not built
    assert lists.vector.where("rank > 5").count() == 0 and lists.vector.count() > 0 and built == [1]
    tables.neighbours.drop()


def test_gold_looks_for_the_words_asked_for_only(spark):
    docs = spark.createDataFrame([("1", "a bb\nbb c"), ("2", None), ("3", "bbc  c"), ("1", "c")], "entity_id string, text string")
    asked = spark.createDataFrame([("bb",), ("c",), ("c",), ("x",)], "word string")
    found = sorted(map(tuple, bindings._distinct_words(docs, asked).collect()))
    assert found == [("1", "bb"), ("1", "c"), ("1", "c"), ("3", "c")]


def test_timeline_of_documents_is_made_once(spark):
    d = bindings.Data(spark, SMALL)
    assert d.document_timeline() is d.document_timeline()
    assert "Window" not in d.document_timeline()._jdf.queryExecution().executedPlan().toString()
