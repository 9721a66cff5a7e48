"""Sections across pages, windows and the way back, in small blocks so that carrying is exercised."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from snaptext import scale
from snaptext.checks.bindings import Data
from snaptext.functions import text as tx
from snaptext.operators import chunking, sections
from snaptext.plans import ingest
from snaptext.sources import pages as page_source, published, tables


def plain_sections(pages):
    """Reading the pages in order, line by line."""
    out, current, outer = [], None, ""
    for page, text in sorted(pages):
        for line in (x.strip() for x in text.split("\n")):
            if not line or line.isdigit() and len(line) <= 3:
                continue
            if line.startswith("SECTION "):
                outer = line.split(":")[0]
            elif line.startswith("Condition "):
                head, title = line[10:].split(". ", 1)
                current = {"id": head, "title": title, "section": outer, "start": page, "end": page, "lines": []}
                out.append(current)
            elif current:
                current["lines"].append(line)
                current["end"] = page
    return out


def random_pages(seed, n_pages):
    rng = random.Random(seed)
    pages = []
    for page in range(1, n_pages + 1):
        lines = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.08:
                lines.append(f"SECTION {rng.choice('ABC')}: part")
            elif kind < 0.2:
                lines.append(f"Condition {rng.randint(1, 6)}{rng.choice(['', 'A'])}. Title {rng.randint(1, 99)}")
            elif kind < 0.3:
                lines.append(str(rng.randint(1, 999)))
            else:
                lines.append(" ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 60))))
        pages.append((page, "\n".join(lines)))
    return pages


@pytest.fixture(params=[1, 2])
def small_blocks(request, monkeypatch):
    """Carry over blocks of three pages."""
    real = scale.carry_forward
    small = lambda *a, **k: real(*a, **{**k, "block": 3})
    monkeypatch.setattr(sections, "carry_forward", small)
    monkeypatch.setattr(chunking, "carry_forward", small)
    return request.param


def test_sections_and_chunks_equal_reading_in_order(spark, small_blocks):
    by_snapshot = {"a": random_pages(small_blocks, 40), "b": random_pages(small_blocks + 10, 25)}
    rows = [(s, p, t) for s, pages in by_snapshot.items() for p, t in pages]
    pages = spark.createDataFrame(rows, page_source.PAGE_SCHEMA)
    registry = spark.createDataFrame([("a", 1), ("b", 4)], "snapshot string, body_start int")
    parsed = ingest.parse_pages(pages, registry, [])

    expected = {}
    for snapshot, start in (("a", 1), ("b", 4)):
        expected[snapshot] = plain_sections([(p, t) for p, t in by_snapshot[snapshot] if p >= start])
    want = sorted(
        (s, i, x["id"], x["title"], x["section"], x["start"], x["end"], len(x["lines"]))
        for s, found in expected.items()
        for i, x in enumerate(found, 1)
    )
    got = parsed.sections.select(
        "snapshot", "section_no", "entity_id", "title", "section", "page_start", "page_end", "n_lines"
    ).collect()
    assert sorted(map(tuple, got)) == want

    merged = {}
    for s, found in expected.items():
        for x in found:
            merged.setdefault((s, x["id"]), []).append(x)
    chunks = {}
    for r in ingest.chunk_pages(parsed).collect():
        chunks.setdefault((r["snapshot"], r["entity_id"]), {})[r["chunk_index"]] = r
    assert set(chunks) == set(merged)
    for key, parts in merged.items():
        words = " ".join(line for x in parts for line in x["lines"]).split()
        words = words or f"Condition {key[1]}: {parts[0]['title']}".split()
        windows = [words[i : i + 175] for i in range(0, max(len(words) - 25, 1), 150)]
        assert [chunks[key][i]["text"] for i in sorted(chunks[key])] == [" ".join(w) for w in windows]
        assert all(chunks[key][i]["n_words"] == len(w) for i, w in enumerate(windows))
        assert chunks[key][0]["title"] == parts[0]["title"]


def test_both_chunkers_agree(spark):
    rows = [("s", str(n), 1, i, f"w{i} x") for n in (0, 1, 87, 88, 163, 300) for i in range(n)]
    lines = spark.createDataFrame(rows, "snapshot string, entity_id string, page int, line_no int, line string")
    bodies = sections.section_bodies(lines, ["snapshot", "entity_id"])
    columns = ["snapshot", "entity_id", "chunk_index", "text", "n_words"]
    one = chunking.chunk_bodies(bodies).select(columns)
    other = chunking.chunk_lines(lines).select(columns)
    assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


@pytest.mark.parametrize("n", [1, 175, 176, 325, 326, 476])
def test_windows_and_rebuilding(spark, n):
    same = "word " * n
    other = " ".join(f"w{i}" for i in range(n))
    bodies = spark.createDataFrame(
        [("s", "same", same), ("s", "other", other)], "snapshot string, entity_id string, body string"
    )
    chunks = chunking.chunk_bodies(bodies)
    sizes = [r["n_words"] for r in chunks.where("entity_id = 'other'").orderBy("chunk_index").collect()]
    expected, start = [], 0
    while True:
        expected.append(min(175, n - start))
        if start + 175 >= n:
            break
        start += 150
    assert sizes == expected
    rebuilt = {r["entity_id"]: r["text"] for r in chunking.rebuilt_texts(chunks).collect()}
    assert rebuilt == {"same": same.strip(), "other": other}


def test_carry_forward_over_blocks(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xxxy"), i, rng.randint(1, 9), rng.choice([None, None, f"v{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, n int, v string")
    got = scale.carry_forward(df, ["k"], "i", {"before": F.col("n")}, {"last": F.col("v")}, block=7).collect()
    seen = {}
    for k, i, n, v in rows:
        total, last = seen.get(k, (0, None))
        row = next(r for r in got if r["i"] == i)
        assert (row["before"], row["last"]) == (total, last)
        seen[k] = (total + n, v if v is not None else last)


def test_page_files_and_snapshots(spark, tmp_path):
    pages = spark.createDataFrame(
        [("2020-01-01", 1, "a"), ("2020-01-01", 2, " "), ("2021-05-01", 1, "b")], page_source.PAGE_SCHEMA
    )
    path = str(tmp_path / "pages")
    page_source.write_pages(pages, path)
    page_source.write_pages(pages.where("snapshot = '2021-05-01'"), path)
    read = page_source.read_pages(spark, path)
    assert {(r["snapshot"], r["n_pages"], r["n_empty"]) for r in page_source.page_counts(read).collect()} == {
        ("2020-01-01", 2, 1), ("2021-05-01", 1, 0),
    }
    for name in ("rules-2021-05.txt", "rules-2019-08-03.txt", "notes.txt"):
        (tmp_path / "raw").mkdir(exist_ok=True)
        (tmp_path / "raw" / name).write_text("x")
    found = [str(r["date"]) for r in page_source.discover_snapshots(spark, str(tmp_path / "raw")).collect()]
    assert found == ["2019-08-03", "2021-05-01"]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "rules-2021-05.txt").write_text("x")
    with pytest.raises(ValueError):
        page_source.discover_snapshots(spark, str(tmp_path / "one"))


def test_rebuilding_the_chunk_table_twice_changes_nothing(spark, tmp_path):
    bodies = spark.createDataFrame(
        [("a", "1", "one two"), ("b", "1", "three")], "snapshot string, entity_id string, body string"
    )
    chunks = chunking.chunk_bodies(bodies)
    path = str(tmp_path / "chunks")
    tables.write_chunks(chunks, path)
    first = sorted(map(str, tables.read_chunks(spark, path).collect()))
    tables.write_chunks(chunks.where("snapshot = 'b'"), path)
    assert sorted(map(str, tables.read_chunks(spark, path).collect())) == first


@pytest.mark.parametrize("labels", [("01", "02"), ("2021-01-01", "2023-01-01")])
def test_snapshot_labels_survive_the_chunk_table(spark, tmp_path, labels):
    rows = [(s, "1", f"text of {s}") for s in labels]
    chunks = chunking.chunk_bodies(spark.createDataFrame(rows, "snapshot string, entity_id string, body string"))
    path = str(tmp_path / "chunks")
    tables.write_chunks(chunks, path)
    back = tables.read_chunks(spark, path)
    assert {r["snapshot"] for r in back.collect()} == set(labels)
    one = back.where(F.col("snapshot") == labels[0])
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(snapshot" in one._jdf.queryExecution().toString()


def test_pages_of_an_unknown_snapshot_are_an_error(spark):
    pages = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "snapshot string, page int, text string")
    registry = spark.createDataFrame([("a", 1)], "snapshot string, body_start int")
    assert sections.from_body_start(pages.where("snapshot = 'a'"), registry).count() == 1
    with pytest.raises(Exception, match="not in the registry: b"):
        sections.from_body_start(pages, registry).collect()


def test_new_snapshots_are_followed(spark, tmp_path):
    from snaptext.streaming.snapshots import follow_snapshots

    pages_path, chunks_path = str(tmp_path / "pages"), str(tmp_path / "chunks")
    registry = spark.createDataFrame([("a", 1), ("b", 1)], "snapshot string, body_start int")

    def arrive(snapshot, texts):
        rows = [(snapshot, i, t) for i, t in enumerate(texts, 1)]
        page_source.write_pages(spark.createDataFrame(rows, page_source.PAGE_SCHEMA), pages_path)
        query = follow_snapshots(spark, pages_path, chunks_path, str(tmp_path / "state"), registry, [])
        query.awaitTermination(120)
        assert query.exception() is None
        return {(r["snapshot"], r["entity_id"]): r["text"] for r in tables.read_chunks(spark, chunks_path).collect()}

    assert arrive("a", ["Condition 1. T\nfirst", "goes on"]) == {("a", "1"): "first goes on"}
    assert arrive("b", ["Condition 1. T\nother"]) == {("a", "1"): "first goes on", ("b", "1"): "other"}


def test_cases_read_with_missing_keys_as_null(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text('{"query_id": "a", "text": "q", "expected": "answer", "expect_entities": ["1"], "as_of": "2022-01-05"}\n'
                    '{"query_id": "b", "text": "r", "expected": "refuse"}\n')
    cases = {r["query_id"]: r for r in tables.read_cases(spark, str(path)).collect()}
    assert str(cases["a"]["as_of"]) == "2022-01-05" and cases["a"]["expect_contains"] is None
    assert cases["b"]["expect_entities"] is None
    tables.write_results(tables.read_cases(spark, str(path)).select("query_id", "expected"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_tables_are_published_where_they_are_asked_for(spark):
    """Pages without chunks, which nothing builds for them; both go to one folder."""
    d = Data(spark, SMALL)
    assert set(published.manifest(spark, d.published_pages)["tables"]) == {"pages"} and "chunks" not in vars(d)
    assert d.published_chunks().count() == d.chunks.count()
    assert set(published.manifest(spark, d.published)["tables"]) == {"pages", "chunks"}


def test_rebuilt_texts_meet_their_originals_in_one_grouping(spark):
    """Each original with the text of its entity; equal keys share the pieces, and without a chunk there is none."""
    bodies = [("s", "1", "a  b\u2003c"), ("s", "1", None), ("s", "2", "\x1c" + "w " * 400), (None, "3", "x"), ("s", None, "x"), ("s", "4", None), ("s", "5", "")]
    df = spark.createDataFrame(bodies, "snapshot string, entity_id string, body string")
    both = chunking.rebuilt_beside(chunking.chunk_bodies(df), df.select("snapshot", "entity_id", tx.single_spaced(F.col("body")).alias("original")))
    want = [("1", "a b c", "a b c"), ("1", "a b c", None), ("2", " ".join(["w"] * 400), " ".join(["w"] * 400)), ("5", "", "")]
    key = lambda r: (r[0], r[1], r[2] or "")
    assert sorted(map(tuple, both.select("entity_id", "text", "original").collect()), key=key) == sorted(want, key=key)
    assert "Join" not in both._jdf.queryExecution().optimizedPlan().toString()


def test_windows_are_cut_in_arrays(spark):
    """No expression per word, whatever the blanks."""
    texts = [f"a{blank}b" for blank in tx.BLANKS] + ["", " \u2003", "a" + tx.BLANKS + "b"]
    df = spark.createDataFrame([("s", str(i), t) for i, t in enumerate(texts)], "snapshot string, entity_id string, body string")
    chunks = chunking.chunk_bodies(df)
    assert "MapInArrow" in chunks._jdf.queryExecution().optimizedPlan().toString()
    assert {r["entity_id"]: (r["text"], r["n_words"]) for r in chunks.collect()} == {str(i): (" ".join(t.split()), len(t.split())) for i, t in enumerate(texts)}


def test_an_edition_that_goes_on_is_split_once(monkeypatch):
    rng = random.Random(3)
    bodies = ["", None, " "]
    for _ in range(200):
        body = "".join(rng.choice(["a", "bc", " ", "\n", "\u00a0"]) for _ in range(rng.randrange(60)))
        bodies += [body, body + rng.choice(["", " ", "x", "\nd e f", " g" * 20]), rng.choice([body[:-1], "z"])]
    said = []
    split = chunking.tx.split_words
    monkeypatch.setattr(chunking.tx, "split_words", lambda t: said.append(len(t)) or split(t))
    for size, overlap in ((7, 2), (3, 0), (175, 25)):
        want = [(i, [" ".join(b.split()[k : k + size]) for k in range(0, max(len(b.split()) - overlap, 1), size - overlap)], len(b.split())) for i, b in enumerate(bodies) if b is not None]
        assert list(chunking.windows(bodies, size, overlap)) == want
    said.clear()
    assert len(list(chunking.windows(["a b c", "a b c d", "a b c d e f"], 3, 1))) == 3 and sum(said) == len("a b c d e f")
