"""Dates, changes, diffs and grading against plain Python on small fixtures."""

import difflib
import itertools
import random
from datetime import date, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from snaptext import settings
from snaptext.checks.bindings import PROBE_DAYS, Data
from snaptext.functions import text as tx
from snaptext.operators import alignment, changes, evaluation, grounding, textdiff, timelines

D = date.fromisoformat


def timeline(spark, starts, about=()):
    rows = [(e, D(s), 0, snap, f"note {snap}") for e, s, snap in starts]
    changed = spark.createDataFrame(rows, "entity_id string, start date, seq int, snapshot string, note string")
    known = spark.createDataFrame(list(about), "entity_id string, title string, introduced date")
    return timelines.build_timeline(changed, known)


@pytest.fixture
def line(spark):
    return timeline(
        spark,
        [("two", "2020-01-01", "a"), ("two", "2021-01-01", "b"), ("one", "2020-06-01", "a"),
         ("three", "2019-01-01", "a"), ("three", "2020-01-01", "b"), ("three", "2021-01-01", "c")],
        [("three", "Three", D("2019-01-01")), ("two", "Two", None)],
    )


def probe(spark, line, *pairs):
    probes = spark.createDataFrame([(e, D(d)) for e, d in pairs], "entity_id string, as_of date")
    return timelines.as_of(line, probes)


def test_boundaries_are_half_open(spark, line):
    found = probe(spark, line, ("two", "2019-12-31"), ("two", "2020-01-01"), ("two", "2020-12-31"), ("two", "2021-01-01"), ("new", "2021-01-01"))
    got = {(r["entity_id"], str(r["as_of"])): (r["state"], r["seg"] and r["seg"]["snapshot"]) for r in found.collect()}
    assert got == {
        ("two", "2019-12-31"): ("TOO_EARLY", None), ("two", "2020-01-01"): ("IN_FORCE", "a"),
        ("two", "2020-12-31"): ("IN_FORCE", "a"), ("two", "2021-01-01"): ("IN_FORCE", "b"), ("new", "2021-01-01"): ("UNMAPPED", None),
    }


def test_as_of_equals_interval_search(spark):
    rng = random.Random(1)
    day = lambda: date(2020, 1, 1) + timedelta(days=rng.randint(0, 60))
    rows = [(rng.choice("aaaab"), day(), i, f"s{i}", "n") for i in range(80)]
    changed = spark.createDataFrame(rows, "entity_id string, start date, seq int, snapshot string, note string")
    pairs = [(rng.choice("abc"), day()) for _ in range(120)]
    probes = spark.createDataFrame(pairs, "entity_id string, as_of date")
    got = {(r["entity_id"], r["as_of"]): r for r in timelines.as_of(timelines.build_timeline(changed), probes).collect()}
    assert sum(r["n_probes"] for r in got.values()) == 120
    for e, d in pairs:
        before = [r for r in rows if r[0] == e and r[1] <= d]
        want = max(before, key=lambda r: (r[1], r[2]))[3] if before else None
        assert (got[e, d]["seg"] and got[e, d]["seg"]["snapshot"]) == want


def test_served_snapshot_and_clamping(spark, line):
    found = probe(spark, line, ("three", "2018-01-01"), ("two", "2018-01-01"), ("none", "2018-01-01"), ("one", "2018-01-01"), ("three", "2020-05-01"), ("three", "2022-01-01"))
    served = {(r["entity_id"], r["as_of"].year): r["served"] for r in timelines.served_snapshot(found, "now").collect()}
    assert served == {("three", 2018): "now", ("two", 2018): None, ("none", 2018): "now", ("one", 2018): None, ("three", 2020): "b", ("three", 2022): "c"}
    change = {(r["entity_id"], r["as_of"].year): (r["served_idx"], r["change_idx"], str(r["change_date"])) for r in timelines.bracketed_change(found).collect()}
    assert change == {
        ("three", 2018): (0, 1, "2020-01-01"), ("two", 2018): (0, 1, "2021-01-01"), ("none", 2018): (None, None, "None"),
        ("one", 2018): (0, None, "None"), ("three", 2020): (1, 1, "2020-01-01"), ("three", 2022): (2, 2, "2021-01-01"),
    }


def test_gaps_and_overlaps_are_seen(spark, line):
    rows = [("ok", "2020-01-01", "2021-01-01"), ("ok", "2021-01-01", None), ("gap", "2020-01-01", "2020-06-01"), ("gap", "2021-01-01", None),
            ("over", "2020-01-01", "2021-06-01"), ("over", "2021-01-01", None), ("open", "2020-01-01", None), ("open", "2021-01-01", None)]
    segs = spark.createDataFrame([(e, D(a), b and D(b)) for e, a, b in rows], "entity_id string, start date, end date")
    got = {r["entity_id"]: (r["n_gaps"], r["n_overlaps"], r["contiguous"]) for r in timelines.gap_check(segs).collect()}
    assert got == {"ok": (0, 0, True), "gap": (1, 0, False), "over": (0, 1, False), "open": (0, 1, False)}
    assert timelines.gap_check(line).where("NOT contiguous").count() == 0


def test_history_and_comparison_name_the_same_change(spark, line):
    days = [f"{y}-06-01" for y in range(2017, 2024)]
    found = probe(spark, line, *itertools.product(["one", "two", "three"], days))
    none = spark.createDataFrame([], "entity_id string, title string, introduced date")
    views = timelines.history_view(found, none)
    sides = timelines.compare_versions(found, line).select("entity_id", "as_of", F.col("change_date").alias("compared"))
    both = views.join(sides, ["entity_id", "as_of"], "left").collect()
    assert len(both) == 21
    assert all(r["change_date"] == r["compared"] for r in both)
    assert {r["entity_id"] for r in both if r["compared"] is None} == {"one"}
    latest = {r["entity_id"]: r["new_in_force"] for r in timelines.compare_latest(line).collect()}
    assert latest == {"two": "from 1 January 2021 (current)", "three": "from 1 January 2021 (current)"}


def test_scope_note_only_for_the_past(spark):
    df = spark.createDataFrame([(D("2020-01-01"),), (D("2023-01-01"),)], "d date")
    notes = [r[0] for r in df.select(timelines.scope_note(F.col("d"), F.lit("2023-01-01").cast("date"), F.lit("4A"), "x")).collect()]
    assert notes[0].startswith("As of 1 January 2020") and notes[1] is None


TEXTS = ["a" * 30, "a" * 30 + "b", "c" * 40]


def plain_class(texts):
    present = [t is not None and len(t) >= 30 for t in texts]
    pattern = "".join("01"[p] for p in present)
    n = sum(present[i - 1] and present[i] and texts[i] != texts[i - 1] for i in range(1, len(texts)))
    runs = len([x for x in pattern.split("0") if x])
    if runs == 0:
        return "EMPTY", n
    if runs > 1:
        return "ANOMALY", n
    if "0" not in pattern:
        return ("STABLE", "SINGLE-CHANGE", "MULTI-CHANGE")[min(n, 2)], n
    return {("0", "1"): "INTRODUCED", ("1", "0"): "REMOVED", ("0", "0"): "TRANSIENT"}[pattern[0], pattern[-1]], n


@pytest.mark.parametrize("size", [7, 4096])
def test_classes_of_all_patterns(spark, size):
    """All presence patterns over four snapshots, with texts cut into small and large blocks."""
    choices = [None, "short", *TEXTS]
    cases = dict(enumerate(itertools.product(choices, repeat=4)))
    rows = [(str(e), i, t) for e, ts in cases.items() for i, t in enumerate(ts) if t is not None]
    texts = spark.createDataFrame(rows, "entity_id string, idx int, text string")
    got = {r["entity_id"]: (r["class"], r["n_changes"]) for r in changes.classify(changes.blocks_of_texts(texts, size), 4).collect()}
    assert got == {str(e): plain_class(ts) for e, ts in cases.items() if any(t is not None for t in ts)}
    pieces = texts.select("entity_id", "idx", F.posexplode(F.split("text", "(?<=.)")).alias("place", "piece"))
    other = {r["entity_id"]: (r["class"], r["n_changes"]) for r in changes.classify(changes.blocks_of_pieces(pieces, size), 4).collect()}
    assert other == got


@pytest.mark.parametrize("n", [70, 200])
def test_classes_over_many_snapshots(spark, n):
    rng = random.Random(n)
    spans = {"late": (n - 4, n), "early": (0, 3), "middle": (5, n - 5), "all": (0, n)}
    cases = {e: [TEXTS[rng.randrange(3)] if a <= i < b else None for i in range(n)] for e, (a, b) in spans.items()}
    cases["one"] = [TEXTS[0]] * (n - 1) + [TEXTS[2]]
    cases["twice"] = [TEXTS[0] if i in (1, n - 2) else None for i in range(n)]
    cases["short"] = ["x"] * n
    cases["same"] = [TEXTS[1]] * n
    rows = [(e, i, t) for e, ts in cases.items() for i, t in enumerate(ts) if t is not None]
    texts = spark.createDataFrame(rows, "entity_id string, idx int, text string").repartition(5)
    got = {r["entity_id"]: r for r in changes.classify(changes.blocks_of_texts(texts, 32), n).collect()}
    for e, ts in cases.items():
        present = [t is not None and len(t) >= 30 for t in ts]
        assert (got[e]["class"], got[e]["n_changes"]) == plain_class(ts)
        assert got[e]["presence"] == "".join("01"[p] for p in present)
        assert got[e]["changed_intervals"] == [i for i in range(1, n) if present[i] and present[i - 1] and ts[i] != ts[i - 1]]
    assert (got["late"]["interval"], got["early"]["interval"], got["one"]["interval"]) == (n - 4, 3, None)
    grid = changes.presence_grid(changes.presence(changes.blocks_of_texts(texts, 32)), n)
    assert grid.count() == n * len(cases)
    assert grid.where("present and entity_id = 'late'").agg(F.min("idx")).first()[0] == n - 4


def test_texts_without_letters_are_empty(spark):
    pieces = spark.createDataFrame([("a", 0, 0, "--- !"), ("a", 1, 0, "..."), ("b", 0, 0, "x" * 40)], "entity_id string, idx int, place int, piece string")
    got = {r["entity_id"]: r["class"] for r in changes.classify(changes.blocks_of_pieces(pieces), 2).collect()}
    assert got == {"a": "EMPTY", "b": "REMOVED"}


def pairs(spark):
    rng = random.Random(2)
    old = [f"w{rng.randint(0, 30)}" for _ in range(400)]
    edits = {
        "same": old, "insert": old[:50] + ["new", "words"] + old[50:], "delete": old[:100] + old[110:],
        "replace": old[:20] + ["x"] * 3 + old[23:], "large": ["z"] * 200 + old, "empty": [],
    }
    return {k: (" ".join(old), " ".join(v)) for k, v in edits.items()}


def test_diffs(spark):
    cases = pairs(spark)
    df = spark.createDataFrame([(k, o, n) for k, (o, n) in cases.items()], "k string, old string, new string")
    for r in textdiff.diff_pairs(df, ["k"]).collect():
        old, new = cases[r["k"]]
        assert " ".join(s["text"] for s in r["old_side"]) == old
        assert " ".join(s["text"] for s in r["new_side"]) == new
        changed = sum(len(s["text"].split()) for s in r["diff"] if s["op"] in ("add", "del"))
        assert changed <= 140
        assert r["truncated"] == (r["k"] in ("large", "empty"))
        ops = [s["op"] for s in r["diff"]]
        assert ops == {
            "same": [], "insert": ["context", "add", "context"], "delete": ["context", "del", "context"],
            "replace": ["context", "del", "add", "context"], "large": ["add"], "empty": ["del"],
        }[r["k"]] or r["k"] in ("delete", "replace")
        assert all(len(s["text"].split()) <= 12 for s in r["diff"] if s["op"] == "context")


def plain_alignment(old, new):
    """Partners by position, round by round in plain loops."""
    partner = {}

    def gaps():
        cuts = sorted(partner.items()) + [(len(old), len(new))]
        i = j = 0
        for a, b in cuts:
            yield list(range(i, a)), list(range(j, b))
            i, j = a + 1, b + 1

    for step in textdiff.ROUNDS:
        for left, right in list(gaps()):
            if isinstance(step, str):
                for i, j in zip(left, right) if step == "start" else zip(left[::-1], right[::-1]):
                    if old[i] != new[j]:
                        break
                    partner[i] = j
            else:
                runs = [{}, {}]
                for side, at, ws in ((0, left, old), (1, right, new)):
                    for n in range(len(at) - step + 1):
                        runs[side].setdefault(tuple(ws[at[n] : at[n] + step]), []).append(at[n])
                once = sorted((p[0], runs[1][r][0]) for r, p in runs[0].items() if len(p) == 1 and len(runs[1].get(r, [])) == 1)
                for n, (i, j) in enumerate(once):
                    if all(b < j for _, b in once[:n]) and all(b > j for _, b in once[n + 1 :]):
                        partner[i] = j
    return partner


def random_pairs(n=60, seed=8):
    rng = random.Random(seed)
    out = {"nothing": ("", ""), "spaces": (" ", "\n"), "long": ("w " * 3000, "w " * 2990 + "x " * 300)}
    for i in range(n):
        old = [f"w{rng.randrange(rng.choice([3, 30, 300]))}" for _ in range(rng.randrange(60))]
        new = list(old)
        for _ in range(rng.randrange(6)):
            at, to = sorted(rng.randrange(len(new) + 1) for _ in range(2))
            new[at : at + rng.randrange(5)] = rng.choice([[], new[at:to][::-1], ["new"], old[at:to]])
        out[f"p{i}"] = (" ".join(old), " ".join(new))
    return out


def test_alignment_equals_plain_loops(spark):
    cases = random_pairs()
    df = spark.createDataFrame([(k, o, n) for k, (o, n) in cases.items()], "k string, old string, new string")
    got = {k: {} for k in cases}
    for r in textdiff.aligned(textdiff.pair_words(df, ["k"]), ["k"]).where("side = 0 and partner is not null").collect():
        got[r["k"]][r["pos"]] = r["partner"]
    for k, (old, new) in cases.items():
        assert got[k] == plain_alignment(old.split(), new.split()), k


def test_both_sides_are_the_texts(spark):
    cases = random_pairs()
    df = spark.createDataFrame([(k, o, n) for k, (o, n) in cases.items()], "k string, old string, new string")
    rows = {r["k"]: r for r in textdiff.diff_pairs(df, ["k"]).collect()}
    assert set(rows) == set(cases)
    for k, r in rows.items():
        for side, text, ops in (("old_side", cases[k][0], {"eq", "del"}), ("new_side", cases[k][1], {"eq", "add"})):
            assert " ".join(s["text"] for s in r[side]).split() == text.split() and {s["op"] for s in r[side]} <= ops
        changed = [w for s in r["diff"] if s["op"] in ("add", "del") for w in s["text"].split()]
        full = sum(len(s["text"].split()) for side in ("old_side", "new_side") for s in r[side] if s["op"] != "eq")
        assert len(changed) == min(full, 140) and r["truncated"] == (full > 140)
        ops = [s["op"] for s in r["diff"]]
        assert "gap" not in ops[:1] + ops[-1:] and all(a != b for a, b in zip(ops, ops[1:]))


def test_one_shuffle_for_all_rounds(spark):
    df = spark.createDataFrame([("k", "a", "b")], "k string, old string, new string")
    text = textdiff.aligned(textdiff.pair_words(df, ["k"]), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1


def test_similarity(spark):
    cases = pairs(spark) | random_pairs() | {"letters": ("The offices are open", "The office is open"), "digit": ("x" * 60 + " 1", "x" * 60 + " 2")}
    df = spark.createDataFrame([(k, o, n) for k, (o, n) in cases.items()], "k string, old string, new string")
    got = {r["k"]: (r["similarity"], r["small_edit"]) for r in textdiff.similar_pairs(df, ["k"]).collect()}
    letters = {k: tuple(t.replace(" ", "").replace("\n", "").lower() for t in c) for k, c in cases.items()}
    assert set(got) == {k for k, (o, n) in letters.items() if o != n}
    for k, (similarity, small) in got.items():
        longest = difflib.SequenceMatcher(None, *letters[k], autojunk=False).ratio()
        assert 0 <= similarity <= 1 and small == (similarity >= 0.97) or abs(similarity - 0.97) < 1e-3
        if k in ("insert", "delete", "replace", "large", "letters", "digit"):
            assert similarity == pytest.approx(longest, abs=0.07)


def similarity_by_rows(pairs, keys):
    """Similarity from alignments with a row for each word and letter."""
    norm = pairs.select(*keys, "old", "new", tx.normalised(F.col("old")).alias("_old"), tx.normalised(F.col("new")).alias("_new"))
    changed = norm.where("_old <> _new")
    words = textdiff.aligned(textdiff.pair_words(changed, keys), keys).withColumn("letters", tx.normalised(F.col("word")))
    held = words.where("partner is not null and side = 0").groupBy(*keys).agg(F.sum(F.length("letters")).alias("n"))
    rest = words.where("partner is null").groupBy(*keys, "gap", "side").agg(F.array_sort(F.collect_list(F.struct("pos", "letters"))).alias("ws"))
    letters = rest.select(*keys, F.col("gap").alias("_gap"), "side", F.posexplode(F.split(F.array_join("ws.letters", ""), "")).alias("pos", "word")).where("word <> ''")
    inner = textdiff.aligned(letters, [*keys, "_gap"], (3, "start", "end")).where("partner is not null and side = 0")
    matched = held.unionByName(inner.groupBy(*keys).agg(F.count("*").alias("n"))).groupBy(*keys).agg(F.sum("n").alias("matched"))
    sized = changed.select(*keys, (F.length("_old") + F.length("_new")).alias("total")).join(matched, keys, "left")
    ratio = 2 * F.coalesce("matched", F.lit(0)) / F.col("total")
    return sized.select(*keys, F.round(ratio, 3).alias("similarity"), (ratio >= 0.97).alias("small_edit"))


def odd_pairs(spark):
    """Random pairs, blanks and letters of all kinds, and keys that repeat or are null."""
    rng = random.Random(5)
    rows = [(k, 0, o, n) for k, (o, n) in random_pairs(seed=6).items()] + [
        ("null", 0, None, "a"), ("null", 1, "a", None), ("blank", 0, "a\u00a0bc\u3000d\x1ce", "a bc d f"), ("marks", 0, "-- !", "a --"),
        ("case", 0, "A B \u212aelvin \u0130x Stra\u00dfe", "a b kelvin ix strasse"), ("accents", 0, "\u00e9t\u00e9 l\u00e0 bas", "ete la bas"), (None, 0, "a b c", "a b d"), (None, 0, "x y", "x z"),
    ]
    for k in range(20):
        old = "".join(rng.choice("abcdE -\n") for _ in range(rng.randrange(80)))
        new = "".join(rng.choice([c, c, c, c.upper(), "x", "", " "]) for c in old)
        rows += [("again", k, old, new)] * rng.choice([1, 2, 3])
    return spark.createDataFrame(rows, "k string, i int, old string, new string")


def test_similarity_over_arrays_equals_that_by_rows(spark):
    pairs = odd_pairs(spark)
    got, want = (sorted(map(str, f(pairs, ["k", "i"]).collect())) for f in (textdiff.similar_pairs, similarity_by_rows))
    assert len(got) > 70 and got == want


def test_similarity_has_no_row_for_a_word_or_letter(spark):
    """One sort by key, and no rows beside the pairs: time follows the letters, not the rounds of windows over their rows."""
    text = textdiff.similar_pairs(odd_pairs(spark), ["k", "i"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.count("Window [") == 1 and "Generate" not in text


def test_pairs_of_a_key_are_aligned_at_once(spark, monkeypatch):
    rows = odd_pairs(spark).where("old is not null and new is not null").orderBy("k", "i").toArrow().combine_chunks().to_pydict()
    of = list(zip(rows["k"], rows["i"]))
    table = pa.table(rows | {"first": [n == 0 or of[n] != of[n - 1] for n in range(len(of))]})

    def found(at_once, step):
        monkeypatch.setattr(alignment, "AT_ONCE", at_once)
        batches = list(alignment.similar_batches(["k", "i"], textdiff.ROUNDS, textdiff.LETTER_ROUNDS)(iter(table.to_batches(max_chunksize=step))))
        return len(batches), pa.Table.from_batches(batches).to_pylist()

    n, whole = found(1 << 30, 1000)
    assert n == 1 and len(whole) > 70
    for at_once, step in ((1, 1000), (1, 1), (300, 7)):
        n, parts = found(at_once, step)
        assert n > 10 and parts == whole


def test_citations(spark):
    answers = spark.createDataFrame(
        [("q", '{"refused": false, "obligations": [{"citations": [{"entity_id": "Condition 8 - x", "pages": "1-2"}, {"entity_id": "27A"}]},'
               ' {"citations": [{"entity_id": "8", "pages": "9"}, {"entity_id": "12.A"}]}, {"citations": []}]}')],
        "query_id string, answer_json string",
    )
    rows = grounding.flattened_citations(grounding.parsed_answers(answers)).orderBy("cite_no").collect()
    assert [(r["cite_no"], r["entity_id"], r["pages"]) for r in rows] == [(1, "8", "1-2"), (2, "27A", None), (3, "12.A", None)]


def test_grading(spark):
    cases = spark.createDataFrame(
        [("a", "answer", "Must", "s1", "text-change"), ("b", "answer", None, None, None),
         ("c", "refuse", None, None, None), ("d", "refuse", None, None, None), ("e", "answer", "x", "s1", None)],
        "query_id string, expected string, expect_contains string, expect_snapshot string, expect_history string",
    )
    gold = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("e", "9")], "query_id string, entity_id string")
    results = spark.createDataFrame(
        [("a", False, "they must"), ("b", True, None), ("c", True, None), ("d", False, "y"), ("e", False, "no")],
        "query_id string, refused boolean, answer string",
    )
    retrieved = spark.createDataFrame(
        [("a", 1, "7", "s1"), ("a", 2, "2", "s0"), ("a", 3, "1", "s1"), ("b", 4, "3", "s0"), ("d", 1, "3", "s0")],
        "query_id string, rank int, entity_id string, served string",
    )
    cited = spark.createDataFrame([("a", "2"), ("d", "3")], "query_id string, entity_id string")
    history = spark.createDataFrame(
        [("a", "2", "text-change", True), ("b", "3", "text-change", False), ("d", "3", "introduced", None)],
        "query_id string, entity_id string, kind string, consistent boolean",
    )
    graded = evaluation.graded_cases(cases, gold, results, retrieved, cited, history).cache()
    got = {r["query_id"]: tuple(r)[3:] for r in graded.collect()}
    assert got == {
        "a": (True, True, 2, True, True, True, True),
        "b": (False, True, 4, False, None, None, False),
        "c": (True, None, None, None, None, None, None),
        "d": (False, None, None, None, None, None, None),
        "e": (True, False, None, False, False, False, None),
    }
    assert evaluation.recall_at(graded).first().asDict() == {"n_answer": 3, "n_hit": 2, "recall_1": 0, "recall_3": 1, "recall_6": 2, "mean_rank": 3.0}
    summary = evaluation.summary(graded).first()
    assert (summary["decision_ok"], summary["citation_hit"], summary["snapshot_ok"], summary["history_ok"]) == ("3/5", "1/3", "1/2", "1/2")
    assert {r["query_id"]: r["outcome"] for r in evaluation.decision_lists(graded).collect()} == {"b": "false refusal", "c": "correct refusal", "d": "false answer"}


def test_core_recall(spark):
    core = spark.createDataFrame([("q", "1"), ("q", "2"), ("p", "4"), ("p", "4")], "query_id string, entity_id string")
    borderline = spark.createDataFrame([("q", "3"), ("q", "2")], "query_id string, entity_id string")
    surfaced = spark.createDataFrame([("x", "q", "1"), ("x", "q", "3"), ("x", "q", "8"), ("y", "q", "2")], "variant string, query_id string, entity_id string")
    rows = {(r["variant"], r["query_id"]): (r["n_core"], r["n_found"], r["n_noise"]) for r in evaluation.core_recall(core, borderline, surfaced, ["variant"]).collect()}
    assert rows == {("x", "q"): (2, 1, 1), ("x", "p"): (1, 0, 0), ("y", "q"): (2, 1, 0), ("y", "p"): (1, 0, 0)}
    missing = sorted((r["variant"], r["query_id"], r["entity_id"]) for r in evaluation.missing_core(core, surfaced, ["variant"]).collect())
    assert missing == [("x", "p", "4"), ("x", "q", "2"), ("y", "p", "4"), ("y", "q", "1")]
    assert evaluation.core_recall(core, borderline, surfaced.limit(0), ["variant"]).count() == 0


def test_a_question_with_very_many_gold_entities(spark):
    core = spark.range(300_000).select(F.lit("q").alias("query_id"), F.col("id").cast("string").alias("entity_id"))
    surfaced = core.where(F.col("entity_id").cast("long") % 3 == 0).withColumn("variant", F.lit("x"))
    df = evaluation.core_recall(core, core.limit(0), surfaced, ["variant"])
    assert tuple(df.first()) == ("x", "q", 300_000, 100_000, 0)
    assert "collect" not in df._jdf.queryExecution().executedPlan().toString()


def test_state_after_each_snapshot_equals_the_whole_run(spark):
    rng = random.Random(4)
    words = ["a long enough text about offices and desks", "a long enough text, about OFFICES and desks!", "another text that is long enough as well", "short", "", None]
    rows = [(f"e{e}", idx, rng.choice(words)) for e in range(60) for idx in range(5) if rng.random() < 0.8]
    texts = spark.createDataFrame(rows, "entity_id string, idx int, text string")
    state = None
    for idx in range(5):
        state = changes.add_snapshot(state, texts.where(F.col("idx") == idx), idx)
        whole = changes.classify(changes.blocks_of_texts(texts.where(F.col("idx") <= idx)), idx + 1)
        assert sorted(map(str, changes.classify_state(state, idx + 1).collect())) == sorted(map(str, whole.collect()))


def test_tasks_of_a_word_diff_do_not_grow_with_the_table(spark, monkeypatch):
    """More pairs go to more parts, and the diffs stay as they are."""
    rows = [(i, f"a b c w{i} d e f", f"a b x w{i} d f g") for i in range(12)]
    pairs = spark.createDataFrame(rows, "k int, old string, new string")
    want = sorted(map(str, textdiff.diff_pairs(pairs, ["k"]).collect()))
    few = textdiff.pair_words(pairs, ["k"]).rdd.getNumPartitions()
    monkeypatch.setattr(textdiff, "TASK_CHARS", 20)
    monkeypatch.setattr(textdiff, "TASK_WORDS", 10)
    assert textdiff.pair_words(pairs, ["k"]).rdd.getNumPartitions() > few
    assert sorted(map(str, textdiff.diff_pairs(pairs, ["k"]).collect())) == want


def test_timelines_have_as_many_tasks_as_their_rows_ask_for(spark, monkeypatch):
    """Probes are dealt out before they are counted, so that no task holds those of a whole file."""
    monkeypatch.setattr(settings, "TASK_ROWS", 10)
    days = [(str(i % 40), D("2020-01-01") + timedelta(days=i), i, "s", "n") for i in range(120)]
    changed = spark.createDataFrame(days, "entity_id string, start date, seq int, snapshot string, note string")
    probes = changed.select("entity_id", F.col("start").alias("as_of"))
    found = timelines.as_of(timelines.build_timeline(changed, rows=120), probes, rows=240)
    assert found.rdd.getNumPartitions() >= 24
    key = lambda df: sorted((r["entity_id"], r["as_of"], r["state"], r["n_probes"], r["seg"]["seg_idx"]) for r in df.collect())
    assert key(found) == key(timelines.as_of(timelines.build_timeline(changed), probes)) and found.count() == 120


def test_probes_of_customers_are_dealt_out_before_dates(spark, monkeypatch):
    monkeypatch.setattr(settings, "TASK_ROWS", 50)
    d = Data(spark, SMALL)
    assert d.customer_probes().rdd.getNumPartitions() >= d.rows("customer") * len(PROBE_DAYS) // 50
