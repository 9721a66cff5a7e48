import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from snaptext.functions import text as tx
from snaptext.operators import lines


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in rows.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def python_tokens(text):
    low = text.lower()
    joined = [a + b for a, b in re.findall(r"([a-z0-9]+)-([a-z0-9]+)", low)]
    return re.findall(r"[a-z0-9]+", low) + joined


def test_tokens_join_hyphen_pairs_once(spark):
    texts = ["a-b-c", "Back-Office 24/7", "", "-", "x - y", "né-e à-b", "a--b c-d"]
    assert column(spark, texts, tx.tokens) == [python_tokens(t) for t in texts]
    assert column(spark, ["a-b-c"], tx.tokens) == [["a", "b", "c", "ab"]]


def test_words_split_on_every_blank(spark):
    texts = ["", "  ", "a", " a\tb\nc ", "a b c　d", "a\x1cb\x85c", "né é-x !~ z"]
    assert column(spark, texts, tx.words) == [t.split() for t in texts]
    assert column(spark, texts, tx.strip) == [t.strip() for t in texts]


@hyp(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(alphabet="aZ9é-–’ \t\n. ", max_size=40), min_size=1, max_size=20))
def test_text_functions_equal_plain_python(spark, texts):
    assert column(spark, texts, tx.words) == [t.split() for t in texts]
    assert column(spark, texts, tx.tokens) == [python_tokens(t) for t in texts]
    assert column(spark, texts, tx.normalised) == [re.sub("[^a-z0-9]", "", t.lower()) for t in texts]


def test_bare_id_keeps_a_dotted_suffix(spark):
    raw = ["Condition 12A - Title", "condition  7", "12.A", "8 - Obligations", "Annex", "27A.B: x", ""]
    assert column(spark, raw, tx.bare_id) == ["12A", "7", "12.A", "8", "Annex", "27A.B", ""]


def test_natural_number(spark):
    assert column(spark, ["4A", "21BA", "X1", ""], tx.natural_number) == [4, 21, 999, 999]


def test_dates_and_distances(spark):
    day = lambda c: tx.long_date(F.to_date(c))
    assert column(spark, ["2022-09-04", "2022-09-24"], day) == ["4 September 2022", "24 September 2022"]
    label = lambda c: tx.distance_label(c.cast("double"))
    assert column(spark, ["0.71249", None, "1"], label) == ["0.712", "kw", "1.000"]


def test_boilerplate_rules(spark):
    rules = [("prefix", "Note:"), ("contains", "Running title"), ("equals", "Draft")]
    texts = ["", "12", "1234", "Note: x", "a Running title b", "Draft", "Draft 2", "page 12"]
    assert column(spark, texts, lambda c: lines.is_boilerplate(c, rules)) == [
        True, True, False, True, True, True, False, False,
    ]


def test_headings(spark):
    texts = [
        "Condition 12A. Supply", "Condition 3: Terms", "Condition 12.B. Dotted", "condition 12A. lower",
        "Condition 12A.3 clause", "Condition 28ADX. Three", "See Condition 4. x",
    ]
    assert column(spark, texts, lines.heading_id) == ["12A", "3", "12.B", None, None, "28ADX", None]
    assert column(spark, texts[:2], lines.heading_title) == ["Supply", "Terms"]
    assert column(spark, ["SECTION B1: General", "SECTION B: x", "Section B: x"], lines.outer_label) == [
        "SECTION B1", "SECTION B", None,
    ]


def test_tokens_of_many_texts_are_those_of_each(spark):
    """Texts that end in a hyphen or a token, empty ones and nulls; pairs don't cross texts."""
    rng = random.Random(4)
    texts = [None, "", "a-", "b-c-d-e", "-f", "g--h", "é-i j-k"] + ["".join(rng.choice("ab1-- é\n") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    found, of = tx.low_tokens(pa.array(texts, pa.string()))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", tx.tokens(F.col("text")).alias("t")).collect()
    assert Counter(zip(of.tolist(), found.to_pylist())) == Counter((r["i"], t) for r in rows for t in r["t"] or [])
    none, _ = tx.low_tokens(pa.array([None, ""], pa.string()))
    assert len(none) == 0


def test_tokens_are_counted_without_them():
    """Also of a slice of an array."""
    texts = pa.array(["left out", "a-b-c d", None, "", "\u00e9t\u00e9-x y-z", "-", "q"], pa.string())
    for some in (texts, texts.slice(1), texts.slice(2, 2), texts.slice(0, 0)):
        _, of = tx.low_tokens(some)
        assert tx.n_low_tokens(some).tolist() == [int((of == i).sum()) for i in range(len(some))]
    assert tx.n_low_tokens(texts).tolist() == [2, 5, 0, 0, 5, 0, 1]


def test_letters_of_words_equal_normalised_texts(spark):
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    words = ["".join(every[i : i + 1000]) for i in range(0, len(every), 1000)] + ["", "Abc-12", "\u0130\u212a"]
    want = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(tx.normalised(F.col("w"))).collect()]
    said, ends = tx.letters(pa.array(words))
    assert [said[a:b].tobytes().decode() for a, b in zip([0, *ends[:-1]], ends)] == want
    assert tx.letters(pa.array([], pa.string()))[0].size == 0


def test_texts_are_tokenised_a_few_at_once(monkeypatch):
    texts = pa.array(["a-b c", None, "", "d e-f-g", "-x-", "y\u00e9z 1-2"] * 5)
    want = Counter(zip(tx.low_tokens(texts)[1].tolist(), tx.low_tokens(texts)[0].to_pylist()))
    seen = []
    runs = tx._low_runs
    monkeypatch.setattr(tx, "_low_runs", lambda low: seen.append(len(low)) or runs(low))
    monkeypatch.setattr(tx, "FEW_TEXTS", 4)
    for some in (texts, texts.slice(3, 11)):
        found, of = tx.low_tokens(some)
        assert Counter(zip((of + (0 if some is texts else 3)).tolist(), found.to_pylist())) == Counter({k: n for k, n in want.items() if some is texts or 3 <= k[0] < 14})
        assert tx.n_low_tokens(some).tolist() == np.bincount(of, minlength=len(some)).tolist()
    assert max(seen) == 4
