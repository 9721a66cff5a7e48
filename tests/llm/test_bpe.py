"""Encoding and decoding against the public implementation of the vocabulary."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from snaptext.llm import bpe
from snaptext.llm.queries import QUERIES, vocabulary

SCHEMA = "doc_id long, text string, ids string, kind int, copies int"


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def own():
    with open(vocabulary(), encoding="utf-8") as file:
        return bpe.Bpe(file.read())


def texts():
    rng = random.Random(5)
    alphabets = ["ab", "abcdefgh ", "the and ing tion er ", "0123456789", " \n\t", "!?.,'", "äöü€é", "\U0001f600\U0001f468‍", "a1! \n", "'s't're 've'", "日本語"]
    out = ["", " ", "  a  ", "<|endoftext|>", "x <|endoftext|>\n <|endoftext|><|endoftext|>y", "<|endoftext", "it's we'll I'D", "\x00\x7f\xad", "　 x", "a" * 5000, "the" * 3000, " " * 3000 + "x", "\n" * 777]
    for _ in range(150):
        a = rng.choice(alphabets)
        out.append("".join(rng.choice(a) for _ in range(rng.choice([3, 20, 300, 3000]))))
    return out


def test_single_texts(own, reference):
    for t in texts():
        expected = reference.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == expected
        assert own.decode(expected) == reference.decode(expected, skip_special_tokens=False) == t


def test_joined_halves_equal_direct_merging(own):
    rng = random.Random(9)
    for _ in range(200):
        data = "".join(rng.choice(rng.choice(["ab", "abcde", "thein gor", "01"])) for _ in range(rng.randint(2, 250))).encode()
        cut = rng.randint(1, len(data) - 1)
        assert own.join(own.merged(data[:cut]), own.merged(data[cut:])) == own.merged(data)


def test_broken_bytes_are_replaced(own, reference):
    for ids in ([127, 50256, 95], [163, 228], [222]):
        assert own.decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_texts_together_with_few_words_remembered(own, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 7)
    monkeypatch.setattr(bpe, "TOGETHER", 900)
    rng = random.Random(2)
    some = texts() + [" ".join(rng.choice(["ab", "it's", "x.", "a1,", "é", "日本", "w" * 400, ""]) for _ in range(30)) for _ in range(40)]
    packed = list(own.encode_all(some))
    assert [len(p) for p in packed] == [4 * len(reference.encode(t, add_special_tokens=False).ids) for t in some]
    assert [own.encode(t) for t in some] == [reference.encode(t, add_special_tokens=False).ids for t in some]
    assert own.merged_together([b"", b"abab", b""]) == [b"", b"".join(i.to_bytes(4, "little") for i in own.merged(b"abab")), b""]


def test_compiled_encoder_is_the_same(own, reference):
    assert own.native is not None
    assert list(own.encode_natively(texts())) == list(own.encode_all(texts()))
    # A token that its own bytes don't encode to: merges make "ab" and then "abc" of "a" and "bc" only, which never stand side by side.
    vocabulary = {c: i for i, c in enumerate(bpe.byte_characters())} | {"ab": 256, "bc": 257, "abc": 258}
    odd = bpe.Bpe(json.dumps({"model": {"vocab": vocabulary, "merges": ["a b", "b c", "a bc"]}}))
    assert odd.native is None and list(odd.encode_natively(["abc"])) == list(odd.encode_all(["abc"]))


@pytest.mark.parametrize("part", [16, 500])
def test_parts_of_long_texts(spark, reference, part):
    rows = [(i % 60, t, "x", 1, 2) for i, t in enumerate(texts())]
    rows += [(None, "b" * 999, "x", 1, 2), (7, None, None, None, None), (5, "c d" * 800, "x", 1, 2), (5, "c d" * 800, "x", 1, 2)]
    out = bpe.encode(spark.createDataFrame(rows, SCHEMA), vocabulary(), part=part)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], list(r["ids"])) for r in out.collect())
    expected = sorted((-1 if d is None else d, reference.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in rows)
    assert got == expected


def test_round_trip_and_empty_table(spark):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA)
    back = bpe.decode(bpe.encode(df, vocabulary(), part=1000), vocabulary())
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r[0]: r[1] for r in rows}
    assert bpe.digests(df.limit(0), vocabulary()).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>"), vocabulary()).first()["text"] is None


def test_query(spark, reference):
    rows = {r["doc_id"]: r for r in QUERIES["op7_bpe_tokens"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(rows) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = reference.encode(d["text"], add_special_tokens=False).ids
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False)))
