"""Repair of conversations against all possible edits."""

import hashlib
import random
import re
import zlib

import pytest

from conftest import SMALL
from snaptext.llm import repair
from snaptext.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, step string, edit int, _copy int"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_edits(rows, faults):
    """(cost, letters, repaired lines) of all edits that give sound roles, tried out one by one up to one insert between rows or two at the end."""
    found = []

    def go(i, cost, letters, lines, roles, inserts):
        if not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            found.append((cost, letters, lines))
        if inserts < 2:
            for name in ("user", "assistant"):
                go(i, cost + 5, letters + "I", [*lines, f"{name}:"], roles + name[0], inserts + 1)
        if i < len(rows):
            _, role, text = rows[i]
            go(i + 1, cost + 2, letters + "D", lines, roles, 0)
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] else 0
                go(i + 1, cost + extra, letters + "K", [*lines, f"{role}:{text}"], roles + (role[:1] or "?"), 0)
                for name in ("user", "assistant"):
                    go(i + 1, cost + 1 + extra, letters + "R", [*lines, f"{name}:{text}"], roles + name[0], 0)

    go(0, 0, "", [], "", 0)
    return min(found, key=lambda f: (f[0], f[1]))


def plain_summary(conv_id, rows):
    """rows: (turn, role, text)."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults = plain_faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, letters, lines = plain_edits(rows, faults)
    return (
        conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def plain_damage(rows):
    """rows: (conv_id, turn, role, text)."""
    for conv_id, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv_id, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", shown[3]) if kind == 2 else shown[3]
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv_id, turn, "user" if kind == 4 else shown[2], text


def by_conversation(rows):
    out = {}
    for conv_id, *rest in rows:
        out.setdefault(conv_id, []).append(rest)
    return out


def rows_of(df):
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in df.collect()}


def random_rows(rng, conversations, longest):
    out = []
    for c in [None, *range(conversations)]:
        for _ in range(rng.randrange(1, longest)):
            turn = rng.choice([None, 1, 2, 3, 5, 8])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Hi.", "Yes! \n", "cut off", "", " \t", "why?", None, "è.", "more text that ends"])
            out.append((c, turn, role, text, "x", 1, 2))
    return out


@pytest.mark.parametrize("batch", [2, 10000])
def test_all_edits(spark, batch):
    rows = random_rows(random.Random(3), 150, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = rows_of(repair.assess(df, df))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for conv_id, some in by_conversation(r[:4] for r in rows).items():
        assert got[conv_id] == plain_summary(conv_id, some)
    assert set(got) == {r[0] for r in rows}


def test_stored_edits_give_the_same(spark, tmp_path):
    df = spark.createDataFrame(random_rows(random.Random(5), 20, 9), SCHEMA)
    edits = repair.repair(df)
    edits.write.parquet(str(tmp_path / "edits"))
    again = spark.read.parquet(str(tmp_path / "edits"))
    assert rows_of(repair.summaries(again)) == rows_of(repair.summaries(edits, in_order=True))
    for r in again.collect():
        assert (r["text"] is None) == (r["edit"] == "D") and (r["given_role"] is None) == (r["edit"] == "I")


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = rows_of(QUERIES["op12_repair_conversations"](spark, SMALL))
    damaged = by_conversation(plain_damage(rows))
    assert set(got) == {r[0] for r in rows}
    for conv_id in got:
        assert got[conv_id] == plain_summary(conv_id, damaged.get(conv_id, []))


def test_damage_of_nulls_and_of_all_rows(spark):
    rows = [(c, t, r, x) for c in (None, *range(60)) for t, r, x in ((0, "user", None), (None, None, "A. b! c?"))]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    key = lambda r: tuple((v is not None, v or 0) if i < 2 else v for i, v in enumerate(r))
    assert sorted((tuple(r) for r in repair.damage(df).collect()), key=key) == sorted(plain_damage(rows), key=key)
    gone = repair.assess(df.limit(0), df).collect()
    assert len(gone) == 61 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in gone)
    assert repair.repair(df.limit(0)).count() == 0


def test_a_giant_conversation_streams(spark):
    n = 20000
    roles = ["user", "assistant", "assistant", "user", "system"]
    rows = [(1, i, roles[i % 5], f"text {i}." if i % 7 else "text", "x", 1, 2) for i in range(n)] + [(2, 0, "user", "x" * 300000, "x", 1, 2)]
    out = rows_of(repair.assess(df := spark.createDataFrame(rows, SCHEMA), df))
    assert out[2][6:8] == (2, "D")
    _, _, _, duplicate, truncated, _, cost, audit, _ = out[1]
    assert len(audit.replace("I", "")) == n and audit.count("D") >= duplicate > 2000 and cost > 0 and truncated > 0
    assert cost <= 2 * n
