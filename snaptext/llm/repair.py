"""Cheapest repair of the structure of conversations.

A sound conversation has roles by initials ``(s?(ua)+)?``: perhaps a system turn, then user and assistant in turns,
or nothing at all. Every row is kept, given another role or deleted, empty turns may be inserted anywhere, and each
edit has a cost. The cheapest edits follow from a dynamic program over four states: begun, after system, after user,
after assistant.

Rows are shuffled once, by conversation, and sorted by turn inside the partitions. A first pass streams them in
reverse through ``mapInArrow`` and carries the costs to go of the four states across batches; all that it leaves
behind is one byte per row, the best edit in each state. A second local sort, which spills if it must, puts the rows
in order again, and a second pass follows the bytes from the start. A conversation may thus be far larger than a
task's memory; neither pass holds more than a batch. The rows of one conversation do pass through one task, since
its digest is that of one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: ASCII white space.
_SPACES = " \t\n\x0b\f\r"
FAULTS = ("blank", "duplicate", "truncated")


class Costs(NamedTuple):
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    #: Of a truncated row that isn't deleted.
    truncated: int = 5


BEGUN, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn that is put in or given that role, by the state before it.
_NEXT = (USER, USER, ASSISTANT, USER)
_KEPT = {("s", BEGUN): SYSTEM, ("u", BEGUN): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_NAME = {USER: "user", ASSISTANT: "assistant"}
#: In the order in which ties are decided.
_EDITS = "DIKR"


def _with_inserts(costs: list[float], insert: int) -> list[float]:
    """Least costs of the states if turns may be inserted first."""
    while True:
        better = [min(c, insert + costs[_NEXT[q]]) for q, c in enumerate(costs)]
        if better == costs:
            return costs
        costs = better


@lru_cache(maxsize=1 << 16)
def _before(initial: str, fault: str | None, after: tuple[int, ...], costs: Costs) -> tuple[tuple[int, ...], int]:
    """Costs to go before a row, less their minimum, and the best edit in each state, two bits each."""
    inf = float("inf")
    extra = costs.truncated if fault == "truncated" else 0
    kept_out = fault in ("blank", "duplicate")
    ways = []
    for q in range(4):
        to = _KEPT.get((initial, q))
        keep = inf if kept_out or to is None else extra + after[to]
        rerole = inf if kept_out else costs.rerole + extra + after[_NEXT[q]]
        ways.append((costs.delete + after[q], keep, rerole))
    best = _with_inserts([min(w) for w in ways], costs.insert)
    edits = 0
    for q, (delete, keep, rerole) in enumerate(ways):
        ordered = (delete, costs.insert + best[_NEXT[q]], keep, rerole)
        edits |= ordered.index(best[q]) << (2 * q)
    least = min(best)
    return tuple(b - least for b in best), edits


def _end(costs: Costs) -> tuple[int, ...]:
    """Costs to go after the last row, for turns to insert."""
    return tuple(_with_inserts([0, float("inf"), float("inf"), 0], costs.insert))


def damage(turns: DataFrame) -> DataFrame:
    """Rows (``conv_id``, ``turn``, ``role``, ``text``) damaged by a rule on conversation and turn, to try repairs on.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it, 4
    makes the role user. Nulls in role and text, and in the hashed string, become one space.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown[3], "[.!?]", "")).otherwise(shown[3])
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown[2]).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_copy"))
    return rows.drop("_copy")


def _in_order(turns: DataFrame, costs: Costs) -> DataFrame:
    """Rows with their fault and the best edits of each state, conversation after conversation, by turn."""
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).repartition("conv_id")
    # The shuffle by conversation serves this window, too.
    said_before = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    body = F.rtrim("text", F.lit(_SPACES))
    fault = (
        F.when(body == "", FAULTS[0]).when(F.col("copy") > 1, FAULTS[1]).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), FAULTS[2])
    )
    rows = rows.withColumn("copy", F.row_number().over(said_before)).withColumn("fault", fault)
    order = ["conv_id", "turn", "role", "text", "copy"]
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, after = object(), _end(costs)
        for batch in batches:
            edits = []
            for conv_id, role, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "fault"))):
                if conv_id != current:
                    current, after = conv_id, _end(costs)
                after, edit = _before(role[:1], fault, after, costs)
                edits.append(edit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, pa.int32())], names=[*batch.schema.names, "edits"])

    reverse = rows.sortWithinPartitions(*[F.desc_nulls_last(c) for c in order])
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return reverse.mapInArrow(run, f"{columns}, edits int").sortWithinPartitions(*[F.asc_nulls_first(c) for c in order])


def repair(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The cheapest edits of rows (``conv_id``, ``turn``, ``role``, ``text``), one row each.

    Returns ``conv_id``, ``step`` (from 0), ``edit`` (``K`` keep, ``R`` rerole, ``D`` delete, ``I`` insert), ``cost``, ``role`` and ``text`` of the
    repaired turn (null where deleted), and of the given row ``turn``, ``given_role`` and ``fault`` (``blank``: nothing but ASCII white
    space; ``duplicate``: role and text seen earlier; ``truncated``: ends in none of ``.!?``; the first that holds) - null
    for inserted turns. Rows come conversation after conversation, in order. Of equally cheap edits, those whose letters
    are least in ASCII are taken.

    Rows are ordered by turn, nulls first, then by role and text; rows equal in all are copies. Null roles and texts are one
    space. Blank rows and duplicates are always deleted. Rows with a null ``conv_id`` are one conversation. An empty table gives no
    rows; other columns are ignored.
    """
    ordered = _in_order(turns, costs)
    id_type = ordered.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "step", "edit", "cost", "role", "text", "turn", "given_role", "fault"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, step, out = object(), BEGUN, 0, []

        def put(edit: str, cost: int, role: str | None, text: str | None, turn: int | None = None, given: str | None = None, fault: str | None = None) -> None:
            nonlocal step
            out.append((current, step, edit, cost, role, text, turn, given, fault))
            step += 1

        def insert() -> None:
            nonlocal state
            state = _NEXT[state]
            put("I", costs.insert, _NAME[state], "")

        def finish() -> None:
            while state not in (BEGUN, ASSISTANT):
                insert()

        schema = None
        for batch in batches:
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            schema = pa.schema(list(zip(names, types)))
            for conv_id, turn, role, text, fault, edits in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "edits"))):
                if conv_id != current:
                    finish()
                    current, state, step = conv_id, BEGUN, 0
                while (edit := _EDITS[edits >> 2 * state & 3]) == "I":
                    insert()
                if edit == "D":
                    put(edit, costs.delete, None, None, turn, role, fault)
                    continue
                extra = costs.truncated if fault == "truncated" else 0
                if edit == "K":
                    state = _KEPT[role[:1], state]
                    put(edit, extra, role, text, turn, role, fault)
                else:
                    state = _NEXT[state]
                    put(edit, costs.rerole + extra, _NAME[state], text, turn, role, fault)
            yield _batch(out, schema)
            out.clear()
        finish()
        if out:
            yield _batch(out, schema)

    return ordered.mapInArrow(run, f"conv_id {id_type}, step long, edit string, cost long, role string, text string, turn long, given_role string, fault string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def summaries(edits: DataFrame, in_order: bool = False) -> DataFrame:
    """One row per conversation of what ``repair`` returned: ``gaps`` in its turn numbers, rows by fault, ``illegal`` neighbours (role
    initials of given rows other than su, ua, au), ``cost``, the ``audit`` of edit letters in order and ``repaired_sha256`` (repaired
    ``role:text`` joined by newlines).

    ``in_order`` says that the rows are still as ``repair`` gave them, not stored and read again; else they are shuffled by
    conversation and sorted. Conversations are streamed; only the letters of one are held.
    """
    if not in_order:
        edits = edits.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "step")
    id_type = edits.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out, schema = object(), None, [], None

        def finish() -> None:
            if state:
                gaps = state["last"] - state["first"] + 1 - state["turns"] if state["turns"] else 0
                out.append((current, gaps, *(state[f] for f in FAULTS), state["illegal"], state["cost"], state["audit"].decode(), state["digest"].hexdigest()))

        for batch in batches:
            id_field = batch.schema.field("conv_id").type
            schema = pa.schema(list(zip(names, [id_field, *[pa.int64()] * 6, pa.string(), pa.string()])))
            for conv_id, edit, cost, role, text, turn, given, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "cost", "role", "text", "turn", "given_role", "fault"))):
                if conv_id != current or state is None:
                    finish()
                    current = conv_id
                    state = dict.fromkeys([*FAULTS, "illegal", "cost", "turns"], 0) | {"first": None, "last": None, "role": None, "audit": bytearray(), "digest": sha256(), "lines": 0}
                state["cost"] += cost
                state["audit"] += edit.encode()
                if edit != "D":
                    state["digest"].update((("\n" if state["lines"] else "") + f"{role}:{text}").encode())
                    state["lines"] += 1
                if edit != "I":
                    if fault:
                        state[fault] += 1
                    if state["role"] is not None and state["role"][:1] + given[:1] not in ("su", "ua", "au"):
                        state["illegal"] += 1
                    state["role"] = given
                    if turn is not None and turn != state["last"]:
                        state["first"] = turn if state["first"] is None else state["first"]
                        state["last"] = turn
                        state["turns"] += 1
            yield _batch(out, schema)
            out.clear()
        finish()
        if out:
            yield _batch(out, schema)

    longs = ", ".join(f"{c} long" for c in names[1:7])
    return edits.mapInArrow(run, f"conv_id {id_type}, {longs}, audit string, repaired_sha256 string")


def assess(turns: DataFrame, given: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """``summaries`` of ``turns``, and of zeros, no edits and no text for every ``conv_id`` of ``given`` that has no row there."""
    found = summaries(repair(turns, costs), in_order=True).withColumnRenamed("conv_id", "_found")
    ids = given.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return joined.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
