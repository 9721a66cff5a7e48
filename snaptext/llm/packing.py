"""Packing of tokenized documents into sequences of one length, with little padding.

Documents are cut into full windows and one shorter piece. Lengths are counted in classes of a few tokens, and the
histogram of classes is covered by combinations of up to three pieces that fill a window: how often each combination
is repeated is a non-negative least squares problem, solved on the driver, whose size depends on the window alone.
Repeat counts are rounded, and what is left of the histogram is packed greedily, the longest first into the tightest
gap. Sequences that stay too empty are given up: their pieces are strung together in bundles and cut at the window.

The plan says, for the n-th piece of a class, its sequence and its slot there. Which one is the n-th follows from counts
(``counting.ranked``), so no class needs to be in one task, and a sequence's offsets from a window over its few pieces.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from snaptext.llm import bpe
from snaptext.llm.counting import block_rows, ranked
from snaptext.scale import shared_folder, stored

WINDOW = 2048
#: The id after each document's own.
END = 1
#: Tokens of a length class, pieces of a combination.
GRID, DEPTH = 8, 3
#: Share of a window that a sequence of the greedy step may leave empty.
SLACK = 1 / 32
#: Pieces that are strung together and cut.
BUNDLE = 1024
#: The greedy step leaves classes up to this one to the bundles: for such short pieces a class is too coarse.
TINY = 4


def combinations(classes: list[int], total: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ways to add up to ``total`` by at most ``depth`` of the given numbers, each from the largest down."""
    found, among = [], set(classes)

    def extend(head: tuple[int, ...], rest: int, left: int) -> None:
        if rest in among and (not head or rest <= head[-1]):
            found.append((*head, rest))
        if left > 1:
            for c in classes:
                if c < rest and (not head or c <= head[-1]) and (rest - c) <= c * (left - 1):
                    extend((*head, c), rest - c, left - 1)

    extend((), total, depth)
    return found


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The non-negative x that makes ``a @ x`` closest to ``b``, by active sets: few of its entries are not zero."""
    n = a.shape[1]
    x, active = np.zeros(n), []
    for _ in range(3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[active] = 0
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        active.append(best)
        while active:
            some = a[:, active]
            solved = np.linalg.solve(some.T @ some + 1e-12 * np.eye(len(active)), some.T @ b)
            if solved.min() > 0:
                x[:] = 0
                x[active] = solved
                break
            # Go towards the solution until the first entry reaches zero, which leaves the active set.
            now = x[active]
            down = solved <= 0
            step = np.min(now[down] / np.maximum(now[down] - solved[down], 1e-300))
            now = now + step * (solved - now)
            kept = now > 1e-14
            kept[np.flatnonzero(down)[np.argmin(now[down])]] = False
            x[:] = 0
            x[[c for c, k in zip(active, kept) if k]] = now[kept]
            active = [c for c, k in zip(active, kept) if k]
    return x


class Plan(NamedTuple):
    """Segments of consecutive pieces of a class: the pieces from ``first`` on, ``each`` to a sequence from ``sequence`` and ``slot`` on.

    Pieces are numbered over all classes: those of a class from ``starts`` on, of which ``planned`` have a segment.
    """

    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    slot: np.ndarray
    starts: np.ndarray
    planned: np.ndarray
    loose: np.ndarray
    sequences: int


def greedy(left: dict[int, int], total: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(pieces as (class, number), repeats): longest first into the tightest gap; new sequences take as many of a class as fit."""
    gaps: list[int] = []
    bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def put(gap: int, content: list[tuple[int, int]], n: int) -> None:
        if gap not in bins:
            insort(gaps, gap)
            bins[gap] = []
        bins[gap].append((content, n))

    for c in sorted(left, reverse=True):
        n = left[c]
        while n:
            at = bisect_left(gaps, c)
            if at == len(gaps):
                fits = min(total // c, n)
                put(total - fits * c, [(c, fits)], n // fits)
                n %= fits
                continue
            gap = gaps[at]
            content, repeats = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[at]
            fits = min(gap // c, n)
            filled = min(repeats, n // fits)
            put(gap - fits * c, [*content, (c, fits)], filled)
            if repeats > filled:
                put(gap, content, repeats - filled)
            n -= filled * fits
    return [x for gap in gaps for x in bins[gap]]


def plan(histogram: dict[int, int], window: int = WINDOW, grid: int = GRID, depth: int = DEPTH, slack: float = SLACK) -> Plan:
    """Where the pieces of each class go; ``histogram`` has the number of pieces by class, of ``grid`` tokens each."""
    total = window // grid
    left = {c: n for c, n in histogram.items() if n}
    chosen: list[tuple[list[tuple[int, int]], int]] = []
    ways = combinations(sorted(left, reverse=True), total, depth)
    if ways:
        row = {c: i for i, c in enumerate(sorted(left))}
        a = np.zeros((len(row), len(ways)))
        for j, way in enumerate(ways):
            for c in way:
                a[row[c], j] += 1
        # What is left over counts by its tokens.
        weight = np.array(sorted(left)) / total
        b = np.array([left[c] for c in sorted(left)], float)
        x = nnls(a * weight[:, None], weight * b / b.sum()) * b.sum()
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            content = [(c, ways[j].count(c)) for c in dict.fromkeys(ways[j])]
            n = min(round(float(x[j])), *(left[c] // m for c, m in content))
            if n > 0:
                chosen.append((content, n))
                for c, m in content:
                    left[c] -= m * n
    left = {c: n for c, n in left.items() if n}
    loose = dict.fromkeys(range(1, total + 1), 0)
    for c in range(1, min(TINY, total) + 1):
        loose[c] = left.pop(c, 0)
    for content, n in greedy(left, total):
        if total - sum(c * m for c, m in content) <= slack * total:
            chosen.append((content, n))
        else:
            for c, m in content:
                loose[c] += m * n

    counts = np.array([0, *(histogram.get(c, 0) for c in range(1, total + 1))], np.int64)
    starts = np.append(0, np.cumsum(counts))[:-1]
    planned, sequences = np.zeros(total + 1, np.int64), 0
    segments = []
    for content, n in chosen:
        slot = 0
        for c, m in content:
            segments.append((starts[c] + planned[c], m, sequences, slot))
            planned[c] += m * n
            slot += m
        sequences += n
    segments.sort()
    first, each, sequence, slot = np.array(segments, np.int64).reshape(-1, 4).T
    not_planned = np.array([0, *loose.values()], np.int64)
    return Plan(first, each, sequence, slot, starts, planned, np.append(0, np.cumsum(not_planned))[:-1], sequences)


def place(p: Plan, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loose, sequence or bundle, slot) of the pieces with these classes and ranks in their class."""
    loose = ranks >= p.planned[classes]
    number = p.starts[classes] + ranks
    at = np.maximum(np.searchsorted(p.first, number, "right") - 1, 0)
    free = p.loose[classes] + ranks - p.planned[classes]
    if not p.first.size:
        return loose, free // BUNDLE, free % BUNDLE
    since = number - p.first[at]
    sequence, slot = p.sequence[at] + since // p.each[at], p.slot[at] + since % p.each[at]
    return loose, np.where(loose, free // BUNDLE, sequence), np.where(loose, free % BUNDLE, slot)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """(``doc_id``, ``start``, ``length``, ``doc_tokens``, ``ids``) of the pieces of every row of (``doc_id``, ``text``).

    A document's ids, then ``end``, are cut at every ``window``; ``ids`` are packed as little-endian 32-bit numbers. Null texts are
    empty: one piece, of ``end``. Repeated rows are documents of their own. An empty table has no pieces.
    """
    encoded = bpe.encode_packed(docs, path).select("doc_id", F.concat("ids", F.lit(end.to_bytes(4, "little"))).alias("ids"))
    n = F.octet_length("ids") / F.lit(4)
    counted = encoded.select("doc_id", n.cast("long").alias("doc_tokens"), "ids")
    starts = F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(window).cast("long"))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring("ids", (s * 4 + 1).cast("int"), F.lit(4 * window)).alias("ids")))
    each = counted.select("doc_id", "doc_tokens", F.explode(cut).alias("p"))
    return each.select("doc_id", "p.start", (F.octet_length("p.ids") / F.lit(4)).cast("long").alias("length"), "doc_tokens", "p.ids")


def pack(cut: DataFrame, window: int = WINDOW, grid: int = GRID, keep_ids: bool = False) -> DataFrame:
    """Places of pieces (``doc_id``, ``start``, ``length`` up to ``window``, ``doc_tokens``, ``ids``) in sequences.

    Returns ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``ids_crc32``, ``sequence_id`` and ``offset``, with ``keep_ids`` also ``ids``. The
    pieces of a sequence lie side by side from offset 0. Some pieces are cut further; every id stays in exactly one piece.
    Sequence ids are unique but not without gaps.
    """
    if window % grid:
        raise ValueError("the window must be a multiple of the grid")
    spark = cut.sparkSession
    # The ids are by far the largest column: written once, well compressed, and read again only where needed.
    path = f"{shared_folder(spark)}/pieces-{uuid.uuid4().hex}"
    made = cut.select("doc_id", "start", "length", "doc_tokens", "ids", F.crc32("ids").alias("ids_crc32"), F.monotonically_increasing_id().alias("pos"))
    made.write.option("compression", "zstd").parquet(path)
    all_pieces = spark.read.schema(made.schema).parquet(path)
    rows = all_pieces.drop("ids")

    length_class = F.ceil(F.col("length") / F.lit(grid)).cast("int")
    histogram = {c: n for c, n in rows.groupBy(length_class).count().collect()}
    chosen = spark.sparkContext.broadcast(plan(histogram, window, grid))
    n, partitions = sum(histogram.values()), int(spark.conf.get("spark.sql.shuffle.partitions"))

    @F.pandas_udf("loose boolean, place long, slot long")
    def placed(classes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("loose", "place", "slot"), place(chosen.value, classes.to_numpy(), ranks.to_numpy()))))

    seated = ranked(rows, length_class, block_rows(n, partitions)).withColumn("p", placed(length_class, "rank")).select(*rows.columns, "p.*")
    before = Window.partitionBy("loose", "place").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    seated = seated.withColumn("at", F.coalesce(F.sum("length").over(before), F.lit(0)))
    # A string of loose pieces goes through several windows; all others lie in one.
    base, size = F.when(F.col("loose"), F.lit(chosen.value.sequences) + F.col("place") * BUNDLE).otherwise(F.col("place")), F.lit(window)

    def part(k):
        from_, to = F.greatest("at", k * size), F.least(F.col("at") + F.col("length"), (k + 1) * size)
        return F.struct((base + k).alias("sequence_id"), (from_ - k * size).alias("offset"), (from_ - F.col("at")).alias("skip"), (to - from_).alias("n"))

    windows = F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("length") - 1) / size))
    seats = stored(seated.withColumn("parts", F.transform(windows, part)).drop("loose", "place", "slot", "at"), "seats")
    parts = seats.select("*", F.explode("parts").alias("part"), (F.size("parts") > 1).alias("is_cut")).drop("parts")

    def shown(rows: DataFrame, ids, crc) -> DataFrame:
        kept = [ids.alias("ids")] if keep_ids else []
        return rows.select("doc_id", (F.col("start") + F.col("part.skip")).alias("start"), F.col("part.n").alias("length"), "doc_tokens", crc.alias("ids_crc32"), "part.sequence_id", "part.offset", *kept)

    own = all_pieces.select("pos", "ids")
    mine = F.substring("ids", (F.col("part.skip") * 4 + 1).cast("int"), (F.col("part.n") * 4).cast("int"))
    if keep_ids:
        return shown(parts.join(own, "pos"), mine, F.crc32(mine))
    whole, cut_ones = parts.filter(~F.col("is_cut")), parts.filter("is_cut").join(own, "pos")
    return shown(whole, F.lit(None), F.col("ids_crc32")).unionByName(shown(cut_ones, mine, F.crc32(mine)))
