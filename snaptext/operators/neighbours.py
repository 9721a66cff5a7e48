"""Nearest neighbours over an inverted-file index of vectors.

K-means centroids, fitted on a bounded sample, divide the rows into lists; a long list is divided into blocks. The index
is stored bucketed by list and block, with each row's vector and a code of small integers. Queries meet the lists they
visit in a join by list and block: neither queries nor rows go through the driver or are broadcast, and the rows of the
index aren't shuffled.

Exact search visits the nearest lists first; the n-th distance found there and the radius of every other list tell by the
triangle inequality which of those may still hold a nearer row, and only these are visited, too. Approximate search ranks
the rows of the nearest lists by their codes and compares full vectors for the best ones only.

Codes and centroids are integers, so that sums don't depend on an order and every engine gets the same lists.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from snaptext import settings
from snaptext.operators.lexical import QUERY_KEYS, first_n
from snaptext.operators.vectors import unit_vector
from snaptext.scale import shared_folder, stored

#: Rows that centroids are fitted on, those with the least MD5 of their key; rounds of fitting.
SAMPLE, ROUNDS = 16_384, 5
#: Lists, at most.
MOST_LISTS = 1024
#: Rows of a block, queries that meet a block at once, distances held by one task at a time.
BLOCK, QUERY_BLOCK, CELLS = 8192, 8192, 4_000_000
#: Largest code of a component of a vector.
CODE = 127


@dataclass
class VectorIndex:
    rows: DataFrame  # keys, vector, code, list, block
    keys: list[str]
    centroids: np.ndarray  # in codes
    blocks: np.ndarray  # of each list; none if it has no rows
    radius: np.ndarray  # largest distance of a row to its centroid
    scale: float
    unit: bool
    table_name: str

    @property
    def n_lists(self) -> int:
        return len(self.centroids)

    def drop(self) -> None:
        """Forget the table; its files go with the shared folder."""
        self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table_name}")


def _with(df: DataFrame, name: str, kind: str, made) -> DataFrame:
    """``df`` with a column of lists that ``made(batch)`` returns; rows for which it is null are left out."""
    types = {f.name: f.dataType.simpleString() for f in df.schema} | {name: kind}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = made(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=list(types)).filter(column.is_valid())

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in types.items()))


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType, missing: np.ndarray | None = None) -> pa.ListArray:
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind), mask=None if missing is None else pa.array(missing))


def _units(vectors: pa.ListArray) -> pa.ListArray:
    """What ``vectors.unit_vector`` returns, of many vectors."""
    sizes, flat = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64), vectors.flatten()
    values, starts = flat.to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    squares = np.zeros(len(sizes))
    # One component after the other, as Spark adds them.
    for i in range(sizes.max(initial=0)):
        longer = sizes > i
        squares[longer] += values[starts[longer] + i] ** 2
    norm = np.sqrt(squares)
    # Not a number is the largest one in Spark.
    missing = ~((norm > 0) | np.isnan(norm))
    if flat.null_count:
        missing |= np.bincount(of, flat.is_null().to_numpy(zero_copy_only=False), len(sizes)) > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        return _lists(values / norm[of], sizes, pa.float64(), missing)


def _prepared(df: DataFrame, columns: list[str], unit: bool) -> DataFrame:
    """Columns, the vector as doubles, and ``point``: what lists are made of."""
    rows = df.select(*columns, F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    return _with(rows, "point", "array<double>", lambda batch: _units(batch.column("vector"))) if unit else rows.withColumn("point", F.col("vector"))


def _codes(points: pa.ListArray, scale: float) -> pa.ListArray:
    """Points as small integers; a missing one is missing."""
    flat = points.flatten()
    found = np.clip(np.nan_to_num(np.floor(flat.to_numpy(zero_copy_only=False) * scale + 0.5), nan=0.0, posinf=CODE, neginf=-CODE), -CODE, CODE)
    if flat.null_count:
        found[flat.is_null().to_numpy(zero_copy_only=False)] = CODE
    sizes = pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False)
    return _lists(found.astype(np.int32), sizes, pa.int32(), points.is_null().to_numpy(zero_copy_only=False))


def _coded(rows: DataFrame, scale: float) -> DataFrame:
    return _with(rows, "code", "array<int>", lambda batch: _codes(batch.column("point"), scale))


def _of_list(values: np.ndarray) -> Column:
    """The number that belongs to a row's list, 1 at least."""
    return F.element_at(F.array(*[F.lit(max(1, int(x))) for x in values]), F.col("list") + 1)


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``; exact for integers."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0.0)


def fit_centroids(points: np.ndarray, n_lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of integer points, from the first ``n_lists`` of them on; means are rounded down, ties go to the first."""
    centroids = points[:n_lists].astype(np.float64)
    for _ in range(rounds):
        nearest = np.concatenate([_squares(points[i : i + 4096], centroids).argmin(axis=1) for i in range(0, len(points), 4096)]) if len(points) else np.zeros(0, int)
        counts = np.bincount(nearest, minlength=n_lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        filled = counts > 0
        centroids[filled] = np.floor(sums[filled] / counts[filled, None])
    return centroids


def build(
    corpus: DataFrame, keys: list[str], metric: str = "cosine", lists_per_root: float = 2.0, sample: int = SAMPLE, block: int = BLOCK
) -> VectorIndex:
    """An index of (*keys*, ``vector``) for distances by ``metric``, ``cosine`` or ``squared_l2``.

    Keys are unique. Rows without a vector, and for cosine those of length zero, are never found and left out. There
    are ``lists_per_root`` lists for each unit of the root of the number of rows, up to ``MOST_LISTS``: many for approximate
    search, fewer where most lists are visited anyway.
    """
    spark, unit = corpus.sparkSession, metric == "cosine"
    rows = corpus.select(*keys, F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    scale = float(CODE)
    if not unit:
        largest = rows.agg(F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector"))))).first()[0]
        scale /= largest or 1.0
    # Vectors pass through Python as few times as can be, and their points are taken there.
    pointed = _units if unit else lambda vectors: vectors
    coded = stored(_with(rows, "code", "array<int>", lambda batch: _codes(pointed(batch.column("vector")), scale)), "vectors")
    n = coded.count()
    shown = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))
    held = coded.select(shown.alias("_at"), "code").orderBy("_at").limit(sample).toPandas()
    points = np.array(held["code"].tolist(), dtype=np.float64).reshape(len(held), -1 if len(held) else 0)
    lists = min(max(1, min(MOST_LISTS, math.floor(lists_per_root * math.sqrt(n) + 0.5))), len(points))
    centroids = fit_centroids(points, lists)
    sent = spark.sparkContext.broadcast(centroids)
    types = {f.name: f.dataType.simpleString() for f in coded.schema}

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            code, point, centre = _matrix(batch.column("code"), rows), _matrix(pointed(batch.column("vector")), rows), sent.value
            nearest = _squares(code, centre).argmin(axis=1)
            far = np.sqrt(((point - centre[nearest] / scale) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in [*keys, "vector", "code"]), pa.array(nearest.astype(np.int32)), pa.array(far)], names=[*keys, "vector", "code", "list", "far"]
            )

    columns = ", ".join(f"{c} {types[c]}" for c in [*keys, "vector", "code"])
    placed = stored(coded.select(*keys, "vector", "code").mapInArrow(assigned, f"{columns}, list int, far double"), "listed")
    # One row per list.
    per_list = {r["list"]: (r["n"], r["far"]) for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    blocks = np.array([-(-per_list.get(i, (0, 0.0))[0] // block) for i in range(lists)], np.int64)
    radius = np.array([per_list.get(i, (0, 0.0))[1] for i in range(lists)])
    name, shards = f"snaptext_vectors_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = placed.drop("far").withColumn("block", F.pmod(F.xxhash64(*keys), _of_list(blocks)).cast("int"))
    (
        cut.repartition(shards, "list", "block")
        .write.bucketBy(shards, "list", "block")
        .sortBy("list", "block")
        .option("path", f"{shared_folder(spark)}/{name}")
        .saveAsTable(name)
    )
    return VectorIndex(spark.table(name), keys, centroids, blocks, radius, scale, unit, name)


def _distances(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    dots = q @ c.T
    qn, cn = (q * q).sum(axis=1)[:, None], (c * c).sum(axis=1)[None, :]
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.maximum(1.0 - dots / np.sqrt(qn * cn), 0.0)
    return np.maximum(qn + cn - 2 * dots, 0.0)


def _first_of_lines(d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the ``n`` least values of each line, ties to the first column."""
    lines, columns = d.shape
    if columns <= n:
        return np.repeat(np.arange(lines), columns), np.tile(np.arange(columns), lines)
    some = np.sort(np.argpartition(d, n - 1, axis=1)[:, :n], axis=1)
    limit = np.take_along_axis(d, some, axis=1).max(axis=1)
    # Where more columns tie for the last place, any of them may have been taken.
    for i in np.flatnonzero((d <= limit[:, None]).sum(axis=1) > n):
        near = np.flatnonzero(d[i] <= limit[i])
        some[i] = np.sort(near[np.argsort(d[i, near], kind="stable")][:n])
    return np.repeat(np.arange(lines), n), some.ravel()


def _visits(queries: DataFrame, index: VectorIndex, lists_of, more: list[str] = []) -> DataFrame:
    """A row for each list that a query visits: those that ``lists_of(distances to centroids, batch)`` marks."""
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast((index.centroids, index.blocks > 0))
    names = [*QUERY_KEYS, *more, "vector", "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, filled = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                chosen = lists_of(_squares(_matrix(batch.column("code"), batch.num_rows), centroids), batch) & filled
                query, visited = np.nonzero(chosen)
                taken = batch.select(names).take(pa.array(query))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(visited.astype(np.int32))], names=[*names, "list"])

    types = {f.name: f.dataType.simpleString() for f in queries.schema}
    return queries.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names) + ", list int")


def _nearest_lists(probes: int):
    """Marks of the ``probes`` nearest lists of each query; ties go to the first list."""

    def mark(distance: np.ndarray, _: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(distance.shape, bool)
        np.put_along_axis(out, np.argsort(distance, axis=1, kind="stable")[:, :probes], True, axis=1)
        return out

    return mark


def _scan(visits: DataFrame, index: VectorIndex, n_queries: int, n: int, column: str, distance) -> DataFrame:
    """The ``n`` nearest rows of every query in each block it visits, by ``distance`` (a function of two matrices) of ``column``."""
    spread_out = visits.select(*QUERY_KEYS, column, "list", F.explode(F.sequence(F.lit(0), _of_list(index.blocks) - 1)).alias("block"))
    # At most as many rows as there are lists.
    visited = visits.select("list").distinct()
    by, rows = ["list", "block"], index.rows.select(*index.keys, column, "list", "block")
    parts = -(-n_queries // QUERY_BLOCK)
    if parts > 1:
        by = [*by, "part"]
        part = F.pmod(F.xxhash64(*QUERY_KEYS), F.lit(parts)).cast("int")
        spread_out = spread_out.withColumn("part", part)
        visited = visits.select("list", part.alias("part")).distinct()
    rows = rows.join(F.broadcast(visited), "list")
    types = {f.name: f.dataType.simpleString() for f in [*visits.schema, *index.rows.schema]}

    keys = index.keys

    def meet(asked: pa.Table, some: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and some.num_rows:
            some = some.sort_by([(k, "ascending") for k in keys])
            c = _matrix(some.column(column), some.num_rows)
            step = max(1, CELLS // len(c))
            for at in range(0, asked.num_rows, step):
                part = asked.slice(at, step)
                d = distance(_matrix(part.column(column), part.num_rows), c)
                rows_of, near = _first_of_lines(d, n)
                found.append((rows_of + at, near, d[rows_of, near]))
        query, row, far = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        asked, some = asked.select(QUERY_KEYS).take(pa.array(query)), some.select(keys).take(pa.array(row))
        return pa.table([*asked.columns, *some.columns, pa.array(far)], names=[*QUERY_KEYS, *keys, "distance"])

    schema = ", ".join(f"{c} {types[c]}" for c in [*QUERY_KEYS, *index.keys]) + ", distance double"
    return spread_out.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(meet, schema)


def nearest(queries: DataFrame, index: VectorIndex, n: int = settings.CANDIDATES, digits: int | None = None, first_lists: int | None = None) -> DataFrame:
    """Exact ``n`` nearest rows of each query (``query_id, sub_no, vector``), with their ``rank`` and ``distance``.

    ``digits`` rounds distances before ranking; ties go by key. ``first_lists`` is how many lists are visited before bounds are known.
    """
    if not index.n_lists:
        return _nothing(queries, index)
    metric, unit = ("cosine", True) if index.unit else ("squared_l2", False)
    asked = stored(_coded(_prepared(queries, QUERY_KEYS, unit), index.scale), "asked")
    n_queries = asked.count()
    order = [F.asc("distance"), *[F.asc(k) for k in index.keys]]

    def scanned(visits: DataFrame) -> DataFrame:
        def distance(q: np.ndarray, c: np.ndarray) -> np.ndarray:
            d = _distances(q, c, metric)
            return d if digits is None else np.round(d, digits)

        return first_n(_scan(visits, index, n_queries, n, "vector", distance), n, QUERY_KEYS, order)

    first = first_lists or max(1, math.isqrt(index.n_lists))
    near = stored(scanned(_visits(asked, index, _nearest_lists(first))), "near")
    if first < index.n_lists:
        near = near.drop("rank").unionByName(scanned(_visits(*_bounded(asked, index, near, n, first, digits))).drop("rank"))
        near = first_n(near, n, QUERY_KEYS, order)
    return near.select(*QUERY_KEYS, "rank", *index.keys, "distance")


def _nothing(queries: DataFrame, index: VectorIndex) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema, *index.rows.schema]} | {"rank": "int", "distance": "double"}
    return queries.sparkSession.createDataFrame([], ", ".join(f"{c} {types[c]}" for c in [*QUERY_KEYS, "rank", *index.keys, "distance"]))


def _bounded(asked: DataFrame, index: VectorIndex, near: DataFrame, n: int, first: int, digits: int | None) -> tuple:
    """Arguments of ``_visits`` for the lists beyond the ``first`` that may hold a row as near as the n-th so far."""
    limits = near.where(F.col("rank") == n).select(*QUERY_KEYS, F.col("distance").alias("limit"))
    rows = asked.join(limits, QUERY_KEYS, "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    radius, scale, centroids = index.radius, index.scale, index.centroids / index.scale
    slack = 1e-9 + (0 if digits is None else 10.0**-digits)
    times = 2.0 if index.unit else 1.0

    def mark(distance: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        limit = batch.column("limit").to_numpy(zero_copy_only=False)[:, None] * times + times * slack
        points = _matrix(batch.column("point"), batch.num_rows)
        least = np.maximum(np.sqrt(_squares(points, centroids)) - radius[None, :] - 1e-7, 0.0)
        return (least * least <= limit) & ~_nearest_lists(first)(distance, batch)

    return rows, index, mark


def nearest_approx(queries: DataFrame, index: VectorIndex, n: int = settings.CANDIDATES, probes: float = 0.6, rerank: int = 4) -> DataFrame:
    """Approximate nearest rows: in the given share of lists, ``rerank`` times ``n`` rows by codes, then ``n`` of these by their vectors.

    For an index by cosine. ``distance`` is that of the vectors at length one. How many lists are needed depends on how far the
    vectors form clusters: without any, as in random vectors, a recall of 0.9 takes more than half of them.
    """
    if not index.n_lists:
        return _nothing(queries, index)
    asked = stored(_coded(_prepared(queries, QUERY_KEYS, True), index.scale), "asked")
    found = candidates(asked, index, n * rerank, probes)
    full = found.join(index.rows.select(*index.keys, "vector"), index.keys).withColumn("point", unit_vector(F.col("vector")))
    mine = asked.select(*QUERY_KEYS, F.col("point").alias("asked"))
    squares = F.zip_with("point", "asked", lambda x, y: (x - y) * (x - y))
    near = full.join(mine, QUERY_KEYS).select(*QUERY_KEYS, *index.keys, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)).alias("distance"))
    order = [F.asc(F.round("distance", 6)), *[F.asc(k) for k in index.keys]]
    return first_n(near, n, QUERY_KEYS, order).select(*QUERY_KEYS, "rank", *index.keys, "distance")


def probe_count(index: VectorIndex, probes: float) -> int:
    return max(1, math.floor(index.n_lists * probes + 0.5))


def candidates(asked: DataFrame, index: VectorIndex, n: int, probes: float) -> DataFrame:
    """The ``n`` rows of each query whose codes are nearest, in the nearest lists; ties go by key."""
    visits = _visits(asked, index, _nearest_lists(probe_count(index, probes)))
    found = _scan(visits, index, asked.count(), n, "code", _squares)
    order = [F.asc("distance"), *[F.asc(k) for k in index.keys]]
    return first_n(found, n, QUERY_KEYS, order).drop("rank", "distance")
