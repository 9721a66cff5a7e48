"""Near-duplicate groups: SimHash fingerprints searched with a vantage-point tree.

Fingerprint: bit b is 1 if more than half of a text's word shingles have bit b set in their hash.

The tree splits on the Hamming distance to a vantage point: up to ``mu`` is inside, beyond is outside.
Level i measures it on bits of its own, disjoint from those of other levels. A point ``k`` steps beyond
a boundary differs from everything on the other side in at least ``k`` of the level's bits (triangle
bound), so crossing costs ``k`` of the search radius and what is left holds for all levels below. A
query therefore enters few shards: their number grows with the square of the depth and not, as with
distances over all bits, by a factor per level.

Of two near points that a boundary parts, the outside one visits the inside shards. So each pair
meets once, in the shard where the other is at home, and is compared exactly there. A shard passes on
the smallest member of each local group, never pairs; groups are then joined across shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from snaptext.llm.common import KEY, keyed_rows, whole
from snaptext.scale import stored

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Fingerprints at home in one shard, about; beyond twice as many a shard is cut into tiles.
SHARD = 2048
#: Expected size of the sample of fingerprints that the tree is built from (bounds the driver's share).
SAMPLE = 65_536
MAX_LEVELS = 14

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 15


def simhash(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 if it has no word."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle_words:
        words, shingle_words = [b" ".join(words)], 1
    hashed = xxhash.xxh64_intdigest
    n = len(words) - shingle_words + 1
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, _BLOCK):
        part = words[start : min(n, start + _BLOCK) + shingle_words - 1]
        shingles = zip(*(part[i : len(part) - shingle_words + 1 + i] for i in range(shingle_words)))
        hashes = np.array([hashed(b" ".join(s), seed) for s in shingles], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``text_key``, ``fingerprint``) for every row of (``doc_id``, ``text``).

    ``fingerprint`` is a long with the bits of the unsigned value; ``text_key`` is a hash of the text and names
    a row together with its id. A null text counts as empty, and a text without words has fingerprint 0.
    Works on one text at a time.
    """
    text = whole("text")
    named = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.cast("binary").alias("bytes"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t.as_py()) for t in batch.column("bytes")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(prints.view(np.int64))], names=["doc_id", "text_key", "fingerprint"]
            )

    return named.mapInArrow(run, f"doc_id {id_type}, text_key long, fingerprint long")


class Node(NamedTuple):
    """A split; ``inside`` and ``outside`` are nodes or shard numbers."""

    vantage: int
    mask: int
    mu: int
    inside: Node | int
    outside: Node | int


def build_tree(sample: np.ndarray, levels: int, seed: int = SEED) -> Node | int:
    """A tree of up to ``levels`` levels over a sample of fingerprints; 0 (one shard) without any."""
    rng = np.random.default_rng(seed)
    blocks = np.array_split(rng.permutation(64), max(levels, 1))
    masks = [int(sum(1 << int(b) for b in block)) for block in blocks]
    shards = iter(range(1 << max(levels, 1)))

    def grow(points: np.ndarray, level: int) -> Node | int:
        if level == levels or len(points) < 2:
            return next(shards)
        vantage = points[rng.integers(len(points))]
        far = np.bitwise_count((points ^ vantage) & np.uint64(masks[level]))
        shares = np.cumsum(np.bincount(far, minlength=65)) / len(points)
        mu = int(np.argmin(np.abs(shares - 0.5)))
        inside = far <= mu
        if inside.all() or not inside.any():
            return grow(points, level + 1)
        return Node(int(vantage), masks[level], mu, grow(points[inside], level + 1), grow(points[~inside], level + 1))

    return grow(np.sort(sample.astype(np.uint64)), 0)


def shards_of(tree: Node | int, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, index of the point, whether it is a guest there) for every visit of ``points``."""
    visits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    todo = [(tree, np.arange(len(points)), np.full(len(points), radius, np.int16), np.zeros(len(points), bool))]
    while todo:
        node, at, left, guest = todo.pop()
        if not len(at):
            continue
        if not isinstance(node, tuple):
            visits.append((np.full(len(at), node, np.int32), at, guest))
            continue
        far = np.bitwise_count((points[at] ^ np.uint64(node.vantage)) & np.uint64(node.mask)).astype(np.int16)
        inside = far <= node.mu
        after = left - np.where(inside, node.mu + 1 - far, far - node.mu)
        crossing = (after >= 0) & (guest | ~inside)
        for side, child in ((inside, node.inside), (~inside, node.outside)):
            over = ~side & crossing
            todo.append((
                child,
                np.concatenate([at[side], at[over]]),
                np.concatenate([left[side], after[over]]),
                np.concatenate([guest[side], np.ones(int(over.sum()), bool)]),
            ))
    if not visits:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(part) for part in zip(*visits))


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def local_groups(home: np.ndarray, guests: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its group) of all groups of two and more that ``home`` takes part in.

    Compares every home point with every other in tiles of bounded size.
    """
    points = np.unique(np.concatenate([home, guests]).view(np.int64)).view(np.uint64)
    rows = np.searchsorted(points.view(np.int64), np.unique(home.view(np.int64)))
    parent = np.arange(len(points))
    step = max(1, (1 << 21) // max(len(points), 1))
    for start in range(0, len(rows), step):
        block = rows[start : start + step]
        near = np.bitwise_count(points[block][:, None] ^ points[None, :]) <= radius
        left, right = np.nonzero(near)
        left = block[left]
        while True:
            parent = _roots(parent)
            a, b = parent[left], parent[right]
            apart = a != b
            if not apart.any():
                break
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    parent = _roots(parent)
    member = parent != np.arange(len(points))
    return points[member], points[parent[member]]


def near_groups(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (``a``, ``b``), b < a, that connect distinct fingerprints just as all pairs within ``radius`` do.

    ``prints`` has a long column ``fingerprint`` without repeats. At most one link per member and shard.
    """
    spark = prints.sparkSession
    n = prints.count()
    levels = min(MAX_LEVELS, max(0, int(np.ceil(np.log2(max(n, 1) / shard)))))
    share = F.pmod(F.xxhash64("fingerprint"), F.lit(max(n, SAMPLE))) < SAMPLE
    sample = [r[0] for r in prints.filter(share).select("fingerprint").collect()] if levels else []
    tree = spark.sparkContext.broadcast(build_tree(np.array(sample, dtype=np.int64).view(np.uint64), levels))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, index, guest = shards_of(tree.value, points, radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(points[index].view(np.int64)), pa.array(guest)], names=["shard", "point", "guest"]
            )

    visits = prints.select("fingerprint").mapInArrow(visit, "shard int, point long, guest boolean")
    if levels:
        visits = stored(visits, "simhash-visits")
    # One row per shard, at most 2 ** MAX_LEVELS.
    sizes = visits.groupBy("shard").agg(F.ceil(F.sum((~F.col("guest")).cast("long")) / (2 * shard)).alias("tiles"))
    tile = F.pmod(F.xxhash64("point"), F.greatest(F.col("tiles"), F.lit(1))).cast("int")
    last = F.when(F.col("guest"), F.greatest(F.col("tiles"), F.lit(1)) - 1).otherwise(F.col("tile")).cast("int")
    tiled = (
        visits.join(F.broadcast(sizes), "shard")
        .withColumn("tile", tile)
        .withColumn("at", F.explode(F.sequence(F.lit(0), last)))
        .select("shard", "at", "point", (F.col("guest") | (F.col("at") != F.col("tile"))).alias("guest"))
    )

    def compare(table: pa.Table) -> pa.Table:
        points = table.column("point").to_numpy().view(np.uint64)
        guest = table.column("guest").to_numpy()
        members, roots = local_groups(points[~guest], points[guest], radius)
        return pa.table({"a": members.view(np.int64), "b": roots.view(np.int64)})

    return tiled.groupBy("shard", "at").applyInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(``a``, ``b``): the smallest member ``b`` of the connected group of every ``a`` that isn't its own smallest.

    ``links`` has rows with b < a. Rounds: the parents of one point are linked to its smallest parent,
    then every point moves up to its parent's parent, until all are one step below a root. The work
    of a point lies in its few parents, so a point with very many children is no hot group.
    """
    edges = stored(links.distinct(), "simhash-links")
    while True:
        parent = edges.groupBy("a").agg(F.min("b").alias("p"), F.count("*").alias("parents"))
        several = parent.filter("parents > 1").limit(1).count()
        inner = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a").distinct(), "a").limit(1).count()
        if not several and not inner:
            return edges
        narrowed = (
            edges.join(parent, "a")
            .select(F.when(F.col("b") == F.col("p"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("p").alias("b"))
            .distinct()
        )
        narrowed = stored(narrowed, "simhash-links")
        up = narrowed.groupBy("a").agg(F.min("b").alias("p")).withColumnRenamed("a", "b")
        edges = stored(
            narrowed.join(up, "b", "left").select("a", F.coalesce("p", "b").alias("b")).distinct(), "simhash-links"
        )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shard: int = SHARD
) -> DataFrame:
    """``doc_id``, ``text_key``, ``fingerprint`` (16 hex digits), ``component_id``, ``group`` for every row of ``docs``.

    Rows whose fingerprints differ in ``radius`` or fewer bits are linked; ``component_id`` is the
    smallest id reachable, ``group`` a member fingerprint that names the group. Repeated rows give repeated rows. Null texts count as empty; texts without
    words share fingerprint 0 and are linked like any others. A row with a null id takes part, and
    only a group without any id has a null ``component_id``. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "simhash")
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    distinct = stored(distinct, "simhash-distinct")
    roots = components(near_groups(distinct, radius, shard))
    grouped = (
        distinct.join(roots.withColumnRenamed("a", "fingerprint"), "fingerprint", "left")
        .select("fingerprint", "first_id", F.coalesce("b", "fingerprint").alias("root"))
    )
    first = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = grouped.join(first, "root").select("fingerprint", "component_id", F.col("root").alias("group"))
    return prints.join(classes, "fingerprint").select(
        "doc_id", "text_key", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "group"
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs``, one for each group of near-duplicates: that of the smallest id (then text hash).

    Of a group without ids one row stays, too. Repeated rows count as one document.
    """
    groups = near_duplicates(docs, doc_id, text, radius)
    best = groups.groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best")
    )
    best = best.select(F.xxhash64("best.doc_id").alias(KEY[0]), F.col("best.text_key").alias(KEY[1]))
    return keyed_rows(docs, doc_id, text).dropDuplicates(KEY).join(best, KEY, "left_semi").select("row.*")
