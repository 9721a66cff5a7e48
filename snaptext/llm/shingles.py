"""Near-duplicate groups by exact Jaccard similarity of five-word shingles.

Texts with equal shingle sets are one set. Candidates have SimHash fingerprints, of the same shingles, that the vantage-point
tree of ``simhash`` connects, or share one of ``BANDS`` keys, each made of ``ROWS``
minimum hashes; a pair at the threshold has none in common with a probability of (1 - 0.8 ** 5) ** 60, less
than 1 in 10 ** 10, and a closer pair with a smaller one. Keys are never rows of pairs: sets that share one are joined
into candidate groups, and only inside these are shingles compared, all with all, by their exact Jaccard
similarity. Groups are cut into tiles of bounded size and every two tiles meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from snaptext.llm.common import KEY, keyed_rows, whole
from snaptext.llm.simhash import SEED, _LOWER, _roots, components, near_groups, simhash
from snaptext.scale import stored

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 60, 5
#: Shingles and sets of one tile, about.
TILE_SHINGLES, TILE_SETS = 1 << 20, 2048

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 512


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of five words; of all its words if it has fewer; empty without any."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    hashed = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    n = len(words) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for i in range(WORDS):
        out = _mixed(out + hashed[i : i + n])
    return np.unique(out)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _BLOCK):
        least = np.minimum(least, (found[at : at + _BLOCK, None] * _FACTORS).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys + part)
    return keys.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``text_key``, ``set_key``, ``n``, ``fingerprint``, ``bands``) for every row of (``doc_id``, ``text``).

    ``set_key`` names the set of shingles and ``n`` is its size; ``fingerprint`` is the SimHash of the shingles. A null text counts as empty.
    """
    text = whole("text")
    named = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.cast("binary").alias("bytes"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prints, bands = [], [], [], []
            for t in batch.column("bytes"):
                found = shingles(t.as_py())
                prints.append(simhash(t.as_py(), WORDS))
                keys.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                bands.append(band_keys(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(np.array(keys, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(prints, np.uint64).view(np.int64)),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "set_key", "n", "fingerprint", "bands"],
            )

    return named.mapInArrow(run, f"doc_id {id_type}, text_key long, set_key long, n long, fingerprint long, bands array<long>")


def candidate_links(distinct: DataFrame) -> DataFrame:
    """Links (``a``, ``b``), b < a, of sets to the least one that shares a band with them, or whose fingerprint is connected to theirs.

    ``distinct`` has a row (``set_key``, ``n``, ``fingerprint``, ``bands``) per set. Sets without a shingle are no candidates.
    """
    banded = distinct.select("set_key", F.explode("bands").alias("at")).repartition("at")
    prints = distinct.filter("n > 0").select("set_key", "fingerprint")
    roots = components(near_groups(stored(prints.select("fingerprint").distinct(), "shingles-prints")))
    near = prints.join(roots.withColumnRenamed("a", "fingerprint"), "fingerprint", "left").select("set_key", F.coalesce("b", "fingerprint").alias("at"))
    links = []
    for named in (banded, near):
        hubs = named.groupBy("at").agg(F.min("set_key").alias("hub"), F.count("*").alias("sets")).filter("sets > 1")
        links.append(named.join(hubs, "at").filter("set_key != hub").select(F.col("set_key").alias("a"), F.col("hub").alias("b")))
    return links[0].unionByName(links[1])


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its group) by number in ``sets``, from all pairs of ``left`` and ``right``."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(right, sizes[right])
    every = np.concatenate([sets[i] for i in right]) if len(right) else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    parent = np.arange(len(sets))
    for x in left:
        start, end = np.searchsorted(every, sets[x], "left"), np.searchsorted(every, sets[x], "right")
        many = end - start
        at = np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((shared > 0) & (shared >= similarity * (sizes[x] + sizes - shared)))
        if len(near):
            roots = np.unique(parent[np.append(near, x)])
            parent[np.isin(parent, roots)] = roots[0]
    parent = _roots(parent)
    member = np.flatnonzero(parent != np.arange(len(sets)))
    return member, parent[member]


def tiles(distinct: DataFrame, roots: DataFrame, tile_shingles: int, tile_sets: int) -> DataFrame:
    """(``set_key``, ``text_key``, ``place``, ``tile``, ``tiles``) of every set in a candidate group of two and more.

    Groups of one tile share places, about as many as fit a tile.
    """
    grouped = roots.select(F.col("a").alias("set_key"), F.col("b").alias("root"))
    grouped = grouped.unionByName(roots.select(F.col("b").alias("set_key"), F.col("b").alias("root")).distinct())
    members = stored(distinct.select("set_key", "text_key", "n").join(grouped, "set_key"), "shingles-members")
    needed = F.ceil(F.greatest(F.sum("n") / tile_shingles, F.count("*") / tile_sets)).cast("int")
    sizes = members.groupBy("root").agg(needed.alias("tiles"), F.sum("n").alias("all"), F.count("*").alias("sets"))
    sizes = stored(sizes, "shingles-sizes")
    small = sizes.filter("tiles = 1").agg(F.sum("all").alias("all"), F.sum("sets").alias("sets")).first()
    places = int(max((small["all"] or 0) / tile_shingles, (small["sets"] or 0) / tile_sets)) + 1
    return members.join(sizes.select("root", "tiles"), "root").select(
        "set_key",
        "text_key",
        F.when(F.col("tiles") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(places))).alias("place"),
        F.pmod(F.xxhash64("set_key"), F.col("tiles")).cast("int").alias("tile"),
        "tiles",
    )


def similar_sets(
    docs: DataFrame, placed: DataFrame, similarity: float = SIMILARITY
) -> DataFrame:
    """Links (``a``, ``b``), b < a, that connect the sets of ``placed`` just as all pairs of a place at ``similarity`` do.

    ``docs`` has ``text``; of the texts with one key one is taken.
    """
    texts = docs.select(F.xxhash64(whole("text")).alias("text_key"), whole("text").cast("binary").alias("bytes"))
    needed = texts.dropDuplicates(["text_key"]).join(placed, "text_key").select("set_key", "place", "tile", "tiles", "bytes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingles(t.as_py()).tobytes() for t in batch.column("bytes")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], found], names=["set_key", "place", "tile", "tiles", "found"])

    rows = needed.mapInArrow(cut, "set_key long, place long, tile int, tiles int, found binary")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "set_key", "place", F.col("tiles") > 1, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "found"
    ).toDF("set_key", "place", "cut", "low", "high", "tile", "found")

    def compare(table: pa.Table) -> pa.Table:
        keys, order = np.unique(table.column("set_key").to_numpy(), return_index=True)
        table = table.take(pa.array(order))
        sets = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("found")]
        tile, low, high = (table.column(c).to_numpy() for c in ("tile", "low", "high"))
        member, root = similar(sets, np.flatnonzero(tile == low), np.flatnonzero(tile == high), similarity)
        return pa.table({"a": keys[member], "b": keys[root]})

    return rows.groupBy("place", "cut", "low", "high").applyInArrow(compare, "a long, b long")


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
    tile_shingles: int = TILE_SHINGLES, tile_sets: int = TILE_SETS,
) -> DataFrame:
    """Rows of ``docs``, one for each group of near-duplicates: that of the smallest id (then text hash).

    Texts whose shingle sets have a Jaccard similarity of ``similarity`` (0.8 or more) are linked, and groups are what
    links connect. Texts without words are one group. Of a group without ids one row stays, too.
    Repeated rows count as one document.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = stored(sketches(named), "shingles")
    distinct = prints.groupBy("set_key").agg(
        F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.min_by("fingerprint", "text_key").alias("fingerprint"), F.first("bands").alias("bands")
    )
    distinct = stored(distinct, "shingles-distinct")
    placed = stored(tiles(distinct, components(candidate_links(distinct)), tile_shingles, tile_sets), "shingles-placed")
    roots = components(similar_sets(named, placed, similarity))
    best = (
        prints.select("doc_id", "text_key", "set_key")
        .join(roots.select(F.col("a").alias("set_key"), F.col("b").alias("root")), "set_key", "left")
        .groupBy(F.coalesce("root", "set_key").alias("group"))
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    )
    best = best.select(F.xxhash64("best.doc_id").alias(KEY[0]), F.col("best.text_key").alias(KEY[1]))
    return keyed_rows(docs, doc_id, text).dropDuplicates(KEY).join(best, KEY, "left_semi").select("row.*")
