"""BM25 over chunk tables: index tables, batch scoring, ranked lists.

The index is cut into parts by chunk, as search engines shard theirs, and the postings of a term in a part are blocks in
order of impact, each with a bound on what one of its postings can add to a score. A batch of queries first scores the
first blocks; the n-th best sum so far is a threshold that the n best chunks reach at least. A block is then skipped for a
query if even its bound and the most that all other terms can add stay below the threshold: no chunk in it is among the
n best, so the scores of those that are, are whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from snaptext import settings
from snaptext.functions import text as tx
from snaptext.operators import phrases
from snaptext.scale import is_small, shared_folder, small_side, spread, stored

CHUNK_KEYS = ["entity_id", "chunk_index"]
QUERY_KEYS = ["query_id", "sub_no"]
#: Postings of a block; parts of a small index per core.
BLOCK, PARTS = 256, 2
#: Chunks of a part, about and at most; queries that meet a part at once.
PART_CHUNKS, QUERY_BLOCK = 16_384, 4096
#: Scores are ranked to so many digits; thresholds leave room for one more.
DIGITS = 6


@dataclass
class LexicalIndex:
    """Stored index tables and the three corpus numbers that scoring needs."""

    blocks: DataFrame  # part, term, block_no, n, impact, max_body, max_title, min_body, min_title, the columns of ENTRY, block_id
    chunks: DataFrame  # chunk_no, entity_id, chunk_index; postings name chunks by number
    terms: DataFrame  # term, df, impact, max_body, max_title, min_body, min_title
    n_chunks: int
    total_body: int
    total_title: int
    mean_idf: float
    shape: tuple[int, float, float]  # title weight, k1 and b that ``impact`` holds for
    table_name: str

    @property
    def postings(self) -> DataFrame:
        """entity_id, chunk_index, term, tf_body, tf_title, len_body, len_title"""

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = pc.list_value_length(batch.column("chunk_no")).to_numpy(zero_copy_only=False)
                term = batch.column("term").take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
                yield pa.RecordBatch.from_arrays([term, *(pa.array(x) for x in entries(batch, *ENTRY))], names=["term", *ENTRY])

        rows = self.blocks.select("term", *ENTRY).mapInArrow(flat, "term string, chunk_no long, " + ", ".join(f"{c} int" for c in COUNTS))
        named = rows.join(self.chunks, "chunk_no")
        return named.select(*CHUNK_KEYS, "term", "tf_body", "tf_title", "len_body", "len_title")

    def drop(self) -> None:
        """Forget the table of blocks; its files go with the shared folder."""
        self.blocks.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table_name}")


def numbered_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with a number of their own, title and text in lower case and their numbers of tokens; stored, so that the numbers stay."""
    low = spread(chunks.select(*CHUNK_KEYS, F.lower("text").alias("body"), F.lower("title").alias("heading")), *CHUNK_KEYS)
    numbered = low.select(F.monotonically_increasing_id().alias("chunk_no"), *CHUNK_KEYS, "body", "heading")
    types = {f.name: f.dataType.simpleString() for f in numbered.schema} | {"len_body": "int", "len_title": "int"}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [pa.array(tx.n_low_tokens(batch.column(c)).astype(np.int32)) for c in ("body", "heading")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lengths], names=list(types))

    return stored(numbered.mapInArrow(count, ", ".join(f"{c} {t}" for c, t in types.items())), "numbered")


#: The columns of a posting. A block has an array of its chunks, and the bytes of an array of 32-bit integers for each of the counts:
#: rows then cost what they have columns, and not what they have postings.
COUNTS = ["tf_body", "tf_title", "len_body", "len_title"]
ENTRY = ["chunk_no", *COUNTS]
_BLOCK_COLUMNS = (
    "part int, term string, block_no int, n int, impact double, max_body int, max_title int, min_body int, min_title int, "
    "chunk_no array<long>, tf_body binary, tf_title binary, len_body binary, len_title binary"
)


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.BinaryArray:
    """Runs of ``values``, which start at ``offsets``, as bytes."""
    ends = pa.py_buffer((offsets * 4).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, ends, pa.py_buffer(values.astype("<i4"))])


def entries(blocks: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns of ENTRY, of the postings of all blocks one after the other."""
    found = []
    for name in names:
        column = blocks.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if name == "chunk_no":
            found.append(column.flatten().to_numpy(zero_copy_only=False))
        elif not len(column):
            found.append(np.zeros(0, np.int32))
        else:
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            data = column.buffers()[2]
            found.append(np.frombuffer(data, "<i4", (ends[-1] - ends[0]) // 4, ends[0]) if ends[-1] > ends[0] else np.zeros(0, np.int32))
    return found


def _blocks(numbered: DataFrame, block: int, title_weight: int, mean_length: float, k1: float, b: float) -> DataFrame:
    """The postings of each part, counted and cut into blocks. A chunk without a text or a title has none."""

    def cut(table: pa.Table) -> pa.Table:
        part, table = table.column("part")[0].as_py(), table.sort_by("chunk_no")
        (body, of_body), (title, of_title) = (tx.low_tokens(table.column(c).combine_chunks()) for c in ("body", "heading"))
        said = pa.concat_arrays([body, title]).dictionary_encode()
        n, chunk_no = table.num_rows, table.column("chunk_no").to_numpy()
        len_body, len_title = (np.bincount(x, minlength=n) for x in (of_body, of_title))
        # A term's number, its chunk's place and whether it is in the title, as one number.
        key = (said.indices.to_numpy().astype(np.int64) * n + np.append(of_body, of_title)) * 2
        key[len(body) :] += 1
        key, many = np.unique(key, return_counts=True)
        # In order already.
        pair = key // 2
        new = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
        pair, where = pair[new], np.cumsum(new) - 1
        tf_body, tf_title = (np.bincount(where[x], many[x], len(pair)).astype(np.int64) for x in (key % 2 == 0, key % 2 == 1))
        term, chunk = pair // n, pair % n
        impact = _added(tf_body, tf_title, len_body[chunk], len_title[chunk], title_weight, mean_length, k1, b)
        # The sort is stable, and chunks of a term stand in order.
        order = np.lexsort((-impact, term))
        term, chunk, impact, tf_body, tf_title = (x[order] for x in (term, chunk, impact, tf_body, tf_title))
        at = np.arange(len(term))
        first = np.maximum.accumulate(np.where(np.append(True, term[1:] != term[:-1]), at, 0)) if len(term) else at
        starts = np.flatnonzero((at - first) % block == 0)
        counts = [tf_body, tf_title, len_body[chunk], len_title[chunk]]
        if not len(starts):
            starts, extremes = at, [impact, *counts]
        else:
            extremes = [np.maximum.reduceat(x, starts) for x in (impact, tf_body, tf_title)] + [np.minimum.reduceat(x, starts) for x in counts[2:]]
        offsets = np.append(starts, len(at))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(chunk_no[chunk], pa.int64())), *(_packed(x, offsets) for x in counts)]
        held = np.diff(np.append(starts, len(at)))
        numbers = [pa.array(x, pa.int32()) for x in (np.full(len(starts), part), (at - first)[starts] // block, held, *extremes[1:])]
        columns = [numbers[0], said.dictionary.take(pa.array(term[starts])), *numbers[1:3], pa.array(extremes[0], pa.float64()), *numbers[3:], *lists]
        return pa.table(columns, names=[c.split()[0] for c in _BLOCK_COLUMNS.split(", ")])

    # Lengths are counted of texts and titles that both exist.
    whole = numbered.where("body is not null and heading is not null")
    return whole.select("part", "chunk_no", "body", "heading").groupBy("part").applyInArrow(cut, _BLOCK_COLUMNS)


def raw_idf(df: Column, n_chunks: int) -> Column:
    return F.log(F.lit(n_chunks) - df + 0.5) - F.log(df + 0.5)


def build_index(
    chunks: DataFrame,
    shards: int | None = None,
    title_weight: int = settings.TITLE_WEIGHT,
    k1: float = settings.BM25_K1,
    b: float = settings.BM25_B,
    block: int = BLOCK,
) -> LexicalIndex:
    """Write the index tables of ``chunks`` once for any number of query batches.

    Blocks are bucketed by part, and so by chunk: the parts of a chunk's score meet without a shuffle, and a frequent term
    is spread over all buckets. Queries with another title weight, ``k1`` or ``b`` get bounds that are less close.
    """
    spark = chunks.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = numbered_chunks(chunks)
    sizes = numbered.agg(F.count("*").alias("n"), F.sum("len_body").alias("body"), F.sum("len_title").alias("title")).first()
    n_chunks, body, title = sizes["n"], sizes["body"] or 0, sizes["title"] or 0
    # A part is what one task scores at once. The fewer parts there are, the fewer rows: a term has one at least in each part it is in.
    parts = max(min(PARTS * spark.sparkContext.defaultParallelism, PARTS * shards), -(-n_chunks // PART_CHUNKS))
    part = F.pmod(F.xxhash64("chunk_no"), F.lit(parts)).cast("int")
    mean_length = (body + title_weight * title) / max(n_chunks, 1)
    rows = _blocks(numbered.withColumn("part", part).repartition(shards, "part"), block, title_weight, mean_length, k1, b)
    name = f"snaptext_postings_{uuid.uuid4().hex}"
    (
        rows.withColumn("block_id", F.monotonically_increasing_id())
        .write.bucketBy(shards, "part")
        .option("path", f"{shared_folder(spark)}/{name}")
        .saveAsTable(name)
    )
    blocks = spark.table(name)
    over = [getattr(F, how)(c).alias(c) for c, how in (("impact", "max"), ("max_body", "max"), ("max_title", "max"), ("min_body", "min"), ("min_title", "min"))]
    terms = stored(blocks.groupBy("term").agg(F.sum("n").alias("df"), *over), "terms")
    mean_idf = terms.agg(F.avg(raw_idf(F.col("df"), n_chunks))).first()[0]
    named = numbered.select("chunk_no", *CHUNK_KEYS)
    return LexicalIndex(blocks, named, terms, n_chunks, body, title, mean_idf or 0.0, (title_weight, k1, b), name)


def idf_table(index: LexicalIndex, epsilon: float = settings.BM25_EPSILON) -> DataFrame:
    """Inverse document frequency; negative values become a share of the mean over all terms."""
    return index.terms.select("term", "df", _idf(index, epsilon).alias("idf"))


def _idf(index: LexicalIndex, epsilon: float) -> Column:
    raw = raw_idf(F.col("df"), index.n_chunks)
    return F.when(raw < 0, F.lit(epsilon * index.mean_idf)).otherwise(raw)


def alias_table(spark: SparkSession, aliases: dict[str, list[str]]) -> DataFrame:
    """(``phrase``, ``extra``) of a few aliases given in code."""
    return spark.createDataFrame(list(aliases.items()), "phrase string, extra array<string>")


def alias_terms(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Extra query tokens of every alias phrase that occurs in a lower-cased question, one row each.

    Phrases are distinct; any number of them.
    """
    asked = queries.select(*QUERY_KEYS, F.lower("text").alias("text"))
    found = phrases.matches(asked, QUERY_KEYS, aliases.select("phrase"))
    return found.join(small_side(aliases), "phrase").select(*QUERY_KEYS, F.explode("extra").alias("term"))


def query_terms(queries: DataFrame, aliases: DataFrame | dict[str, list[str]] | None = None) -> DataFrame:
    """Token counts of each query, alias tokens included; repeats count. ``aliases`` is a table (``phrase``, ``extra``), or a few in code."""
    terms = queries.select(*QUERY_KEYS, F.explode(tx.tokens(F.col("text"))).alias("term"))
    if isinstance(aliases, dict):
        aliases = alias_table(queries.sparkSession, aliases) if aliases else None
    if aliases is not None:
        terms = terms.unionByName(alias_terms(queries, aliases))
    return terms.groupBy(*QUERY_KEYS, "term").agg(F.count("*").alias("qtf"))


def _added(tf_body, tf_title, len_body, len_title, title_weight: int, mean_length: float, k1: float, b: float) -> np.ndarray:
    """What one term adds to a chunk's score, without the term's weight."""
    tf = tf_body + float(title_weight) * tf_title
    length = len_body + float(title_weight) * len_title
    # Without any token there is no mean length, and no posting either.
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def _mean_length(index: LexicalIndex, title_weight: int) -> float:
    return (index.total_body + title_weight * index.total_title) / max(index.n_chunks, 1)


def _bound(index: LexicalIndex, title_weight: int, k1: float, b: float) -> Column:
    """The most that a posting of a block, or of a term, can add without the term's weight."""
    if index.shape == (title_weight, k1, b):
        return F.col("impact")
    tf = F.col("max_body") + title_weight * F.col("max_title")
    length = F.col("min_body") + title_weight * F.col("min_title")
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(_mean_length(index, title_weight))))


def term_weights(index: LexicalIndex, terms: DataFrame, epsilon: float, most: Column) -> DataFrame:
    """Count in the query times idf, for every query term that the corpus has, and ``others``: what other terms can add at most."""
    found = index.terms.join(small_side(stored(terms, "query-terms")), "term")
    weight = F.col("qtf") * _idf(index, epsilon)
    weighed = found.select(*QUERY_KEYS, "term", weight.alias("weight"), (weight * most).alias("most"))
    # A term of negative weight, as in a tiny corpus, leaves the query without a threshold.
    query = Window.partitionBy(*QUERY_KEYS)
    others = F.when(F.min("weight").over(query) >= 0, F.sum("most").over(query) - F.col("most"))
    return weighed.withColumn("others", F.coalesce(others, F.lit(float("inf")))).drop("most")


def _numbered(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights by number of the query, and the numbers: sums by numbers cost less than by the keys themselves."""
    kept = stored(weights, "query-weights")
    asked = stored(kept.select(*QUERY_KEYS).distinct().withColumn("query_no", F.monotonically_increasing_id()), "queries")
    return stored(kept.join(small_side(asked), QUERY_KEYS).drop(*QUERY_KEYS), "weights"), asked


def _named(index: LexicalIndex, scored: DataFrame, asked: DataFrame) -> DataFrame:
    """Scores with the keys of their query and chunk."""
    rows = scored.join(small_side(asked), "query_no").join(index.chunks, "chunk_no")
    return rows.select(*QUERY_KEYS, *CHUNK_KEYS, "score")


def _matches(index: LexicalIndex, weights: DataFrame, small: bool, title_weight: int, k1: float, b: float) -> DataFrame:
    """A row for each query and block of one of its terms, with ``reach``: the best score that a chunk of the block can have."""
    joined = index.blocks.join(F.broadcast(weights) if small else weights, "term")
    return joined.withColumn("reach", F.col("weight") * _bound(index, title_weight, k1, b) + F.col("others"))


def _summed(
    index: LexicalIndex, matches: DataFrame, weights: DataFrame, small: bool, n_queries: int, n: int | None, title_weight: int, k1: float, b: float,
    some: str = "true",
) -> DataFrame:
    """Scores of the chunks in the given blocks; those of a chunk are in one part, and so in one bucket.

    ``some`` is what holds for all given blocks; no other ones are read.

    With ``n``, of each query and part the ``n`` best chunks and those that may tie with them; else all. Sums are taken of
    arrays, part by part; a batch of many queries meets a part in several groups.
    """
    by, asked = ["part"], matches.select("part", "block_id", "query_no", "weight")
    terms = weights.select("term").distinct()
    blocks = index.blocks.where(some).join(F.broadcast(terms) if small else terms, "term", "left_semi")
    # Names of their own, as ``matches`` come from the same table.
    blocks = blocks.select(F.col("part").alias("of_part"), F.col("block_id").alias("held_id"), *ENTRY)
    of = ["of_part"]
    groups = -(-n_queries // (QUERY_BLOCK if n else QUERY_BLOCK // 16))
    if groups > 1:
        by, of, asked = ["part", "some"], ["of_part", "group"], asked.withColumn("some", F.pmod(F.xxhash64("query_no"), F.lit(groups)).cast("int"))
        blocks = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    mean_length = _mean_length(index, title_weight)

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows:
            sizes = pc.list_value_length(held.column("chunk_no")).to_numpy().astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            chunk_no, tf_body, tf_title, len_body, len_title = entries(held, *ENTRY)
            impact = _added(tf_body, tf_title, len_body, len_title, title_weight, mean_length, k1, b)
            chunk, numbers = pd.factorize(chunk_no)
            asked = asked.sort_by([("query_no", "ascending"), ("block_id", "ascending")])
            held_id = held.column("held_id").to_numpy()
            order = np.argsort(held_id)
            place = order[np.searchsorted(held_id, asked.column("block_id").to_numpy(), sorter=order)]
            weight = asked.column("weight").to_numpy()
            queries, begin = np.unique(asked.column("query_no").to_numpy(), return_index=True)
            for query, low, high in zip(queries, begin, np.append(begin[1:], asked.num_rows)):
                mine = place[low:high]
                many = sizes[mine]
                at = np.repeat(starts[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
                score = np.bincount(chunk[at], np.repeat(weight[low:high], many) * impact[at], len(numbers))
                hit = np.zeros(len(numbers), bool)
                hit[chunk[at]] = True
                some = np.flatnonzero(hit)
                if n and len(some) > n:
                    least = np.partition(score[some], len(some) - n)[len(some) - n] - 10.0 ** (1 - DIGITS)
                    some = some[score[some] >= least]
                found.append((np.full(len(some), query), numbers[some], score[some]))
        query, number, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([pa.array(query), pa.array(number), pa.array(score)], names=["query_no", "chunk_no", "score"])

    return asked.groupBy(*by).cogroup(blocks.groupBy(*of)).applyInArrow(meet, "query_no long, chunk_no long, score double")


def scores(
    index: LexicalIndex,
    terms: DataFrame,
    title_weight: int = settings.TITLE_WEIGHT,
    k1: float = settings.BM25_K1,
    b: float = settings.BM25_B,
    epsilon: float = settings.BM25_EPSILON,
) -> DataFrame:
    """BM25 of every chunk that shares a term with a query, one row per pair; no block is skipped.

    The title counts ``title_weight`` times. Query terms are broadcast when measured to be small.
    """
    weights, asked = _numbered(term_weights(index, terms, epsilon, _bound(index, title_weight, k1, b)))
    small = is_small(weights)
    matches = _matches(index, weights, small, title_weight, k1, b)
    return _named(index, _summed(index, matches, weights, small, asked.count(), None, title_weight, k1, b), asked)


def first_n(df: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each group with their rank; only n rows per group and task are shuffled."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def needed_blocks(
    index: LexicalIndex, weights: DataFrame, n: int, small: bool, title_weight: int, k1: float, b: float
) -> DataFrame:
    """The blocks that may hold one of the ``n`` best chunks of a query, as ``_matches``."""
    matches = _matches(index, weights, small, title_weight, k1, b)
    n_queries = weights.select("query_no").distinct().count()
    begins = "block_no = 0"
    first = _summed(index, matches.where(begins), weights, small, n_queries, n, title_weight, k1, b, begins)
    nth = first_n(first, n, ["query_no"], [F.desc("score")]).where(F.col("rank") == n)
    # At most one row per query, and a query has at least one row in the weights.
    thresholds = stored(nth.select("query_no", (F.col("score") - 10.0**-DIGITS).alias("least")), "thresholds")
    known = matches.join(F.broadcast(thresholds) if small else thresholds, "query_no", "left")
    return known.where(F.col("reach") >= F.coalesce("least", F.lit(float("-inf")))).drop("least")


def lexical_hits(
    index: LexicalIndex,
    queries: DataFrame,
    n: int = settings.CANDIDATES,
    aliases: DataFrame | dict[str, list[str]] | None = None,
    title_weight: int = settings.TITLE_WEIGHT,
    k1: float = settings.BM25_K1,
    b: float = settings.BM25_B,
    epsilon: float = settings.BM25_EPSILON,
) -> DataFrame:
    """The ``n`` best chunks of each query; ties go by entity and position.

    Only chunks that share a term with the query are ranked. Scores are rounded to ``DIGITS`` places before ranking.
    """
    terms = query_terms(queries, aliases)
    weights, asked = _numbered(term_weights(index, terms, epsilon, _bound(index, title_weight, k1, b)))
    small = is_small(weights)
    needed = needed_blocks(index, weights, n, small, title_weight, k1, b)
    scored = _summed(index, needed, weights, small, asked.count(), n, title_weight, k1, b).withColumn("score", F.round("score", DIGITS))
    # Those that tie with the last one stay until their keys, by which ties are decided, are known.
    place = F.rank().over(Window.partitionBy("query_no").orderBy(F.desc("score")))
    best = scored.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
    order = [F.desc("score"), F.asc("entity_id"), F.asc("chunk_index")]
    return first_n(_named(index, best, asked), n, QUERY_KEYS, order).select(*QUERY_KEYS, "rank", *CHUNK_KEYS, "score")
