"""Importance resampling of documents towards a target distribution.

A text's features are all runs of one to three consecutive words, hashed into buckets. Two multinomials over the
buckets, of a target corpus and of all documents, give each bucket a gain, kept in an array; a document weighs the
sum of the gains of its features. Adding Gumbel noise of the document's id to the weight and taking the highest
scores draws documents without replacement in proportion to their importance.

Ranks come from a distributed radix sort from the least significant digit: the composite key of score and id is cut
into digits, and each pass is one stable counting sort of the whole table (``counting.ranked``) whose prefix offsets
are every row's next place. Rows never meet in one task, and a pass is stored, so that lost executors cost one pass.

Words are found and hashed in numpy inside the tasks; CRC-32 of a run of words is put together from those of the
words, since it is linear. What the driver gets is one number per bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from snaptext.llm.counting import block_rows, digit, numbered, ranked
from snaptext.scale import stored

BUCKETS = 10_000
LONGEST_RUN = 3
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
#: Bits of a digit, at most: one counting pass has as many counters per block.
DIGIT_BITS = 12
#: Bytes of text whose words are in memory at once.
AT_ONCE = 1 << 20

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_TABLED = 64


def _shift_tables() -> np.ndarray:
    """For each number of bytes, what those bytes appended to a text turn each byte of its CRC into."""
    tables = np.zeros((_TABLED + 1, 4, 256), np.uint32)
    for n in range(_TABLED + 1):
        zeros = bytes(n)
        own = zlib.crc32(zeros)
        tables[n] = [[zlib.crc32(zeros, v << (8 * k)) ^ own for v in range(256)] for k in range(4)]
    return tables


_SHIFT: list[np.ndarray] = []


def _appended(crc: np.ndarray, words: list[bytes], crc_of_word: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts whose CRCs are given, each with a word appended; ``length`` and ``crc_of_word`` are those of the word."""
    if not _SHIFT:
        _SHIFT.append(_shift_tables())
    t, n = _SHIFT[0], np.minimum(length, _TABLED)
    out = t[n, 0, crc & 255] ^ t[n, 1, (crc >> 8) & 255] ^ t[n, 2, (crc >> 16) & 255] ^ t[n, 3, crc >> 24] ^ crc_of_word
    for i in np.flatnonzero(length > _TABLED):
        out[i] = zlib.crc32(words[i], int(crc[i]))
    return out


def _pieces(texts: Iterable[bytes | None], at_once: int) -> Iterator[tuple[int, list[bytes], int]]:
    """(number of the text, words, how many of them were in the piece before): long texts come in several pieces."""
    for number, text in enumerate(texts):
        text = (text or b"").translate(_LETTERS)
        at, last = 0, []
        while at < len(text):
            end = len(text) if len(text) - at <= at_once else text.find(b" ", at + at_once)
            end = len(text) if end < 0 else end
            words = last + text[at:end].split()
            yield number, words, len(last)
            last, at = words[1 - LONGEST_RUN :], end


def features(texts: Iterable[bytes | None], buckets: int = BUCKETS, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (number of the text, bucket, words in the run) of the features of UTF-8 texts, for some texts at a time."""
    numbers, sizes, olds, words, held = [], [], [], [], 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spaced = [b" " + w for w in dict.fromkeys(words)]
        index = {w[1:]: i for i, w in enumerate(spaced)}
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        single = np.fromiter((zlib.crc32(w[1:]) for w in spaced), np.uint32, len(spaced))[at]
        after = np.fromiter(map(zlib.crc32, spaced), np.uint32, len(spaced))[at]
        length = np.fromiter(map(len, spaced), np.int64, len(spaced))[at]
        size = np.array(sizes)
        piece = np.repeat(np.arange(size.size), size)
        place = np.arange(at.size) - np.repeat(np.cumsum(size) - size, size)
        text, fresh = np.repeat(numbers, size), place >= np.repeat(olds, size)
        found, run = [], single
        for n in range(LONGEST_RUN):
            if n:
                longer = np.zeros_like(run)
                i = np.flatnonzero(place >= n)
                longer[i] = _appended(run[i - 1], _At(spaced, at[i]), after[i], length[i])
                run = longer
            i = np.flatnonzero(fresh & (place >= n))
            found.append((text[i], (run[i] % np.uint32(buckets)).astype(np.int64), np.full(i.size, n + 1)))
        return tuple(np.concatenate(parts) for parts in zip(*found))

    for number, some, old in _pieces(texts, at_once):
        numbers.append(number), sizes.append(len(some)), olds.append(old)
        words += some
        held += sum(map(len, some))
        if held >= at_once:
            yield flush()
            numbers, sizes, olds, words, held = [], [], [], [], 0
    if words:
        yield flush()


class _At:
    """Words by place, looked up only where needed."""

    def __init__(self, words: list[bytes], at: np.ndarray):
        self.words, self.at = words, at

    def __getitem__(self, i: int) -> bytes:
        return self.words[self.at[i]]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Counted per task, then summed; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in features((t.as_py() for t in batch.column(0)), buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = texts.select(F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed target and raw shares of each bucket, rounded down."""
    all_raw, all_target, k = float(raw.sum() + raw.size), float(target.sum() + target.size), 1000
    ratios = [((t + 1.0) * all_raw) / ((s + 1.0) * all_target) for s, t in zip(raw.tolist(), target.tolist())]
    return np.array([math.floor(k * math.log(r)) for r in ratios], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``n_words``, ``n_features``, ``weight``), all long but the id, of every row."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(gain)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.astype(np.float64)
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for of, bucket, size in features((t.as_py() for t in batch.column("text")), gain.size):
                n_features += np.bincount(of, minlength=n)
                n_words += np.bincount(of[size == 1], minlength=n)
                weight += np.bincount(of, gain[bucket], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n_words, n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, weight long")


def radix_ranks(rows: DataFrame, parts: list[tuple[str, int]], n: int, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """``rows`` (stored, with a long ``pos``) with ``pos`` from 0 in the order of a composite key.

    ``parts`` are columns of unsigned longs with their number of bits, most significant first; ``n`` is the number of rows.
    Rows of an equal key keep their order.
    """
    bits = sum(b for _, b in parts)
    passes = max(1, math.ceil(bits / digit_bits))
    width = max(1, math.ceil(bits / passes))
    block = block_rows(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = [(F.col(c), b) for c, b in parts]
    for number in range(passes):
        placed = ranked(rows, digit(columns, number * width, width), block, across=1 << width)
        rows = stored(placed.drop("pos").withColumnRenamed("rank", "pos"), f"radix-{number}")
    return rows


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, digit_bits: int = DIGIT_BITS,
) -> DataFrame:
    """Every row's ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (1, 2, 3... of those drawn, else null).

    Drawn are ``percent`` of a hundred, rounded down, of the rows with at least ``least_words`` words: the highest scores,
    ties to the smaller id. Ids are integers. A null id counts as an empty string in the noise and comes last among ties. Null
    and empty texts have no features and weigh 0. Repeated rows are drawn apart and get ranks of their own. Empty
    tables give no rows; an empty target has smoothed counts only. Other columns are ignored.
    """
    raw, wanted = bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets)
    weighed = weights(docs, gains(raw, wanted), doc_id, text)
    drawn_by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    noise = (F.conv(F.substring(drawn_by, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(noise))).cast("long")
    scored = numbered(weighed.withColumn("score", score), "scored")

    able = scored.filter(F.col("n_words") >= least_words)
    found = able.agg(
        F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"),
        F.min("doc_id").cast("long").alias("first"), F.max("doc_id").cast("long").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("none"),
    ).first()
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    n = found["n"]
    if not n:
        return rest
    first, last = found["first"] or 0, found["last"] or 0
    id_bits = (last - first).bit_length()
    # Ids that span more than half of all longs are compared as they are, with the sign turned.
    own = F.col("doc_id").cast("long")
    id_key = own - F.lit(first).cast("long") if id_bits < 64 else own.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    keyed = able.withColumns(
        {"_score": F.lit(found["high"]).cast("long") - F.col("score"), "_none": F.col("doc_id").isNull().cast("long"), "_id": F.coalesce(id_key, F.lit(0))}
    )
    parts = [("_score", (found["high"] - found["low"]).bit_length()), ("_none", int(found["none"] > 0)), ("_id", id_bits)]
    in_order = radix_ranks(keyed, parts, n, digit_bits)
    drawn = F.when(F.col("pos") < percent * n // 100, F.col("pos") + 1)
    return in_order.select(*columns, drawn.alias("rank")).unionByName(rest)
