"""Language identification with interpolated Kneser-Ney character models.

Per language one model of order 4 over lower-cased letters, every run of other characters being one
space. Counts of all training texts are added up by Spark; the tables of all languages share sorted
arrays of hashed n-grams with one row of log-probabilities each, so that a character costs one binary
search for all languages together. The hash is a bijection of the packed n-gram: nothing collides.

    p(c | h) = max(n(hc) - D, 0) / n(h) + D * types(h) / n(h) * p(c | shorter h)

with raw counts at the highest order, numbers of distinct left neighbours below it, D = n1 / (n1 + 2 n2)
per order, and a uniform floor under the single characters.

The language of the lowest cross-entropy per character wins. Its score comes from a logistic fit of
"was right" on the margin to the runner-up, over all documents of a calibration fold that the counts
leave out; ``accepted`` is false for scores below a half and for cross-entropies that only few of the
calibration documents of that language reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from snaptext.scale import stored

ORDER = 4
UNKNOWN = "und"
#: Largest number of highest-order n-grams that a model may have (16 bytes each, and 4 per language).
#: Above it, n-grams seen least often are left to the lower orders, by whole count classes.
MAX_GRAMS = 4_000_000
#: Share of the calibration documents of a language that the cross-entropy limit rejects.
REJECT_SHARE = 0.002
_START, _SPACE, _OTHER = 1, 32, 2
_FLUSH = 1 << 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point its symbol: lower-case letter below 65536, another letter 2, else space."""
    table = np.full(0x110000, _SPACE, dtype=np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 and ord(low) < 65536 else ord(c) if i < 65536 else _OTHER
    return table


def symbols(text: str) -> np.ndarray:
    """Symbols of a text, single spaces at both ends; empty if it has no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = _letters()[codes]
    out = np.concatenate([[np.uint16(_SPACE)], out, [np.uint16(_SPACE)]])
    blank = out == _SPACE
    out = out[~(blank & np.concatenate([[False], blank[:-1]]))]
    return out if len(out) > 1 else out[:0]


def grams(text: str) -> np.ndarray:
    """Packed highest-order n-gram of each symbol of a text but the first space."""
    s = symbols(text)
    if not len(s):
        return np.zeros(0, dtype=np.uint64)
    s = np.concatenate([np.full(ORDER - 2, _START, np.uint16), s]).astype(np.uint64)
    n = len(s) - ORDER + 1
    packed = np.zeros(n, dtype=np.uint64)
    for i in range(ORDER):
        packed = (packed << np.uint64(16)) | s[i : i + n]
    return packed


def hashed(packed: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = packed.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def _suffix(packed: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols."""
    return packed & np.uint64((1 << (16 * order)) - 1)


@dataclass
class Table:
    """Sorted hashes and a row of values per hash, a column per language."""

    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, packed: np.ndarray, values: np.ndarray) -> Table:
        h = hashed(packed)
        at = np.argsort(h)
        return cls(h[at], values[at].astype(np.float32))

    def find(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, whether it was found) for each n-gram."""
        h = hashed(packed)
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == h


@dataclass
class Model:
    """``grams[k]`` holds log p of the n-grams of order k, ``backoff[k]`` log weights of their contexts."""

    langs: list[str]
    grams: dict[int, Table] = field(default_factory=dict)
    backoff: dict[int, Table] = field(default_factory=dict)
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def logs(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log p of each n-gram (its last symbol after the others), one column per language."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(packed), len(self.langs)))
        at, found = self.grams[order].find(packed)
        out = self.grams[order].values[at] if len(self.grams[order].hashes) else np.zeros((len(packed), len(self.langs)), np.float32)
        if not found.all():
            rest = packed[~found]
            lower = self.logs(_suffix(rest, order - 1), order - 1)
            row, known = self.backoff[order].find(rest >> np.uint64(16))
            weight = np.where(known[:, None], self.backoff[order].values[row] if len(self.backoff[order].hashes) else 0.0, 0.0)
            out[~found] = weight + lower
        return out

    def entropies(self, text: str) -> np.ndarray | None:
        """Nats per character under each language; None for a text without letters."""
        packed = grams(text)
        if not len(packed):
            return None
        return np.concatenate(
            [-self.logs(packed[i : i + _FLUSH]).sum(axis=0, dtype=np.float64)[None] for i in range(0, len(packed), _FLUSH)]
        ).sum(axis=0) / len(packed)


def estimate(langs: list[str], lang: np.ndarray, packed: np.ndarray, counts: np.ndarray) -> Model:
    """Model from (language number, packed n-gram of the highest order, count), without repeats."""
    model = Model(langs)
    stats: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {ORDER: (lang, packed, counts.astype(np.int64))}
    for order in range(ORDER - 1, 0, -1):
        above_lang, above, _ = stats[order + 1]
        # Each distinct n-gram above is one distinct left neighbour.
        key = np.stack([above_lang.astype(np.uint64), _suffix(above, order)], axis=1)
        distinct, n = np.unique(key, axis=0, return_counts=True)
        stats[order] = distinct[:, 0].astype(np.int64), distinct[:, 1], n
    n_langs = len(langs)
    alphabet = [max(1, int((stats[1][0] == k).sum())) for k in range(n_langs)]
    model.floor = np.log(1.0 / (np.array(alphabet) + 1.0)).astype(np.float32)
    for order in range(1, ORDER + 1):
        of, gram, n = stats[order]
        union, row = np.unique(gram, return_inverse=True)
        context, context_row = np.unique(union >> np.uint64(16), return_inverse=True)
        c = np.zeros((len(union), n_langs))
        c[row, of] = n
        total = np.zeros((len(context), n_langs))
        types = np.zeros((len(context), n_langs))
        np.add.at(total, context_row, c)
        np.add.at(types, context_row, c > 0)
        n1, n2 = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        discount = np.where(n1 > 0, n1 / np.maximum(n1 + 2.0 * n2, 1), 0.5)
        discount = np.clip(discount, 0.05, 0.95)
        seen = total > 0
        weight = np.where(seen, discount * types / np.where(seen, total, 1), 1.0)
        lower = np.exp(model.logs(_suffix(union, order - 1), order - 1).astype(np.float64))
        p = np.maximum(c - discount, 0) / np.where(seen, total, 1)[context_row] + weight[context_row] * lower
        model.grams[order] = Table.of(union, np.log(p))
        model.backoff[order] = Table.of(context, np.log(weight))
    return model


def count_grams(texts: DataFrame) -> DataFrame:
    """(``lang``, ``gram``, ``n``) over all rows of (``lang``, ``text``); each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[str, int] = {}
        loose: dict[str, list[np.ndarray]] = {}

        def fold(lang: str) -> None:
            keys, n = np.unique(np.concatenate(loose.pop(lang)), return_counts=True)
            parts = [*held.get(lang, []), (keys, n)]
            if len(parts) > 8:
                every, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                sums = np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(every))
                parts = [(every, sums.astype(np.int64))]
            held[lang], size[lang] = parts, 0

        def rows(lang: str) -> Iterator[pa.RecordBatch]:
            for keys, n in held.pop(lang):
                for i in range(0, len(keys), 100_000):
                    k = keys[i : i + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(k)), pa.array(k), pa.array(n[i : i + 100_000].astype(np.int64))], names=["lang", "gram", "n"]
                    )

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                lang, packed = lang.as_py(), grams(text.as_py())
                loose.setdefault(lang, []).append(packed)
                size[lang] = size.get(lang, 0) + len(packed)
                if size[lang] > _FLUSH:
                    fold(lang)
                    if sum(len(k) for k, _ in held[lang]) > 2 * MAX_GRAMS:
                        yield from rows(lang)
        for lang in list(loose):
            fold(lang)
        for lang in list(held):
            yield from rows(lang)

    partial = texts.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(texts: DataFrame, max_grams: int = MAX_GRAMS) -> Model:
    """Model of all rows of (``lang``, ``text``) that have both."""
    counts = stored(count_grams(texts.filter("lang is not null and text is not null")), "langid-counts")
    classes = counts.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count("*").alias("rows")).collect()
    least, room = 1001, max_grams
    for r in sorted(classes, key=lambda r: -r["n"]):
        room -= r["rows"]
        if room < 0:
            break
        least = r["n"]
    if classes and least == 1001:
        raise ValueError(f"more than {max_grams} n-grams occur 1000 times or more: raise max_grams")
    rows = counts.filter(F.col("n") >= least).toArrow()
    names = rows.column("lang").combine_chunks().dictionary_encode() if rows.num_rows else None
    langs = sorted(names.dictionary.to_pylist()) if rows.num_rows else []
    order = {name: i for i, name in enumerate(langs)}
    lang = np.array([order[x] for x in names.dictionary.to_pylist()])[names.indices.to_numpy()] if langs else np.zeros(0, np.int64)
    packed = rows.column("gram").to_numpy().view(np.uint64) if langs else np.zeros(0, np.uint64)
    n = rows.column("n").to_numpy() if langs else np.zeros(0, np.int64)
    return estimate(langs, lang, packed, n)


def best(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without ``text``, plus ``lang_pred``, ``entropy`` (nats per character) and ``margin``.

    The margin is the total lead over the runner-up relative to the square root of the length; with
    one language only, the lead over its uniform floor. All three are null where there is no letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, entropy, margin = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                h = m.entropies(text) if text and m.langs else None
                if h is None:
                    lang.append(None), entropy.append(None), margin.append(None)
                    continue
                first = int(np.argmin(h))
                rest = np.delete(h, first).min() if len(h) > 1 else float(-m.floor[0])
                lang.append(m.langs[first]), entropy.append(float(h[first]))
                margin.append(float((rest - h[first]) * np.sqrt(len(text))))
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lang, pa.string()), pa.array(entropy, pa.float64()), pa.array(margin, pa.float64())],
                names=[*[f.name for f in kept], "lang_pred", "entropy", "margin"],
            )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return docs.mapInArrow(run, f"{schema}lang_pred string, entropy double, margin double")


def fit_logistic(x: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> tuple[float, float]:
    """(a, b) of p = 1 / (1 + exp(-(a + b x))) for bins with counts; one more success and failure keep it finite."""
    if not len(x):
        return 0.0, 1.0
    target = (right + 1.0 / len(x)) / (right + wrong + 2.0 / len(x))
    n = right + wrong + 2.0 / len(x)
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([np.sum(n * (target - p)), np.sum(n * (target - p) * x) - 1e-3 * b])
        w = n * p * (1 - p) + 1e-9
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], max(0.0, b + step[1])
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def predict(docs: DataFrame, held_out: Column, calibrate: Column, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``cross_entropy``, ``accepted``) for every row.

    ``docs`` has ``doc_id``, ``text``, ``lang``. Rows that are neither held out nor in the calibration
    fold are counted. Texts that are null or without a letter get ``und``, score 0 and are not accepted;
    so does every text if nothing could be learned. Otherwise the prediction is always a learned
    language. Null ids are never held out. Repeated rows give repeated rows.
    """
    rows = docs.select(
        "doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(calibrate, F.lit(False)).alias("calibrate")
    )
    model = train(rows.filter("not held_out and not calibrate"), max_grams)
    scored = stored(best(rows, model), "langid-scored")
    fold = scored.filter("calibrate and not held_out and lang is not null and lang_pred is not null")
    # At most 401 bins and one limit per language come to the driver.
    bins = (
        fold.groupBy(F.least(F.round(F.col("margin") * 20), F.lit(400)).alias("bin"))
        .agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.count("*").cast("double").alias("n"))
        .collect()
    )
    bins = sorted(bins, key=lambda r: r["bin"])
    right, n = np.array([r["right"] for r in bins]), np.array([r["n"] for r in bins])
    a, b = fit_logistic(np.array([r["bin"] / 20 for r in bins]), right, n - right)
    own = fold.filter("lang = lang_pred").groupBy("lang").agg(F.percentile_approx("entropy", 1 - REJECT_SHARE, 10_000).alias("h"))
    limits = {r["lang"]: r["h"] for r in own.collect()}
    limit = F.lit(None).cast("double")
    if limits:
        limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("lang_pred"))
    score = F.when(F.col("lang_pred").isNull(), 0.0).otherwise(1 / (1 + F.exp(-(a + b * F.col("margin")))))
    return scored.select(
        "doc_id",
        "held_out",
        F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
        score.alias("score"),
        F.col("entropy").alias("cross_entropy"),
        F.coalesce(F.col("lang_pred").isNotNull() & (score >= 0.5) & (F.col("entropy") <= F.coalesce(limit, F.lit(float("inf")))), F.lit(False)).alias("accepted"),
    )
