"""The rounds of ``textdiff.aligned`` over arrays: both sides of many pairs at once, without a row for each word.

A side has its words in order of their pair and position. The words without a partner that stand between the same two
partners are a run, and runs of both sides meet by number. A round is a few passes over arrays, and a sort where words are
looked for that occur once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from snaptext.functions import text as tx

#: Bytes of texts that are aligned at once, about; a pair is never parted.
AT_ONCE = 1 << 19
#: Letters as small numbers: of the normalised texts.
_LETTERS = np.zeros(256, np.int32)
_LETTERS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = np.arange(36)


@dataclass
class Side:
    """``pair`` and ``pos`` in order, ``word`` as a number; ``partner`` is the position of the same word on the other side, or -1."""

    pair: np.ndarray
    pos: np.ndarray
    word: np.ndarray
    #: Of each word the last one at its position, if several texts have the same key.
    last: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.partner = np.full(len(self.pair), -1, np.int32)

    def gaps(self) -> np.ndarray:
        """Numbers that grow with the pair and with each partner, the same ones on both sides."""
        found = np.cumsum(self.partner >= 0)
        return self.pair + (found if self.last is None else found[self.last])


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])


class Runs:
    """The words of a side that have no partner, by gap."""

    def __init__(self, side: Side):
        self.words = np.flatnonzero(side.partner < 0)
        gap = side.gaps()[self.words]
        self.starts = _firsts(gap)
        self.gap = gap[self.starts]
        self.sizes = np.diff(np.append(self.starts, len(gap)))


def common_runs(old: Side, new: Side) -> tuple[Runs, np.ndarray, Runs, np.ndarray]:
    """The runs of both sides, and which of them are in the same gap."""
    a, b = Runs(old), Runs(new)
    # Numbers of gaps are in order on both sides.
    place = np.searchsorted(b.gap, a.gap)
    here = np.flatnonzero(np.append(b.gap, -1)[place] == a.gap)
    return a, here, b, place[here]


def _places(n: int, some: np.ndarray) -> np.ndarray:
    """Of ``n`` the place among ``some``, or -1."""
    out = np.full(n, -1, np.int64)
    out[some] = np.arange(len(some))
    return out


def _match_ends(old: Side, new: Side, end: bool) -> None:
    a, here, b, there = common_runs(old, new)
    size = np.minimum(a.sizes[here], b.sizes[there])
    step = -1 if end else 1
    i, j = (r.starts[x] + (r.sizes[x] - 1 if end else 0) for r, x in ((a, here), (b, there)))
    # Most runs differ in their first word.
    some = np.flatnonzero(old.word[a.words[i]] == new.word[b.words[j]])
    i, j, size = i[some], j[some], size[some]
    begins = np.cumsum(size) - size
    along = (np.arange(size.sum()) - np.repeat(begins, size)) * step
    left, right = a.words[np.repeat(i, size) + along], b.words[np.repeat(j, size) + along]
    missed = np.cumsum(old.word[left] != new.word[right])
    reached = missed == np.repeat(missed[begins], size)
    left, right = left[reached], right[reached]
    old.partner[left], new.partner[right] = new.pos[right], old.pos[left]


def _match_unique(old: Side, new: Side, width: int, n_words: int) -> None:
    a, here, b, there = common_runs(old, new)
    at, run = [], []
    for side, met in ((a, here), (b, there)):
        # A run of words begins with each but the last ones of a gap.
        left = np.arange(len(side.words)) - np.repeat(side.starts + side.sizes - width, side.sizes)
        of = np.repeat(_places(len(side.gap), met), side.sizes)
        begins = np.flatnonzero((left <= 0) & (of >= 0))
        at.append(begins)
        run.append(of[begins])
    of, n_old = np.concatenate(run), len(at[0])
    if not len(of):
        return
    key, size = of, len(here)
    for i in range(width):
        if size > (1 << 62) // (n_words * len(of)):
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max()) + 1
        key = key * n_words + np.concatenate([s.word[r.words[x + i]] for s, r, x in ((old, a, at[0]), (new, b, at[1]))])
        size *= n_words
    # Runs of words and where they are as one number, which sorts faster than an order of them.
    mixed = np.sort(key * len(of) + np.arange(len(of)))
    key, place = mixed // len(of), mixed % len(of)
    same = np.concatenate([[False], key[1:] == key[:-1], [False]])
    # Two in all, one on each side.
    twice = np.flatnonzero(same[1:-1] & ~same[:-2] & ~same[2:])
    i, j = place[twice], place[twice + 1]
    once = (i < n_old) & (j >= n_old)
    i, j = i[once], j[once]
    left, right, of = a.words[at[0][i]], b.words[at[1][j - n_old]], of[i]
    fits = _in_order(of, left, new.pos[right])
    # Positions may repeat, if several texts have the same key.
    fits &= _in_order(of, right, old.pos[left])
    left, right = left[fits], right[fits]
    old.partner[left], new.partner[right] = new.pos[right], old.pos[left]


def _in_order(run: np.ndarray, at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether all words before, in order of ``at``, have a lesser ``other`` in the same run, and all after it a larger one."""
    order = np.argsort(at)
    # Runs are in order, too, so that other ones decide nothing.
    value = run[order] * (int(other.max(initial=0)) + 1) + other[order]
    before, after = np.maximum.accumulate(value), np.minimum.accumulate(value[::-1])[::-1]
    fits = np.ones(len(at), bool)
    fits[order] = np.append(True, before[:-1] < value[1:])[: len(at)] & np.append(after[1:] > value[:-1], True)[: len(at)]
    return fits


def align(old: Side, new: Side, rounds: tuple, n_words: int) -> None:
    """Give the words of both sides their partners, as ``textdiff.aligned`` does; words are numbers below ``n_words``."""
    for step in rounds:
        if isinstance(step, str):
            _match_ends(old, new, step == "end")
        else:
            _match_unique(old, new, step, n_words)


class _Words:
    """The words of many texts, one text after the other, as numbers; of each number the letters."""

    def __init__(self, texts: list[str]):
        told = [tx.split_words(t) for t in texts]
        self.sizes = np.array([len(x) for x in told], np.int64)
        found = pa.array(chain.from_iterable(told), pa.string()).dictionary_encode()
        self.numbers, self.n = found.indices.to_numpy().astype(np.int64), len(found.dictionary)
        self.said, self.ends = tx.letters(found.dictionary)
        self.lengths = np.diff(self.ends, prepend=0)

    def letters(self, numbers: np.ndarray) -> np.ndarray:
        """The letters of words one after the other."""
        many = self.lengths[numbers]
        after = self.ends[numbers] - np.cumsum(many)
        return self.said[np.repeat(after, many) + np.arange(many.sum())]


def _changed(words: _Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` old texts differ in their letters from the new ones, which stand after them, and how many letters both have."""
    before = np.append(0, np.cumsum(words.lengths[words.numbers]))
    ends = before[np.cumsum(words.sizes)]
    total = np.diff(ends, prepend=0)
    differ = total[:n] != total[n:]
    if not differ.all():
        said = words.letters(words.numbers)
        begins = ends - total
        for i in np.flatnonzero(~differ):
            old, new = (said[begins[x] : ends[x]] for x in (i, i + n))
            differ[i] = not np.array_equal(old, new)
    changed = np.flatnonzero(differ)
    return changed, total[changed] + total[changed + n]


def _side(words: _Words, texts: np.ndarray, pair: np.ndarray) -> Side:
    """The words of some texts, each of a pair; pairs are in order."""
    sizes = words.sizes[texts]
    begins = (np.cumsum(words.sizes) - words.sizes)[texts]
    of = np.repeat(pair, sizes)
    pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    word = words.numbers[np.repeat(begins, sizes) + pos]
    if len(_firsts(pair)) == len(pair):
        return Side(of, pos, word)
    order = np.lexsort((pos, of))
    of, pos, word = of[order], pos[order], word[order]
    starts = _firsts(of * (int(sizes.max(initial=0)) + 1) + pos)
    many = np.diff(np.append(starts, len(of)))
    return Side(of, pos, word, np.repeat(starts + many - 1, many))


def _letters(side: Side, runs: Runs, met: np.ndarray, words: _Words) -> Side:
    """The letters of the runs ``met``; each is a pair of its own."""
    of, number = np.repeat(_places(len(runs.gap), met), runs.sizes), side.word[runs.words]
    of, number = of[of >= 0], number[of >= 0]
    said = words.letters(number)
    return Side(np.repeat(of, words.lengths[number]), np.arange(len(said)), _LETTERS[said])


def matched_letters(old: list[str], new: list[str], pair: np.ndarray, word_rounds: tuple, letter_rounds: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that differ in their letters, how many letters both have, and how many of the old letters of their pair have a partner.

    ``pair`` numbers the pairs in order; texts of the same pair are taken together. Letters of words that have a partner
    have one, those of the other words are aligned gap by gap.
    """
    words, n_pairs = _Words([*old, *new]), int(pair.max(initial=-1)) + 1
    changed, total = _changed(words, len(old))
    pair = pair[changed]
    a, b = _side(words, changed, pair), _side(words, changed + len(old), pair)
    align(a, b, word_rounds, max(words.n, 1))
    held = a.partner >= 0
    found = np.bincount(a.pair[held], words.lengths[a.word[held]], n_pairs)
    runs_a, here, runs_b, there = common_runs(a, b)
    x, y = _letters(a, runs_a, here, words), _letters(b, runs_b, there, words)
    align(x, y, letter_rounds, 36)
    in_pair = a.pair[runs_a.words[runs_a.starts[here]]]
    found += np.bincount(in_pair[x.pair[x.partner >= 0]], minlength=n_pairs)
    return changed, total, found.astype(np.int64)[pair]


def similar_batches(keys: list[str], word_rounds: tuple, letter_rounds: tuple):
    """For ``mapInArrow``: rows with ``keys``, ``old``, ``new`` and whether they are the ``first`` of their key, in order of keys.

    Returns *keys*, ``total`` and ``matched`` of the texts that differ in their letters.
    """

    def work(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        pair = np.cumsum(table.column("first").to_numpy()) - 1
        changed, total, matched = matched_letters(table.column("old").to_pylist(), table.column("new").to_pylist(), pair, word_rounds, letter_rounds)
        kept = table.select(keys).take(pa.array(changed)).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(total), pa.array(matched)], names=[*keys, "total", "matched"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            sizes = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("old", "new"))
            before = np.cumsum(sizes) - sizes
            at = 0
            for row in np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False)).tolist():
                if size + before[row] - before[at] >= AT_ONCE:
                    yield work([*held, batch.slice(at, row - at)])
                    held, size, at = [], 0, row
            if batch.num_rows:
                held.append(batch.slice(at))
                size += int(sizes[at:].sum())
        if held:
            yield work(held)

    return run
