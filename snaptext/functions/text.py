"""Column functions on text, ids, dates and distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

# What counts as blank between words and around lines.
BLANKS = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANK_RUN = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
# The same for Java, which may first rule out all printable ASCII in one step.
BLANK_RUN_JAVA = f"[[^!-~]&&{BLANK_RUN[:-1]}]+"
TOKEN = r"[a-z0-9]+"
HYPHEN_PAIR = r"[a-z0-9]+-[a-z0-9]+"
#: Texts that are tokenised at once.
FEW_TEXTS = 256


def strip(text: Column) -> Column:
    """``text`` without leading and trailing blanks."""
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Blank-separated words, in order."""
    return F.array_remove(F.split(text, BLANK_RUN_JAVA), "")


def split_words(text: str) -> list[str]:
    """What ``words`` returns, in Python: there the same characters are blank."""
    return text.split()


def single_spaced(text: Column) -> Column:
    """The ``words`` of ``text`` with single spaces between them."""

    def join(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else " ".join(t.split()) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(join, "string")(text)


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens, then the joined form of each hyphenated pair."""
    low = F.lower(text)
    pairs = F.array_join(F.regexp_extract_all(low, F.lit(HYPHEN_PAIR), F.lit(0)), " ")
    joined = F.split(F.replace(pairs, F.lit("-"), F.lit("")), " ")
    return F.array_remove(
        F.concat(
            F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)),
            F.when(F.contains(low, F.lit("-")), joined).otherwise(F.array().cast("array<string>")),
        ),
        "",
    )


_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True


def low_tokens(low: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """What ``tokens`` returns, of many texts in lower case (null: none): all tokens in one array, and the text of each.

    The joined forms of hyphenated pairs come after the tokens of some texts.
    """
    found = [(said, of + at) for at, some in _slices(low) for said, of in [_some_tokens(some)]]
    return (pa.concat_arrays([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else _some_tokens(low)


def n_low_tokens(low: pa.StringArray) -> np.ndarray:
    """How many ``low_tokens`` each text has."""
    return np.concatenate([np.zeros(0, np.int64), *(_n_some_tokens(some) for _, some in _slices(low))])


def _slices(texts: pa.StringArray) -> Iterator[tuple[int, pa.StringArray]]:
    """Parts of few texts, whose arrays stay small, and where they begin."""
    return ((at, texts.slice(at, FEW_TEXTS)) for at in range(0, len(texts), FEW_TEXTS))


def _some_tokens(low: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    said, first, last, of = _low_runs(low)
    if not len(first):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    offsets = np.append(0, np.cumsum(last - first + 1)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(said[_IN_TOKEN[said]]))
    left = _left_of_pairs(said, first, last, of)
    if not len(left):
        return found, of
    joined = pc.binary_join_element_wise(found.take(pa.array(left)), found.take(pa.array(left + 1)), "")
    return pa.concat_arrays([found, joined]), np.append(of, of[left])


def _n_some_tokens(low: pa.StringArray) -> np.ndarray:
    said, first, last, of = _low_runs(low)
    return np.bincount(np.append(of, of[_left_of_pairs(said, first, last, of)]), minlength=len(low))


def _low_runs(low: pa.StringArray) -> tuple[np.ndarray, ...]:
    """The bytes of all texts, the first and last byte of each token and the text it is in."""
    low = low.fill_null("")
    ends_at = np.cumsum(pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64))
    size = int(ends_at[-1]) if len(ends_at) else 0
    # The texts lie one after the other, from the first one's place on.
    at = int(np.frombuffer(low.buffers()[1], np.int32)[low.offset]) if size else 0
    said = np.frombuffer(low.buffers()[2], np.uint8)[at : at + size] if size else np.zeros(0, np.uint8)
    if not size:
        return said, *(np.zeros(0, np.int64) for _ in range(3))
    inside = _IN_TOKEN[said]
    # A token ends with its text.
    goes_on = np.append(inside[:-1] & inside[1:], False)
    goes_on[ends_at[(ends_at > 0) & (ends_at < size)] - 1] = False
    last = np.flatnonzero(inside & ~goes_on)
    first = np.flatnonzero(inside & ~np.append(False, goes_on[:-1]))
    return said, first, last, np.searchsorted(ends_at, first, side="right")


def _left_of_pairs(said: np.ndarray, first: np.ndarray, last: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The first token of each hyphenated pair."""
    # Pairs don't overlap: of tokens linked by single hyphens the first two are one, then the next two.
    linked = (first[1:] == last[:-1] + 2) & (of[1:] == of[:-1])
    linked[linked] = said[last[:-1][linked] + 1] == ord("-")
    at = np.arange(len(linked))
    since = np.maximum.accumulate(np.where(linked, -1, at)) if len(at) else at
    return np.flatnonzero(linked & ((at - since) % 2 == 1))


def normalised(text: Column) -> Column:
    """Lower-case letters and digits only; the form in which texts are compared."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def letters(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """What ``normalised`` returns, of many words: the bytes of all, and where each ends."""
    low = pc.utf8_lower(words)
    said = np.frombuffer(low.buffers()[2] or b"", np.uint8)
    kept = _IN_TOKEN[said]
    ends = np.cumsum(pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64))
    return said[kept], np.append(0, np.cumsum(kept))[ends]


def natural_number(entity: Column, missing: int = 999) -> Column:
    """Leading integer of an id, for sorting ids as people do."""
    digits = F.regexp_extract(entity, r"^\d+", 0)
    return F.when(digits == "", F.lit(missing)).otherwise(digits.try_cast("long")).cast("long")


def bare_id(raw: Column, keyword: str = "condition") -> Column:
    """Id at the start of a citation such as ``Condition 12A - Title``; the raw text if there is none."""
    text = strip(F.regexp_replace(raw, rf"(?i)^\s*{keyword}\s+", ""))
    found = F.regexp_extract(text, r"^(\d+[A-Z]{0,3}(?:\.[A-Z])?)\b", 1)
    return F.when(found == "", text).otherwise(found)


def long_date(day: Column) -> Column:
    """``24 September 2022``."""
    return F.date_format(day, "d MMMM yyyy")


def distance_label(distance: Column) -> Column:
    """Distance to three places, or ``kw`` for a hit found by keyword only."""
    return F.coalesce(F.format_number(distance, 3), F.lit("kw"))


def pages_label(first: Column, last: Column) -> Column:
    return F.concat_ws("-", first.cast("string"), last.cast("string"))


def past_date(as_of: Column, today: Column) -> Column:
    """Whether a query asks about the past; ``today`` is given, never read from the clock."""
    return as_of < today
